"""Preparation of labelled corpora: clean, deduplicate, balance, split, augment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions import text as X
from riskspark.operators.tables import small
from riskspark.sources.scratch import dropped, stored


#: Hex digits of a hash that tell its slices apart.
SLICE_DIGITS = 4
#: Rounds of conflicts after which the plan is cut.
CUT_ROUNDS = 6


def deal(key: Column, seed: str = "") -> Column:
    """A stable shuffle key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def cleaned(corpus: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows with ``reason``: why a row goes (noise, or fraud labelled legitimate), or null."""
    c = F.col(text)
    fraud = F.when(F.col(label) == 0, X.mislabelled(c))
    return corpus.withColumn("reason", F.coalesce(X.corpus_noise(c), fraud))


def removal_report(judged: DataFrame) -> DataFrame:
    """``reason, n``: rows by reason, ``kept`` for those that stay."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key by ``seq``. A hash aggregate, so a key with many rows
    is merged before it is shuffled."""
    rest = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*rest), F.col(seq)).alias("_r")
    return df.groupBy(key).agg(row).select(key, "_r.*").select(df.columns)


def resolve_conflicts(df: DataFrame, key: str, seq: str, label: str, priority: str) -> DataFrame:
    """``key, label, seq, changed``: the row of each key that is left when, in order, a
    row replaces the one held if its label differs and its source ranks better (a lower
    number). ``changed`` counts the replacements.

    Every replacement improves the priority, so as many rounds as there are priorities
    find it, or fewer: each one takes, for every key at once, the first later row that
    wins. Rows are narrowed once, a key with many rows is merged before it is shuffled, and
    the plan is cut after every few rounds."""
    rows = stored(df.select(key, F.col(seq).alias("seq"), F.col(label).alias("label"), F.col(priority).alias("priority")))
    rounds = rows.agg(F.count_distinct("priority")).first()[0]
    held = rows.groupBy(key).agg(F.min_by(F.struct("seq", "label", "priority"), "seq").alias("h"), F.lit(0).cast("bigint").alias("changed"))
    done, before = 0, None
    for n in range(1, rounds):
        wins = (F.col("seq") > F.col("h.seq")) & (F.col("label") != F.col("h.label")) & (F.col("priority") < F.col("h.priority"))
        later = F.when(wins, F.struct("seq", "label", "priority"))
        following = rows.join(held, key).groupBy(key).agg(
            F.min_by(later, F.when(wins, F.col("seq"))).alias("n"), F.first("h").alias("h"), F.first("changed").alias("changed")
        )
        held = following.select(key, F.coalesce("n", "h").alias("h"), (F.col("changed") + F.col("n").isNotNull().cast("bigint")).alias("changed"))
        if n % CUT_ROUNDS == 0 and n + 1 < rounds:
            held = stored(held)
            last, done = done, held.agg(F.sum("changed")).first()[0] or 0
            dropped(before)
            before = held
            if done == last:  # a few rounds have changed nothing, so no more will
                break
    return held.select(key, F.col("h.label").alias("label"), F.col("h.seq").alias("seq"), "changed")


def balanced(df: DataFrame, label: str, key: Column, ratio: int = 1, seed: str = "") -> DataFrame:
    """At most ``ratio`` rows of each label for each row of the rarest one, picked by a
    stable hash. Rows are counted by label and slice of the hash; whole slices stay up to
    the one that holds the label's last row, and only rows of that slice are ranked."""
    dealt = df.withColumn("_deal", deal(key, seed)).withColumn("_slice", F.substring("_deal", 1, SLICE_DIGITS))
    n = dealt.groupBy(F.col(label).alias("_label"), "_slice").agg(F.count(F.lit(1)).alias("n"))
    want = n.groupBy("_label").agg(F.sum("n").alias("n")).agg((F.min("n") * ratio).alias("want"))
    n = n.withColumn("upto", F.sum("n").over(Window.partitionBy("_label").orderBy("_slice"))).join(F.broadcast(want))  # one row
    over = F.when(F.col("upto") > F.col("want"), F.struct("_slice", (F.col("want") - F.col("upto") + F.col("n")).alias("room")))
    cuts = n.groupBy("_label").agg(F.min(over).alias("_cut")).select("_label", F.col("_cut._slice").alias("_cut"), F.col("_cut.room").alias("_room"))
    met = dealt.join(small(cuts), F.col(label).eqNullSafe(F.col("_label")))
    below = met.where(F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")))
    w = Window.partitionBy("_label").orderBy("_deal")
    last = met.where(F.col("_slice") == F.col("_cut")).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_room"))
    return below.select(df.columns).unionByName(last.select(df.columns))


def sample(df: DataFrame, key: Column, n: int, seed: str = "") -> DataFrame:
    """``n`` rows by a stable hash."""
    return df.withColumn("_deal", deal(key, seed)).orderBy("_deal").limit(n).select(df.columns)


def split(df: DataFrame, key: Column, held_percent: int = 10, seed: str = "") -> DataFrame:
    """Rows with ``held_out``: rows of equal keys fall on one side."""
    bucket = F.conv(F.substring(deal(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("held_out", bucket < held_percent)


def url_split(df: DataFrame, url: str, held_percent: int = 10) -> DataFrame:
    return split(df, X.url_key(F.col(url)), held_percent)


def normalised_labels(df: DataFrame, label: str, phishing: Sequence[object], legitimate: Sequence[object]) -> DataFrame:
    """Labels as 1 (phishing) and 0; rows of other labels go."""
    c = F.when(F.col(label).isin(list(phishing)), 1).when(F.col(label).isin(list(legitimate)), 0)
    return df.withColumn(label, c).where(F.col(label).isNotNull())


def inverted_if_binary(df: DataFrame, label: str) -> DataFrame:
    """Labels turned round if they are exactly 0 and 1."""
    c = F.col(label)
    both = (F.min(c) == 0) & (F.max(c) == 1) & (F.count_if(~c.isin(0, 1)) == 0)
    return df.join(F.broadcast(df.agg(both.alias("_b")))).withColumn(
        label, F.when(F.col("_b"), 1 - F.col(label)).otherwise(F.col(label))
    ).drop("_b")


def label_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Mean, upper median, least and most length, from counts of each length."""
    n = df.groupBy(*by, F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by).orderBy("len")
    whole = Window.partitionBy(*by)
    n = n.withColumn("upto", F.sum("k").over(w)).withColumn("all", F.sum("k").over(whole))
    median = F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("len"))).alias("median_len")
    return n.groupBy(*by).agg(
        (F.sum(F.col("len") * F.col("k")) / F.sum("k")).alias("mean_len"), median, F.min("len").alias("min_len"), F.max("len").alias("max_len")
    )


def joined_title(url: Column, title: Column) -> Column:
    return F.concat_ws(" [SEP] ", url, title)


def with_url_variants(df: DataFrame, url: str, label: str, known_good: DataFrame, times: int = 3) -> DataFrame:
    """The rows; legitimate ones with a path added (60 %), phishing ones without their
    path (30 %), and known good URLs ``times`` times. Choices are by hash."""
    c = F.col(url)
    dealt = F.conv(F.substring(deal(c, "variant"), 1, 8), 16, 10).cast("bigint") % 100
    path = F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/"), F.substring(deal(c, "path"), 1, 6))
    longer = df.where((F.col(label) == 0) & (dealt < 60)).withColumn(url, path)
    bare = df.where((F.col(label) == 1) & (dealt < 30)).withColumn(url, F.regexp_extract(c, r"^(https?://[^/?#]*)", 1))
    good = known_good.select(F.col(url), F.lit(0).alias(label)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k")
    return df.unionByName(longer).unionByName(bare).unionByName(good, allowMissingColumns=True)


def from_templates(ids: DataFrame, templates: Sequence[str], fields: dict[str, Sequence[str]], seed: str = "") -> DataFrame:
    """``id, text``: for each ``id`` a template with ``{field}`` filled by stable picks."""
    def pick(values: Sequence[str], salt: str) -> Column:
        k = F.conv(F.substring(deal(F.col("id"), seed + salt), 1, 8), 16, 10).cast("bigint") % len(values)
        return F.get(F.array(*map(F.lit, values)), k.cast("int"))

    text = pick(templates, "template")
    for name, values in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), pick(values, name))
    return ids.select("id", text.alias("text"))


# Placeholders, and what the plain ones stand for.
CITIES = ["北京", "上海", "深圳", "广州", "杭州", "成都", "武汉", "南京", "重庆", "西安", "长沙", "郑州", "东莞", "苏州", "天津", "厦门"]
BANKS = ["工商银行", "建设银行", "农业银行", "招商银行", "中国银行", "交通银行", "浦发银行", "平安银行", "中信银行"]
NAMES = ["先生", "女士", "用户", "朋友", "会员"]
PLACEHOLDERS = ("CELLPHONE", "HOTLINE", "WECHAT", "PLACE", "DIGIT", "PHONE", "NAME", "BANK", "URL", "QQ")

# Words that show a text was left with a placeholder or made from a template.
LEFT_OVER = ("PHONE", "DIGIT", "CELLPHONE", "NAME", "NAMEDIGITCELLPHONE", "URL", "PLACE", "XXX", "TEMPLATE", "RANDOM")


def uncontaminated(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has none of ``LEFT_OVER``, in any case of letters. Null texts go."""
    return df.where(~F.col(text).rlike("(?i)" + "|".join(LEFT_OVER)))


def _filled(kind: str, key: str) -> str:
    h = crc32(key.encode())
    digits = f"{h:010d}"
    return {
        "PLACE": CITIES[h % len(CITIES)],
        "NAME": NAMES[h % len(NAMES)],
        "BANK": BANKS[h % len(BANKS)],
        "DIGIT": digits[-(2 + h % 5) :],
        "CELLPHONE": "138" + digits[:8],
        "PHONE": "139" + digits[:8],
        "QQ": "1" + digits[:8],
        "WECHAT": f"wx{h:08x}",
        "HOTLINE": f"400-{digits[:3]}-{digits[3:7]}",
        "URL": f"https://example.com/{h:08x}",
    }[kind]


def fill_placeholders(c: Column, seed: str = "") -> Column:
    """Placeholders (also run together) replaced by values that depend on the text, the
    place and the seed alone; then single spaces."""
    import re

    pattern = re.compile("|".join(sorted(PLACEHOLDERS, key=len, reverse=True)))

    @F.pandas_udf("string")
    def fill(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out = pattern.sub(lambda m: _filled(m[0], f"{seed}:{t}:{m.start()}"), t)
            return re.sub("  +", " ", out).strip()

        return texts.map(one)

    return fill(c)


# Characters that are mistyped, and as what.
TYPOS = {"的": "地得", "在": "再", "了": "啦", "吗": "嘛吧", "你": "您", "我": "俄", "是": "式"}
#: Of a thousand characters that may be mistyped, texts, and spaces of such a text, those that are changed.
TYPO_RATE, SPACE_RATE, DROPPED_SPACES = 50, 30, 300


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often functions inside ``f`` use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _drawn(c: Column, seed: str, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``f`` of whole numbers drawn by the text, the seed and a place in it. The text is hashed once."""

    def draw(head: Column) -> Callable[[Column], Column]:
        return lambda i: F.conv(F.substring(F.md5(F.concat(head, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")

    return _bound(F.md5(F.concat(c, F.lit(f":{seed}"))), lambda head: f(draw(head)))


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def with_noise(c: Column, rate: float = 0.05, seed: str = "0") -> Column:
    """Some characters doubled, dropped, or swapped with their neighbour (``rate`` in all),
    by the text, the place and the seed alone."""
    third = int(rate * 1_000_000 / 3)

    def noisy(draw: Callable[[Column], Column], chars: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # Places 0 and 1, 2 and 3, ... are neighbours; the draw of the second decides for both.
            own, pair = draw(i) % 1_000_000, draw(i + 1 - i % 2) % 1_000_000
            other = F.get(chars, i + 1 - i % 2 * 2)
            moved = F.when((pair >= 2 * third) & (pair < 3 * third), F.coalesce(other, x)).otherwise(x)
            return F.when(own < third, "").when(own < 2 * third, F.concat(x, x)).otherwise(moved)

        return F.array_join(F.transform(chars, one), "")

    return _drawn(c, seed, lambda draw: _bound(_characters(c), lambda chars: noisy(draw, chars)))


def with_typos(c: Column, typos: dict[str, str] | None = None, rate: int = TYPO_RATE, seed: str = "") -> Column:
    """Some of the characters that ``typos`` has as one of the characters that it names for them."""
    typos = typos or TYPOS
    known = F.create_map(*[F.lit(v) for k, x in typos.items() for v in (k, x)])

    def typed(draw: Callable[[Column], Column]) -> Column:
        def one(x: Column, i: Column) -> Column:
            choices = F.try_element_at(known, x)
            pick = F.substring(choices, (F.floor(draw(i) / 1000) % F.length(choices)).cast("int") + 1, F.lit(1))
            return F.when(x.isin(*typos), F.when(draw(i) % 1000 < rate, pick).otherwise(x)).otherwise(x)

        return F.array_join(F.transform(F.split(c, ""), one), "")

    return _drawn(c, seed, typed)


def with_spaces(c: Column, rate: int = SPACE_RATE, seed: str = "") -> Column:
    """Some texts with a space more, and some without the last space that is drawn."""
    n = F.length(c)

    def spaced(draw: Callable[[Column], Column]) -> Column:
        more, less = draw(F.lit("in")), draw(F.lit("out"))
        place = (F.lit(1) + F.floor(more / 1000) % F.greatest(n - 1, F.lit(1))).cast("int")
        longer = F.when((more % 1000 < rate) & (n > 1), F.concat(F.substring(c, F.lit(1), place), F.lit(" "), F.substring(c, place + 1, n))).otherwise(c)
        spaces = F.transform(_characters(longer), lambda x, i: F.when((x == " ") & (i > 0) & (draw(i) % 1000 < DROPPED_SPACES), i))
        last = F.array_max(spaces).cast("int")
        shorter = F.concat(F.substring(longer, F.lit(1), last), F.substring(longer, last + 2, F.length(longer)))
        return F.when((less % 1000 < rate) & last.isNotNull(), shorter).otherwise(longer)

    return _drawn(c, seed + "space", spaced)


def kept_augmentations(pairs: DataFrame, original: str, changed: str, least: float = 0.1, most: float = 0.7) -> DataFrame:
    """Pairs (met by an explicit row id) whose texts differ neither too little nor too much."""
    d = X.normalised_distance(F.col(original), F.col(changed))
    return pairs.withColumn("distance", d).where((d >= least) & (d <= most))


def scored(df: DataFrame, scorer, text: str = "text", refuses: tuple[type[Exception], ...] = (ArithmeticError,)) -> DataFrame:
    """``text, score`` of each distinct text by a pluggable scorer: a function from a
    list of texts to a list of scores, made once for each task by ``scorer()``. Texts of a
    batch that the scorer ``refuses`` are scored one by one, and those that it refuses alone get null,
    which fusion leaves out; any other fault of the scorer is a fault of the job."""

    def one(model, t: str) -> float | None:
        try:
            return float(model([t])[0])
        except refuses:
            return None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for batch in batches:
            texts = batch["text"].tolist()
            try:
                values = [float(v) for v in model(texts)]
            except refuses:
                values = [one(model, t) for t in texts]
            yield pd.DataFrame({"text": batch["text"], "score": pd.array(values, "Float64")})

    return df.select(F.col(text).alias("text")).distinct().mapInPandas(score, "text string, score double")


def paired(original: DataFrame, changed: DataFrame, row_id: str) -> DataFrame:
    """Rows of both frames met by an explicit row id (``text`` and ``changed``)."""
    return original.select(row_id, "text").join(changed.select(row_id, F.col("text").alias("changed")), row_id)


def held_out_source(df: DataFrame, source: str, held: Sequence[str]) -> DataFrame:
    """Rows with ``held_out``: all of the named sources (such as the newest year)."""
    return df.withColumn("held_out", F.col(source).isin(list(held)))


def cropped(c: Column, least: int = 30, most: int = 60, seed: str = "") -> Column:
    """A piece of ``least`` to ``most`` characters, by the text and the seed alone."""
    def pick(salt: str, n: Column) -> Column:
        h = F.conv(F.substring(deal(c, seed + salt), 1, 8), 16, 10).cast("bigint")
        return (h % n).cast("int")

    size = F.least(F.lit(least) + pick("size", F.lit(most - least + 1)), F.length(c))
    return F.substring(c, F.lit(1) + pick("start", F.length(c) - size + 1), size)


def variations(c: Column, rules: Sequence[tuple[str, Sequence[str]]], seed: str = "") -> Column:
    """Each pattern replaced by one of its alternatives, by the text and the seed alone."""
    out = c
    for k, (pattern, choices) in enumerate(rules):
        h = F.conv(F.substring(deal(c, f"{seed}{k}"), 1, 8), 16, 10).cast("bigint") % len(choices)
        out = F.regexp_replace(out, F.lit(pattern), F.get(F.array(*map(F.lit, choices)), h.cast("int")))
    return out
