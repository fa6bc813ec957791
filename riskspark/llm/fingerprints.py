"""Document fingerprints by consistent weighted sampling.

The terms of a text are its pairs of neighbouring words, weighted by their counts. For
each of ``SAMPLES`` positions every weighted term draws, from a hash of the term and the
position alone, two Gamma(2, 1) variates and a uniform one (Ioffe's improved consistent
weighted sampling); the least draw is the position's sample. Two texts share a sample
with a chance equal to their generalised Jaccard similarity. Only DataFrame and SQL
functions are used.

The variates are taken by way of the draw of the weight 1. That draw is ``c * u``, of a
Gamma variate ``c`` and a uniform ``u``: ``c * u`` and ``c - c * u`` are independent
exponential variates, and so are the two parts that the term's shift cuts the other Gamma
variate into. So a hash is the uniform number of the draw of the weight 1 itself, hashes
compare as draws do, and only a term that repeats needs the variates (``_repeated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import plain_text

#: Samples of a fingerprint: rows of ``LANES`` samples that are drawn together.
#: (So few that the code generated for a row stays in the size that the JVM compiles.)
SAMPLE_ROWS, LANES = 4, 16
SAMPLES = SAMPLE_ROWS * LANES
#: Tells the hashes of a row's lanes apart (odd, bits of the golden ratio).
LANE_BITS = 0x9E3779B97F4A7C15
#: Hex digits of a sample in the fingerprint.
DIGITS = 4
#: Documents of a block of neighbouring ids, and blocks at most.
BLOCK_DOCUMENTS, MAX_BLOCKS = 1024, 16384
#: Ids from which the block borders are chosen, about. Borders only share out work.
BORDER_IDS = 65_536


def _uniform(bits: str, n: int) -> str:
    """SQL of a uniform number, never 0 or 1, from ``n`` bits of a hash."""
    return f"(({bits} & {(1 << n) - 1}L) + 0.5D) * {2.0 ** -n!r}D"


def word_hashes(text: Column) -> Column:
    """Hashes of the words between single white-space characters."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def pair_hashes(words: Column) -> Column:
    """Hashes of neighbouring words; the last word is paired with nothing."""
    return F.zip_with(words, F.slice(words, 2, F.size(words) + 1), lambda a, b: F.xxhash64(a, b))


def repeats(sorted_terms: Column) -> Column:
    """Those of sorted terms that equal the one before them."""
    return F.filter(sorted_terms, lambda x, i: (i > 0) & (x == F.get(sorted_terms, i - 1)))


def weighted(sorted_repeats: Column) -> Column:
    """``term`` and the logarithm of its count in the text, for each distinct one of its sorted :func:`repeats`."""
    n = F.size(sorted_repeats)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        places,
        lambda i: (i == 0) | (F.get(sorted_repeats, i) != F.get(sorted_repeats, F.greatest(i - 1, F.lit(0)))),
    )
    return F.zip_with(
        starts,
        F.slice(starts, 2, F.size(starts) + 1),
        lambda a, b: F.struct(
            F.get(sorted_repeats, a).alias("term"), F.log((F.coalesce(b, n) - a + 1).cast("double")).alias("weight")
        ),
    )


def _hash(seed: str, lane: int) -> str:
    """SQL of a lane's hash of a term, of which ``seed`` has the hash in this row of samples."""
    return f"xxhash64({seed} ^ {LANE_BITS * (lane + 1) % (1 << 63)}L)"


def _once(lane: int) -> str:
    """SQL of a lane's draw of the weight 1: its order in the high 47 bits, the sampled (term, level) in the low 16."""
    return f"shiftrightunsigned({_hash('_seed', lane)}, 1)"


def _repeated(lane: int) -> str:
    """SQL of a lane's draw of ``_again``, of the weight ``exp(_weight)``, alike; null if it
    is the draw of the weight 1 (then the level is 0), or if no term repeats in this row.

    ``a`` is the draw of the weight 1, ``c = a + b`` and ``r = y - ln(a / c)`` are the
    Gamma variates, ``y / r`` is the shift. The level is ``floor((_weight + y) / r)``.
    """
    h = _hash("_again", lane)
    more = f"xxhash64({h})"
    a = f"-log1p(-(shiftrightunsigned({h}, 17) + 0.5D) * {2.0**-47!r}D)"
    b = f"-ln({_uniform(more, 32)})"
    y = f"-ln({_uniform(f'shiftrightunsigned({more}, 32)', 32)})"
    r = f"({y} + log1p({b} / ({a})))"
    level = f"floor((_weight + {y}) / {r})"
    draw = f"({a} + {b}) * exp({y} - ({level} + 1) * {r})"
    order = f"least(cast(-expm1(-({draw})) * {2.0**47!r}D as bigint), {(1 << 47) - 1}L)"
    made = f"shiftleft({order}, 16) | (shiftrightunsigned({h}, 1) ^ {level} * 40503) & 65535"
    return f"case when _again is not null and log1p({b} / ({a})) <= _weight then {made} end"


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fingerprint`` of each row; the keys tell rows apart.

    A fingerprint is ``SAMPLES`` samples of ``DIGITS`` hex digits. The empty text (null
    texts too) has one empty word, so it is like itself alone. Where ``rows`` are partitioned by a
    key, nothing is shuffled. The samples of a text are merged as they are drawn, so a
    very long text needs no more memory than its words.
    """
    e = rows.select(*keys, word_hashes(plain_text(text_col)).alias("_words"))
    e = e.select(*keys, F.sort_array(pair_hashes(F.col("_words"))).alias("_terms"))
    e = e.select(*keys, F.array_distinct("_terms").alias("_first"), repeats(F.col("_terms")).alias("_again"))
    # A row for each distinct term; a term that repeats has its weighted draw in a row beside another's.
    e = e.select(*keys, F.explode(F.arrays_zip("_first", weighted(F.col("_again")).alias("_again"))).alias("_t"))
    e = e.select(
        *keys,
        F.col("_t._first").alias("_term"),
        F.col("_t._again.term").alias("_other"),
        F.col("_t._again.weight").alias("_weight"),
        F.explode(F.sequence(F.lit(0), F.lit(SAMPLE_ROWS - 1))).alias("_row_of_samples"),
    )
    e = e.select(
        *keys,
        "_row_of_samples",
        F.xxhash64("_row_of_samples", "_term").alias("_seed"),
        F.when(F.col("_other").isNotNull(), F.xxhash64("_row_of_samples", "_other")).alias("_again"),
        "_weight",
    )
    least = e.groupBy(*keys, "_row_of_samples").agg(
        *[F.min(F.expr(f"least({_once(k)}, {_repeated(k)})")).alias(f"_v{k}") for k in range(LANES)]
    )
    sample = [
        F.lpad(F.hex(F.col(f"_v{k}").bitwiseAND((1 << 4 * DIGITS) - 1)), DIGITS, "0")
        for k in range(LANES)
    ]
    part = F.struct("_row_of_samples", F.lower(F.concat(*sample)).alias("s"))
    return (
        least.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(part)).alias("_parts"))
        .select(*keys, F.array_join(F.transform("_parts", lambda p: p["s"]), "").alias("fingerprint"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    at = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.filter(at, lambda i: F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS)))
    return F.size(same) / F.lit(float(SAMPLES))


def id_blocks(docs: DataFrame, block_documents: int = BLOCK_DOCUMENTS) -> tuple[Column, list]:
    """A column with the block of neighbouring ids that a row's ``id`` lies in, and the
    greatest id of each block, by block from the highest. There are at most
    ``MAX_BLOCKS`` blocks. Null ids come last, in the lowest block."""
    n = docs.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n // block_documents)))
    picked = docs.select("id").where(F.col("id").isNotNull())
    step = max(1, n // BORDER_IDS)
    some = picked.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(4 * BORDER_IDS).collect()
    ids = sorted({r[0] for r in some})
    borders = sorted({ids[len(ids) * k // blocks] for k in range(1, blocks)}) if ids else []
    kind = docs.schema["id"].dataType.simpleString()
    levels = len(borders).bit_length()
    if not borders:
        block = F.lit(0)
    else:
        # Binary search: the number of borders that are at most the id.
        joined = ",".join(str(b) for b in borders)
        found = f"aggregate(sequence({levels - 1}, 0, -1), 0, (low, k) -> if(coalesce(get(_b, low + shiftleft(1, k) - 1) <= id, false), low + shiftleft(1, k), low))"
        block = F.expr(found.replace("_b", f"cast(split('{joined}', ',') as array<{kind}>)"))
    tops = docs.select("id", block.alias("block")).groupBy("block").agg(F.max("id").alias("top")).collect()
    return block, sorted(((r["block"], r["top"]) for r in tops), reverse=True)


def with_next(docs: DataFrame) -> DataFrame:
    """``block, place, extra, id, text, next_text``: each row of ``(id, text)`` with the
    text of the next one by descending id (null ids last, equal ids by descending
    text); after the last comes the first. Each block also holds the row that follows
    its last one, marked ``extra``."""
    spark = docs.sparkSession
    block, tops = id_blocks(docs)
    d = docs.withColumn("block", block).withColumn("extra", F.lit(0))
    if not tops:
        return d.select("block", F.lit(1).alias("place"), "extra", "id", "text", F.col("text").alias("next_text"))
    # At most MAX_BLOCKS rows: the top of each block also goes to the block above it.
    follows = [(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)]
    kind = docs.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(follows, f"_top {kind}, _above int")
    first = d.join(F.broadcast(table), F.col("id").eqNullSafe(F.col("_top")))
    first = first.select("id", "text", F.col("_above").alias("block"), F.lit(1).alias("extra"))
    w = Window.partitionBy("block").orderBy("extra", F.col("id").desc_nulls_last(), F.col("text").desc())
    return d.unionByName(first).select(
        "block", F.row_number().over(w).alias("place"), "extra", "id", "text", F.lead("text").over(w).alias("next_text")
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the
    first as many (or all) of the next document by descending id. Returns ``id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``,
    a row for each input row (repeated rows stay). Null texts count as empty; a lone
    document follows itself; an empty table gives no rows. Other columns are not read.
    """
    rows = with_next(docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("extra") == 0, edited))
    versions = F.when(F.col("extra") == 0, F.array("text", "edited")).otherwise(F.array("text"))
    v = rows.select("block", "place", F.posexplode(versions).alias("version", "text"))
    v = v.select("block", (F.col("place").cast("long") * 2 + F.col("version")).alias("key"), "text")
    v = fingerprints(v, ["block", "key"], "text").withColumn("place", F.expr("cast(key div 2 as int)"))
    pick = [F.max(F.when(F.col("key") % 2 == k, F.col("fingerprint"))).alias(x) for k, x in enumerate(("own", "changed"))]
    v = v.groupBy("block", "place").agg(*pick)
    v = v.withColumn("following", F.lead("own").over(Window.partitionBy("block").orderBy("place")))
    light = rows.where(F.col("extra") == 0).select(
        "block", "place", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    return light.join(v, ["block", "place"]).select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("own").alias("fingerprint"),
        F.col("changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
