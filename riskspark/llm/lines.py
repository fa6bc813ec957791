"""Line deduplication by a segment-partition edit join.

Short lines are compared by characters, lines of ``LONG_WORDS`` words or more by words.
A line within ``t`` edits of another holds one of that line's ``t + 1`` segments
unchanged, at nearly the same place. Segments are indexed by length class, number and
content; each line probes the indexes of the classes that near lines may have with the
few substrings that can match. What meets is verified by a banded bit-parallel edit
distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_rows, dropped, numbered, own_worker, stored
from riskspark.llm.graph import bucket_links, components
from riskspark.llm.substrings import mixed

#: Lines of so many words are compared by words, if both are.
LONG_WORDS = 24
#: Length classes and the edits allowed in them (of two lines, the shorter one's count):
#: characters of lines of fewer words, and words.
CHARACTER_EDITS = {20: 1, 40: 2} | {40 << k: 2 for k in range(1, 24)}
WORD_EDITS = {24: 1, 48: 2, 72: 3, 96: 4, 144: 6, 192: 8} | {192 << k: 8 for k in range(1, 20)}
#: Code points that are hashed at once, about.
PIECE = 1 << 19
#: Ids of lines that a task has met and does not send again, about.
REMEMBERED = 100_000
#: Rows of an Arrow batch of whole texts.
BATCH_TEXTS = 1024
#: Line ids that are broadcast at most (8 or 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def edits_allowed(length: int, by_words: bool) -> int:
    classes = WORD_EDITS if by_words else CHARACTER_EDITS
    return max((t for least, t in classes.items() if least <= length), default=0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, hashes of characters, and which of them are white space."""
    value = mixed(np.arange(1, 1 << 16, dtype="u8") * np.uint64(_BASE))
    white = np.array([chr(c).isspace() for c in range((1 << 16) - 1)])
    return _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE), value, white


class Units:
    """Hashes of runs of units (characters, or words) of lines that lie one after the other."""

    def __init__(self, value: np.ndarray, length: np.ndarray):
        self.value, self.length = value, length
        self.start, n = np.cumsum(length) - length, len(value)
        power, self.inverse = (_powers(_BASE, n), _powers(_INVERSE, n)) if n > 2 * PIECE else _tables()[:2]
        self.total = np.zeros(n + 1, "u8")
        np.cumsum(value * power[:n], out=self.total[1:])

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed((self.total[start + length] - self.total[start]) * self.inverse[start])

    def parities(self, lines: np.ndarray) -> np.ndarray:
        """For each line, whether an odd number of its units falls in each of 128 bins;
        nothing for lines that are not among the marked ones."""
        out, length = np.zeros((len(lines), 2), "i8"), self.length[lines]
        value = self.value[np.repeat(lines, self.length)]
        at = np.repeat(np.arange(len(length)) * 128, length) + (value >> np.uint64(57)).astype("i8")
        odd = (np.bincount(at, minlength=128 * len(length)) & 1).astype("u1")
        out[lines] = np.packbits(odd).view("<i8").reshape(-1, 2)
        return out


def characters_and_words(lines: list[str]) -> tuple[Units, Units]:
    length = np.fromiter(map(len, lines), "i8", len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(points, (1 << 16) - 2)
    value, white = (t[low] for t in _tables()[2:])
    high = np.flatnonzero(points != low)
    value[high] = mixed((points[high].astype("u8") + np.uint64(1)) * np.uint64(_BASE))
    characters = Units(value, length)
    # A word begins and ends at white space or at its line's ends.
    edge = np.zeros(len(points) + 1, bool)
    edge[characters.start] = edge[-1] = True
    word = ~white
    start = np.flatnonzero(word & (edge[:-1] | np.append(True, white[:-1])))
    end = np.flatnonzero(word & (edge[1:] | np.append(white[1:], True))) + 1
    n = np.searchsorted(start, characters.start + length) - np.searchsorted(start, characters.start)
    return characters, Units(characters.hashes(start, end - start), n)


def segment_keys(units: Units, classes: dict[int, int], indexed: np.ndarray, probing: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Line number, key, whether the key is of an indexed segment, its place and its size,
    for the lines marked as ``indexed`` and the probes of those marked as ``probing``.

    In a class of lines that have ``least`` units or more, ``t + 1`` segments of equal
    length begin at the line's start. Of a pair within ``t`` edits, the shorter line has
    a segment ``k`` that is unchanged and has ``k`` edits before it and ``t - k`` at most
    after it: that bounds how far it is shifted in the longer one, whose length is at
    most ``t`` more. Unshifted segments of a line's own class are among its probes.
    """
    borders = sorted(classes)
    for c, least in enumerate(borders):
        t = classes[least]
        below = borders[c + 1] if c + 1 < len(borders) else np.inf
        size = least // (t + 1)
        leads = indexed & (units.length >= least) & (units.length < below)
        probes = probing & (units.length >= least) & (units.length - t < below)
        probes, both = np.flatnonzero(probes), np.flatnonzero(probes | leads)
        if not len(both):
            continue
        for k in range(t + 1):
            tag = mixed(np.full(1, ((kind << 8) + c << 8) + k + 1, "u8") * np.uint64(_BASE))
            for shift in range(-min(k, t - k), k + 1):
                if shift < 0 and k + shift < 0:
                    continue
                at = k * size + shift
                line = probes if shift else both
                line = line[units.length[line] >= at + size]
                if len(line):
                    key = mixed(units.hashes(units.start[line] + at, size) ^ tag)
                    yield line, key, leads[line] & (shift == 0), at, size


def line_id(line: str) -> int:
    """The same as Spark's ``xxhash64`` of the line."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _kinds(characters: Units, words: Units) -> tuple[tuple[Units, dict[int, int], np.ndarray, np.ndarray], ...]:
    """Units and classes by characters and by words, and the lines that are indexed and that probe there."""
    long = words.length >= LONG_WORDS
    # A long line also meets short ones that an edit or two would make long.
    nearly = words.length < LONG_WORDS + 2 * max(CHARACTER_EDITS.values())
    return (characters, CHARACTER_EDITS, ~long, nearly), (words, WORD_EDITS, long, long)


def _key_frame(ids: dict[str, int]) -> pd.DataFrame:
    """Keys of distinct lines. The parities are of the units that the key is made of."""
    kinds = _kinds(*characters_and_words(list(ids)))
    ids, out = np.fromiter(ids.values(), "i8", len(ids)), []
    for kind, (units, classes, indexed, probing) in enumerate(kinds):
        odd = units.parities(indexed | probing)
        most = np.array([0, *(classes[c] for c in sorted(classes))])[np.searchsorted(sorted(classes), units.length, "right")]
        for line, key, lead, _, _ in segment_keys(units, classes, indexed, probing, kind):
            out.append((key.view("i8"), ids[line], lead, odd[line, 0], odd[line, 1], units.length[line], most[line], np.full(len(line), kind)))
    columns = ["bucket", "node", "lead", "p0", "p1", "size", "most", "kind"]
    if not out:
        return pd.DataFrame({c: np.zeros(0, bool if c == "lead" else "i8") for c in columns})
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))


#: Stands where a segment was cut out: what is left of it and what is right of it stay apart.
CUT = "\uffff"
#: What is left of a line in a hot bucket: its units (words are joined by ``\x1f``), and by how much the line is longer.
REST = "bucket long, node long, rest string, by_words boolean, longer int"


def _units(rest: str, by_words: bool) -> Sequence:
    return rest.split("\x1f") if by_words else rest


def rests(pairs: pd.DataFrame) -> Iterator[tuple]:
    """Of lines (``bucket, node, content``), what is left beside the segment of the bucket."""
    contents = list(dict.fromkeys(pairs["content"]))
    number = {c: k for k, c in enumerate(contents)}
    asked: dict[tuple[int, int], list[int]] = {}
    for b, node, c in zip(pairs["bucket"].tolist(), pairs["node"].tolist(), pairs["content"], strict=True):
        asked.setdefault((number[c], b), []).append(node)
    buckets = np.unique(pairs["bucket"].to_numpy("i8"))
    for kind, (units, classes, indexed, probing) in enumerate(_kinds(*characters_and_words(contents))):
        for line, key, _, at, size in segment_keys(units, classes, indexed, probing, kind):
            key = key.view("i8")
            some = np.flatnonzero(np.isin(key, buckets))
            for k, b in zip(line[some].tolist(), key[some].tolist(), strict=True):
                for node in asked.get((k, b), ()):
                    u = contents[k].split() if kind else contents[k]
                    rest = "\x1f".join([*u[:at], CUT, *u[at + size :]]) if kind else u[:at] + CUT + u[at + size :]
                    yield b, node, rest, bool(kind), size - 1


def inner_keys(bucket: int, rest: str, by_words: bool, longer: int) -> Iterator[tuple[int, bool, int, int]]:
    """Key, whether it is of an indexed segment, place and size, of what is left of a line.

    Two near lines of a bucket are near in what is left, too. The shorter one's rest is cut
    into one segment more than it may have edits, all of it, and the longer one's probes
    for that length; the bounds of shifts are those of :func:`segment_keys`."""
    u = _units(rest, by_words)
    n = len(u)
    for length in range(max(1, n - max(CHARACTER_EDITS.values() if not by_words else WORD_EDITS.values())), n + 1):
        t = edits_allowed(length + longer, by_words)
        if n - length > t or not t:
            continue
        for k in range(t + 1):
            begin, end = length * k // (t + 1), length * (k + 1) // (t + 1)
            more = n - length
            for shift in range(max(-k, more - (t - k)), min(k, more + (t - k)) + 1):
                at = begin + shift
                if at < 0 or at + end - begin > n:
                    continue
                part = u[at : at + end - begin]
                text = f"{bucket}|{length}|{k}|" + ("\x1f".join(part) if by_words else part)
                h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                yield h - (1 << 64) if h >> 63 else h, length == n and not shift, at, end - begin


def _splitter(held: DataFrame) -> Callable:
    """How to split buckets whose lines' rests are ``held``."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, row.node, lead) for row in batch.itertuples(index=False) for key, lead, _, _ in inner_keys(row.bucket, row.rest, row.by_words, row.longer)]
            yield pd.DataFrame(out, columns=["bucket", "node", "lead"]).astype({"bucket": "i8", "node": "i8", "lead": bool})

    def members() -> DataFrame:
        rows = held.mapInPandas(keys, "bucket long, node long, lead boolean")
        rows = rows.groupBy("bucket", "node").agg(F.max("lead").alias("lead"))
        # Keys of one line, or that nothing is indexed by, meet nothing.
        known = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("lead").alias("any")).where("n > 1 and any").select("bucket")
        return stored(rows.join(known, "bucket", "left_semi"))

    def split(hot: DataFrame) -> tuple[DataFrame, Callable]:
        buckets = hot.select("bucket").distinct()
        buckets = F.broadcast(buckets) if buckets.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else buckets

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    u = _units(row.rest, row.by_words)
                    for key, _, at, size in inner_keys(row.bucket, row.rest, row.by_words, row.longer):
                        rest = "\x1f".join([*u[:at], CUT, *u[at + size :]]) if row.by_words else u[:at] + CUT + u[at + size :]
                        out.append((key, row.node, rest, row.by_words, row.longer + size - 1))
                yield pd.DataFrame(out, columns=["bucket", "node", "rest", "by_words", "longer"])

        inner = stored(held.mapInPandas(cut, REST).join(buckets, "bucket", "left_semi").distinct())
        deeper = _splitter(inner)
        return deeper.members(), deeper

    split.members = members
    return split


def within_edits(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether the edit distance is at most ``most`` (31 or less): Hyyrö's bit-parallel
    column, of which only the ``2 * most + 1`` bits around the diagonal are kept."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    end = min(len(a), len(b))
    k = 0
    while k < end and a[k] == b[k]:
        k += 1
    a, b, end = a[k:], b[k:], end - k
    k = 0
    while k < end and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if len(a) <= most:
        return _plain(a, b) <= most
    full, top = (1 << 64) - 1, 1 << 63
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, distance, across = full << (63 - most) & full, 0, most, 1 << 62
    limit, at = 2 * most + len(b) - len(a), most - 63
    for j, c in enumerate(b):
        bits = places.get(c, 0)
        x = (bits >> at if at >= 0 else bits << -at) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        hp, hn = (down | ~(d | up)) & full, d & up
        if j < len(a) - most:
            distance += not d & top
        else:
            distance += bool(hp & across)
            distance -= bool(hn & across)
            across >>= 1
        if distance > limit:
            return False
        up, down, at = (hn | ~(d >> 1 | hp)) & full, d >> 1 & hp, at + 1
    return distance <= most


def _plain(a: Sequence, b: Sequence) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a: str, b: str) -> bool:
    """Whether two lines are within the allowed edits of each other."""
    x, y = a.split(), b.split()
    if min(len(x), len(y)) >= LONG_WORDS:
        return within_edits(x, y, edits_allowed(min(len(x), len(y)), True))
    most = edits_allowed(min(len(a), len(b)), False)
    return a == b or most > 0 and within_edits(a, b, most)


def near_lines(texts: DataFrame) -> DataFrame:
    """``line_a, line_b``: digests of distinct lines of the column ``text`` that are near
    each other; enough pairs to connect whatever all near pairs connect."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_worker("lines", _tables.cache_clear)
        lines, size, seen = {}, 0, set()
        for batch in batches:
            for text in batch["text"]:
                for line in text.split("\n"):
                    if len(line) < min(CHARACTER_EDITS) or line in lines:
                        continue
                    key = line_id(line)
                    if key not in seen:
                        lines[line] = key
                        size += len(line)
                        if size > PIECE:
                            seen = {*seen, *lines.values()} if len(seen) < REMEMBERED else set(lines.values())
                            yield _key_frame(lines)
                            lines, size = {}, 0
        if lines:
            yield _key_frame(lines)

    rows = texts.select("text").mapInPandas(keys, "bucket long, node long, lead boolean, p0 long, p1 long, size long, most long, kind long")
    # Buckets of one line, or without an indexed segment, are most of them; a window needs the keys dealt once.
    bucket = Window.partitionBy("bucket")
    seen = {"low": F.min("node").over(bucket), "high": F.max("node").over(bucket), "any": F.max("lead").over(bucket)}
    rows = rows.withColumns(seen).where("low < high and any")
    rows = stored(rows.groupBy("bucket", "node").agg(F.max("lead").alias("lead"), *[F.first(c).alias(c) for c in ("p0", "p1", "size", "most", "kind")]))
    # A line may have parities of its characters and of its words.
    both = {f"{c}_{k}": F.max(F.when(F.col("kind") == k, F.col(c))) for k in (0, 1) for c in ("p0", "p1", "size", "most")}
    marks = rows.groupBy("node").agg(*[c.alias(name) for name, c in both.items()]).select("node", F.struct(*both).alias("mark"))

    def may_be_near(a: Column, b: Column) -> Column:
        """An edit changes the length by one and two parities at most, of characters or of words."""

        def of(kind: int) -> Column:
            odd = [F.bit_count(a[f"{p}_{kind}"].bitwiseXOR(b[f"{p}_{kind}"])) for p in ("p0", "p1")]
            most = F.least(a[f"most_{kind}"], b[f"most_{kind}"])
            longer = F.abs(a[f"size_{kind}"] - b[f"size_{kind}"])
            return F.coalesce((longer <= most) & (odd[0] + odd[1] <= 2 * most), F.lit(False))

        return of(0) | of(1)

    ids = rows.select("node").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    content = texts.select(F.explode(F.split("text", "\n")).alias("content")).withColumn("node", F.xxhash64("content"))
    content = content.join(ids, "node", "left_semi").withColumn("line", F.unhex(F.md5("content")))
    content = stored(content.groupBy("node", "line").agg(F.first("content").alias("content")))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (content.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}"), F.col("content").alias(f"text_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").where(alike("text_a", "text_b")).drop("text_a", "text_b")

    def split(hot: DataFrame) -> tuple[DataFrame, Callable]:
        """Lines that share a hot segment meet again by segments of what is left of them."""

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(list(rests(batch)), columns=["bucket", "node", "rest", "by_words", "longer"])

        lines = hot.join(content.groupBy("node").agg(F.collect_set("content").alias("c")), "node")
        lines = lines.select("bucket", "node", F.explode("c").alias("content"))
        inner = _splitter(stored(lines.mapInPandas(cut, REST).distinct()))
        return inner.members(), inner

    links = bucket_links(rows.select("bucket", "node", "lead"), marks, may_be_near, verified, split)
    dropped(rows, content)
    return links.select("line_a", "line_b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and ``n_lines``,
    ``n_removed`` and ``n_near`` (these replace columns of the same names).

    Lines are what lies between line feeds. Lines that are equal, or linked by a chain
    of near lines (``CHARACTER_EDITS``, ``WORD_EDITS``), form a class; the first line of
    the class stays (least id, null ids last, then the first place) and the others go.
    Lines of white space alone stay and are not counted as removed. ``n_near`` counts a
    row's lines that stay and stand for lines that are near but not equal. A null text stays null, with no lines;
    an empty one has one. Of rows with equal ids one comes first. An empty table gives
    no rows. Lines are told apart by 128-bit digests.
    """
    mine = ("n_lines", "n_removed", "n_near")
    names = [c for c in docs.columns if c not in mine]
    rows = numbered(docs)
    texts = rows.select(F.col(f"_all.`{id_col}`").alias("id"), F.col(f"_all.`{text_col}`").alias("text"), "row")
    texts = texts.where(F.col("text").isNotNull())
    with arrow_rows(docs.sparkSession, BATCH_TEXTS):
        links = near_lines(texts)
    classes = None if links.isEmpty() else components(links, "line_a", "line_b").withColumnRenamed("node", "line")
    every = texts.select("id", "row", F.posexplode(F.split("text", "\n")).alias("place", "content"))
    every = every.where(F.col("content").rlike(r"\S")).select("id", "row", "place", F.unhex(F.md5("content")).alias("line"))
    if classes is None:
        every = every.withColumn("component", F.lit(None).cast("binary"))
    else:
        small = classes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        every = every.join(F.broadcast(classes) if small else classes, "line", "left")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row", "place")).alias("first")
    heads = every.groupBy(F.coalesce("component", "line").alias("line")).agg(first, F.max(F.col("component").isNotNull()).alias("near"))
    # A text's lines that stay, by their places: one row for each text.
    heads = heads.groupBy(F.col("first.row").alias("row")).agg(F.collect_list("first.place").alias("stay"), F.count_if("near").alias("near"))
    # Lines are cut before the join, so that they are at hand as an array after it.
    cut = rows.select("_all", "row", F.split(F.col(f"_all.`{text_col}`"), "\n").alias("lines"))
    cut = cut.withColumn("_all", F.col("_all").dropFields(text_col)) if len(docs.columns) > 1 else cut
    blank = F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    joined = cut.withColumn("blank", blank).join(heads, "row", "left")
    places = F.sort_array(F.concat(F.coalesce("stay", F.array().cast("array<int>")), "blank"))
    made = joined.withColumn("left", F.transform(places, lambda i: F.get("lines", i)))
    count = F.coalesce(F.size("lines"), F.lit(0))
    return made.select(
        *[(F.array_join("left", "\n") if c == text_col else F.col(f"_all.`{c}`")).alias(c) for c in names],
        F.when(F.col("lines").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(count - F.size("left")).cast("long").alias("n_removed"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )
