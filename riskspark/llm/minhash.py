"""Near-duplicate documents by BagMinHash.

A text is the multiset of its five-word shingles. For every shingle a hierarchy of
Poisson processes runs over the discretised weights: one process for the first unit and
one for each further octave of the weight, whose points carry a weight level and count
only below the shingle's own weight. Points are drawn in time order until all registers
of the text are filled, so a register's earliest point is equal in two texts with a
chance equal to their weighted Jaccard similarity. Registers are banded, and texts that
share a band are verified by their multiset overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_rows, checkpointed, dropped, numbered, own_worker, plain_text, stored
from riskspark.llm.graph import bucket_links, components
from riskspark.llm.substrings import hashed_documents, mixed

WORDS, SIMILAR = 5, 0.8
REGISTERS, BANDS, ROWS = 128, 64, 9
#: The registers of each band.
BAND_REGISTERS = np.stack([np.random.default_rng(k).permutation(REGISTERS)[:ROWS] for k in range(BANDS)])
#: Time limit of the first try, in mean times until a register fills (besides ln REGISTERS).
SLACK = 4.0
#: 64-bit words of the parities by which multisets that are too unlike are told apart.
PARITY_WORDS = 8
#: Rows whose numbers are broadcast at most.
BROADCAST_ROWS = 500_000
#: Texts (and their characters) whose points are drawn together, and pairs of multisets that a batch holds.
BLOCK_TEXTS, BLOCK_CHARS, BATCH_PAIRS = 256, 1 << 20, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count of each distinct shingle, sorted. A text of fewer
    words has all of them as its one shingle; a text without words has none."""
    codes, counts = hashed_documents(texts)
    starts = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded = np.concatenate([codes, np.zeros(words, "u8")])
    short = counts[of] < words
    h = np.zeros(len(at), "u8")
    for k in range(words):
        word = padded[at + k]
        if short.any():
            word = np.where(short & (k >= counts[of]), np.uint64(k), word)
        h = h * _STEP + word
    h = mixed(h)
    by = np.lexsort((h, of))
    of, h = of[by], h[by]
    first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(h, prepend=~h[:1]) != 0))
    return of[first], h[first], np.diff(np.append(first, len(h)))


def signatures(of: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """``texts x REGISTERS`` samples; rows of texts without shingles are zero."""
    out = np.zeros((texts, REGISTERS), "u8")
    total = np.bincount(of, count, texts)
    octaves = [(of, shingle, np.ones(len(of)), np.zeros(len(of)), count)]
    k = 1
    while (more := count > 1 << (k - 1)).any():
        low = float(1 << (k - 1))
        octaves.append((of[more], mixed(shingle[more] + np.full(1, k, "u8") * _ODD), np.full(more.sum(), low), np.full(more.sum(), low), count[more]))
        k += 1
    doc, seed, rate, low, weight = (np.concatenate(x) for x in zip(*octaves, strict=True))
    slack, left = SLACK, total > 0
    while left.any():
        limit = np.zeros(texts)
        limit[left] = REGISTERS * (np.log(REGISTERS) + slack) / total[left]
        use = left[doc]
        d, s, r, w, lo = doc[use], seed[use], rate[use], weight[use], low[use]
        time, at = np.zeros(len(d)), np.zeros(1, "u8")
        best = np.full(texts * REGISTERS, np.inf)
        found = []
        while len(d):
            at = at + np.uint64(1)
            h = mixed(s + at * _STEP)
            time = time - np.log(((h >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / r
            ok = time <= limit[d]
            d, s, r, w, lo, time, h = d[ok], s[ok], r[ok], w[ok], lo[ok], time[ok], mixed(h[ok] * _ODD)
            # The level of a point is uniform in its octave; points above the weight do not count.
            level = lo + r * ((h >> np.uint64(32)).astype("f8") * 2.0**-32)
            hit = level < w
            cell = (d * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype("i8"))[hit]
            np.minimum.at(best, cell, time[hit])
            found.append((cell, time[hit], h[hit]))
        for cell, t, h in found:
            win = t == best[cell]
            out.reshape(-1)[cell[win]] = mixed(h[win])
        full = np.isfinite(best.reshape(texts, REGISTERS)).all(1)
        left = left & ~full
        slack *= 4
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of the registers of each band."""
    h = np.zeros((len(signature), BANDS), "u8")
    for k in range(ROWS):
        h = mixed(h * _STEP + signature[:, BAND_REGISTERS[:, k]])
    return mixed(h + np.arange(BANDS, dtype="u8") * _ODD).view("i8")


def text_blocks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in runs of bounded size: a text has about ``REGISTERS * ln REGISTERS`` points, however short it is."""
    cut, size, n = 0, 0, 0
    for k, length in enumerate(batch["text"].str.len().tolist()):
        if n and (size + length > BLOCK_CHARS or n == BLOCK_TEXTS):
            yield batch.iloc[cut:k]
            cut, size, n = k, 0, 0
        size, n = size + length, n + 1
    if n:
        yield batch.iloc[cut:]


def multiset_units(of: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> list[np.ndarray]:
    """Each text's multiset as sorted 64-bit units, one for each shingle and number of its occurrence."""
    unit = np.repeat(shingle, count)
    number = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    unit, doc = mixed(unit + number.astype("u8") * _ODD), np.repeat(of, count)
    unit = unit[np.lexsort((unit, doc))]
    ends = np.searchsorted(doc, np.arange(texts + 1))
    return [unit[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def packed_units(units: np.ndarray) -> bytes:
    return np.sort(units).astype("<u8").tobytes()


def parities(units: list[np.ndarray]) -> np.ndarray:
    """For each multiset, whether an odd number of its units falls in each of the
    ``64 * PARITY_WORDS`` bins. Multisets that differ by ``n`` units differ in ``n`` bins at most."""
    bins = 64 * PARITY_WORDS
    of = np.repeat(np.arange(len(units)) * bins, [len(u) for u in units])
    at = (np.concatenate([*units, np.zeros(0, "u8")]) % np.uint64(bins)).astype("i8")
    odd = (np.bincount(of + at, minlength=len(units) * bins) & 1).astype("u1")
    return np.packbits(odd).view("<i8").reshape(-1, PARITY_WORDS)


def may_be_similar(similar: float) -> Callable[[Column, Column], Column]:
    """Whether two multisets' sizes and parities leave the asked similarity possible:
    with ``n`` units in one of them alone, they have at most ``(x + y - n) / (x + y + n)``."""

    def of(a: Column, b: Column) -> Column:
        apart = F.abs(a["n"] - b["n"])
        odd = sum((F.bit_count(a[f"p{k}"].bitwiseXOR(b[f"p{k}"])) for k in range(PARITY_WORDS)), F.lit(0))
        return F.greatest(apart, odd.cast("long")) * (1 + similar) <= (a["n"] + b["n"]) * (1 - similar) + 1e-6

    return of


def overlap_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets; two empty ones are equal."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common = int((y[np.searchsorted(y, x).clip(max=len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``id_col, class_id, class_size, kept``: the near-duplicate class of every row.

    Classes are the connected components of texts whose multisets of five-word shingles
    have a weighted Jaccard similarity of ``similar`` or more. ``class_id`` is the least
    id of the class; one row of the class is ``kept`` (the least id; of equal ids, one).
    Equal multisets are one class without being compared, as are texts without words
    (null texts too). Null ids are classed like others; a class of null ids alone has a
    null ``class_id``. Repeated rows stay repeated; other columns are not read.

    Texts that share a band are compared unless they are already in one class
    (:func:`riskspark.llm.graph.bucket_links`). Shingles are compared by 64-bit hashes.
    """
    return _classes(numbered(docs), id_col, text_col, similar).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps."""
    rows = numbered(docs)
    kept = _classes(rows, id_col, text_col, similar).where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"_all.`{c}`").alias(c) for c in docs.columns])


def _classes(rows: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """``row, id, class_id, class_size, kept`` of numbered rows."""
    rows = rows.select(F.col(f"_all.`{id_col}`").alias("id"), plain_text(f"_all.`{text_col}`").alias("text"), "row")
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_worker("minhash")
        for batch in batches:
            for part in text_blocks(batch):
                texts = part["text"].tolist()
                sets = shingle_sets(texts)
                keys = [xxhash.xxh3_128_hexdigest(u.tobytes()) for u in multiset_units(*sets, len(texts))]
                some = np.bincount(sets[0], minlength=len(texts)) > 0
                hashes = bands(signatures(*sets, len(texts)))
                rows_bands = [list(x) if n else [] for x, n in zip(hashes, some, strict=True)]
                yield pd.DataFrame({"id": part["id"], "row": part["row"], "key": keys, "bands": rows_bands})

    sketched = checkpointed(rows.mapInPandas(sketch, f"id {kind}, row long, key string, bands array<long>"))
    # Of equal multisets one row is compared, from here on by its number.
    unique = sketched.groupBy("key").agg(F.min("row").alias("node"), F.first("bands").alias("bands"))
    bucket = unique.select("node", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = stored(bucket.join(shared, "bucket", "left_semi").select("bucket", "node", F.lit(True).alias("lead")))
    nodes = members.select(F.col("node").alias("row")).distinct()
    if nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)

    mark = [f"p{k}" for k in range(PARITY_WORDS)]

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in text_blocks(batch):
                texts = part["text"].tolist()
                units = multiset_units(*shingle_sets(texts), len(texts))
                out = pd.DataFrame(parities(units), columns=mark)
                yield out.assign(node=part["row"].to_numpy(), n=[len(u) for u in units], packed=[packed_units(u) for u in units])

    kinds = "node long, n long, packed binary, " + ", ".join(f"{p} long" for p in mark)
    sets = rows.select("row", "text").join(nodes, "row", "left_semi").mapInPandas(sets_of, kinds)
    sets = stored(sets.select("node", "packed", F.struct("n", *mark).alias("mark")))
    may_link = may_be_similar(similar)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([overlap_similarity(x, y) >= similar for x, y in zip(a, b, strict=True)], dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").where(alike("packed_a", "packed_b")).drop("packed_a", "packed_b")

    with arrow_rows(rows.sparkSession, BATCH_PAIRS):
        links = bucket_links(members, sets.select("node", "mark"), may_link, verified)
    found = None if links.isEmpty() else components(links, "a", "b")
    dropped(members, sets)
    classes = sketched.select("id", "row", "key").join(unique.select("key", "node"), "key")
    if found is None:
        classes = classes.withColumn("component", F.col("node"))
    else:
        classes = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Class members are counted before they meet, so a large class is no large task.
    summary = classes.groupBy("component").agg(
        F.min("id").alias("class_id"),
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("first"),
    )
    return classes.join(summary, "component").select(
        "row", "id", "class_id", "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )
