"""Product codes of vectors by Lloyd rounds that keep heaps.

Each part of a vector has a codebook. A block of vectors keeps, for each entry, a heap of
the parts that it holds, keyed by how much the nearest other entry is farther away than
its own (lower bound less upper bound) plus the drift of entries so far. After entries have
moved, only parts whose key the cumulative drift has reached can have another nearest
entry: they are popped and compared with all entries again, exactly. All arithmetic that
decides is in integers.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_rows, dropped, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Steps of a unit: components become ``floor(SCALE * x)``.
SCALE = 1024
#: Vectors of a block, and blocks of an Arrow batch.
BLOCK_VECTORS, BATCH_BLOCKS = 2048, 8
#: Labels whose sums are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: What floating-point bounds may be off by, as a share.
SLACK = 1e-12


@dataclass
class Codebooks:
    """Entries as whole numbers, ``(parts, entries, width)``, what was summed into them, and
    how far each entry and the farthest other one have moved in all rounds so far."""

    entries: np.ndarray
    sums: np.ndarray = field(init=False)
    counts: np.ndarray = field(init=False)
    drift: np.ndarray = field(init=False)

    def __post_init__(self):
        parts, n, _ = self.entries.shape
        self.sums, self.counts = np.zeros_like(self.entries), np.zeros((parts, n), "i8")
        self.drift = np.zeros((parts, n))

    def moved(self, changes: pd.DataFrame) -> Codebooks:
        """The books after a round: every entry at the floor of its parts' mean."""
        parts, n, width = self.entries.shape
        new = Codebooks(self.entries.copy())
        new.sums, new.counts = self.sums.copy(), self.counts.copy()
        slot = changes["slot"].to_numpy("i8")
        new.counts.reshape(-1)[slot] += changes["n"].to_numpy("i8")
        new.sums.reshape(-1, width)[slot] += changes[[f"s{k}" for k in range(width)]].to_numpy("i8")
        used = new.counts > 0
        new.entries[used] = new.sums[used] // new.counts[used][:, None]
        step = np.sqrt(((new.entries - self.entries).astype("f8") ** 2).sum(2)) * (1 + SLACK)
        most = np.sort(step, axis=1)[:, ::-1]
        other = np.where(step == most[:, :1], most[:, 1:2] if n > 1 else 0.0, most[:, :1])
        other = np.where((step == most[:, :1]) & ((step == most[:, :1]).sum(1, keepdims=True) > 1), most[:, :1], other)
        new.drift = (self.drift + step + other) * (1 + SLACK)
        return new

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lower one of ties), its squared distance and that of
    the next nearest, exactly."""
    n, most = len(entries), max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    best, first, second = np.empty(len(x), "i8"), np.empty(len(x), "i8"), np.full(len(x), np.iinfo("i8").max)
    exact = 4 * x.shape[1] * int(most) ** 2 < 1 << 53  # products and sums are whole in a double
    step = 1 << 14 if exact else 256
    for k in range(0, len(x), step):
        some = x[k : k + step]
        if exact:
            a, b = some.astype("f8"), entries.astype("f8")
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            d = ((some[:, None, :] - entries[None]) ** 2).sum(2)
        z = d.argmin(1)
        rows = np.arange(len(some))
        best[k : k + step], first[k : k + step] = z, d[rows, z]
        if n > 1:
            second[k : k + step] = np.partition(d, 1, axis=1)[:, 1]
    return best, first, second


class Heaps:
    """A heap of ``(key, vector)`` for each entry of each part, laid out one after another."""

    def __init__(self, ends: np.ndarray, keys: np.ndarray, vectors: np.ndarray):
        self.ends, self.keys, self.vectors = ends, keys, vectors
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def empty(cls, slots: int) -> Heaps:
        return cls(np.zeros(slots, "i8"), np.zeros(0), np.zeros(0, "i4"))

    def heap(self, slot: int) -> list[tuple[float, int]]:
        found = self.open.get(slot)
        if found is None:
            a, z = int(self.ends[slot - 1]) if slot else 0, int(self.ends[slot])
            found = self.open[slot] = list(zip(self.keys[a:z].tolist(), self.vectors[a:z].tolist(), strict=True))
        return found

    def popped(self, drift: np.ndarray) -> list[list[int]]:
        """For each part the vectors whose key its entry's drift has reached. Heaps whose top is beyond stay shut."""
        parts, n = drift.shape
        begin = np.append(0, self.ends[:-1])
        full = np.flatnonzero(self.ends > begin)
        out: list[list[int]] = [[] for _ in range(parts)]
        for slot in full[self.keys[begin[full]] <= drift.ravel()[full]].tolist():
            heap, reach = self.heap(slot), drift[slot // n, slot % n]
            while heap and heap[0][0] <= reach:
                out[slot // n].append(heapq.heappop(heap)[1])
        return out

    def push(self, slots: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        for slot, key, v in zip(slots.tolist(), keys.tolist(), vectors.tolist(), strict=True):
            heapq.heappush(self.heap(slot), (key, v))

    def laid_out(self) -> Heaps:
        begin = np.append(0, self.ends[:-1])
        size = self.ends - begin
        for slot, heap in self.open.items():
            size[slot] = len(heap)
        ends = np.cumsum(size)
        keys, vectors = np.empty(ends[-1] if len(ends) else 0), np.empty(ends[-1] if len(ends) else 0, "i4")
        for slot in np.flatnonzero(size).tolist():
            a, z = ends[slot] - size[slot], ends[slot]
            if slot in self.open:
                keys[a:z], vectors[a:z] = zip(*self.open[slot], strict=True)
            else:
                keys[a:z], vectors[a:z] = (t[begin[slot] : self.ends[slot]] for t in (self.keys, self.vectors))
        return Heaps(ends, keys, vectors)


class Block:
    """Vectors of one block, their entries and heaps."""

    def __init__(self, x: np.ndarray, code: np.ndarray, heaps: Heaps):
        self.x, self.code, self.heaps, self.compared = x, code, heaps, 0

    @classmethod
    def new(cls, x: np.ndarray, books: Codebooks) -> Block:
        parts, n, _ = books.entries.shape
        return cls(x, np.full((len(x), parts), -1, "i2"), Heaps.empty(parts * n))

    def assign(self, books: Codebooks, first: bool = False) -> np.ndarray:
        """Compare with all entries the parts that may have another nearest one (``first``: all).
        Returns the change of counts and sums, a row for each entry of each part."""
        parts, n, width = books.entries.shape
        change = np.zeros((parts * n, width + 1), "i8")
        popped = [list(range(len(self.x)))] * parts if first else self.heaps.popped(books.drift)
        for p in range(parts):
            if not popped[p]:
                continue
            some = np.array(popped[p], "i8")
            self.compared += len(some)
            x = self.x[some, p * width : (p + 1) * width]
            best, near, far = nearest(x, books.entries[p])
            drift = books.drift[p, best]
            u, low = np.sqrt(near.astype("f8")), np.sqrt(far.astype("f8"))
            self.heaps.push(p * n + best, low - u + drift - SLACK * (low + u + drift), some)
            old = self.code[some, p]
            at = best != old
            left = at & (old >= 0)
            row = np.concatenate([np.ones((len(x), 1), "i8"), x], axis=1)
            np.add.at(change, p * n + best[at], row[at])
            np.subtract.at(change, p * n + old[left], row[left])
            self.code[some, p] = best
        self.heaps = self.heaps.laid_out()
        return change

    def errors(self, books: Codebooks) -> np.ndarray:
        parts, _, width = books.entries.shape
        own = np.concatenate([books.entries[p][self.code[:, p]] for p in range(parts)], axis=1)
        return ((self.x - own) ** 2).sum(1)


STATE = "ids array<{id}>, labels array<{label}>, x binary, code binary, ends binary, keys binary, vectors binary, slot array<int>, change array<array<long>>"


def _stored_block(ids: list, labels: list, block: Block, change: np.ndarray) -> dict:
    some = np.flatnonzero(change.any(1))
    return {
        "ids": ids, "labels": labels, "x": block.x.astype("<i8").tobytes(), "code": block.code.astype("<i2").tobytes(),
        "ends": block.heaps.ends.tobytes(), "keys": block.heaps.keys.tobytes(), "vectors": block.heaps.vectors.tobytes(),
        "slot": some.astype("i4"), "change": list(change[some]),
    }


def _read_block(row, dim: int, parts: int) -> Block:
    x = np.frombuffer(row.x, "<i8").reshape(-1, dim)
    code = np.frombuffer(row.code, "<i2").reshape(-1, parts).copy()
    return Block(x, code, Heaps(np.frombuffer(row.ends, "i8"), np.frombuffer(row.keys, "f8"), np.frombuffer(row.vectors, "i4")))


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values.astype(object).tolist()]


def whole_components(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has finite components only, with them as whole numbers in ``_x``."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & ~bad).withColumn("_x", F.transform(x, lambda v: v.cast("double") * F.lit(float(SCALE))))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Product codes of all vectors, with the codebooks they were made by.

    Components become ``floor(1024 * x)``; vectors are cut into equal consecutive parts. The
    codebooks start as the parts of the vectors with the smallest ids and go through
    ``rounds`` of Lloyd's steps: every part to its nearest entry (ties to the lower one),
    every used entry to the floor of its parts' mean. Then parts are assigned again.
    Returns ``id_col, label_col, code`` (two hex digits a part), ``error`` (squared
    distances), ``label_error`` (its sum over equal labels, nulls together) and
    ``codebooks_sha256``, a row for each row kept. Rows whose vector is null or has null or
    non-finite components go. Rows of another length than the one with the smallest id
    have (or, if that length can't be cut, all have) null ``code`` and ``error``. Equal ids
    are rows like others, in the order of their components; null ids come last. Components
    so large that squared distances would pass 64 bits count as the largest that do not.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kept = whole_components(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("_v")), "_v").select("id", "label", "_x")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    order = [F.col("id").asc_nulls_last(), "_x"]
    head = kept.orderBy(*order).first()
    dim = len(head["_x"]) if head else 0
    good = dim > 0 and dim % parts == 0
    fits = F.lit(good) & (F.size("_x") == dim)
    most = float(math.isqrt(((1 << 63) - 1) // max(dim, 1)) // 2)
    whole = kept.where(fits).withColumn("_x", F.transform("_x", lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v)))))
    odd = kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digest = None
    if good:
        first = np.array([r["_x"] for r in whole.orderBy(*order).limit(entries).collect()], "i8")
        books = Codebooks(np.stack(np.split(first, parts, axis=1)))
        with arrow_rows(spark, BLOCK_VECTORS):
            state = stored(_first_pass(whole, books, kinds))
        with arrow_rows(spark, BATCH_BLOCKS):
            for k in range(rounds):
                books = books.moved(_changes(state, dim // parts))
                before = state
                state = stored(_next_pass(before, books, kinds) if k + 1 < rounds else _last_pass(before, books, kinds))
                dropped(before)
            if not rounds:
                before, state = state, stored(_last_pass(state, books, kinds))
                dropped(before)
        odd, digest = state.unionByName(odd), books.digest()
    totals = odd.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    coded, totals = odd.alias("c"), totals.alias("t")
    joined = coded.join(totals, F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select(F.col("c.id").alias(id_col), F.col("c.label").alias(label_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _first_pass(rows: DataFrame, books: Codebooks, kinds: dict[str, str]) -> DataFrame:
    """Blocks of vectors with their first entries."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK_VECTORS):
                some = batch.iloc[k : k + BLOCK_VECTORS]
                block = Block.new(np.stack(some["_x"].to_list()).astype("i8"), books)
                change = block.assign(books, first=True)
                yield pd.DataFrame([_stored_block(_plain(some["id"]), _plain(some["label"]), block, change)])

    return rows.mapInPandas(build, STATE.format(**kinds))


def _next_pass(state: DataFrame, books: Codebooks, kinds: dict[str, str]) -> DataFrame:
    parts, _, width = books.entries.shape

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = _read_block(row, parts * width, parts)
                change = block.assign(books)
                yield pd.DataFrame([_stored_block(row.ids, row.labels, block, change)])

    return state.mapInPandas(go_on, STATE.format(**kinds))


def _last_pass(state: DataFrame, books: Codebooks, kinds: dict[str, str]) -> DataFrame:
    parts, _, width = books.entries.shape

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = _read_block(row, parts * width, parts)
                block.assign(books)
                codes = ["".join(f"{c:02x}" for c in code) for code in block.code.tolist()]
                yield pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "label": pd.Series(list(row.labels), dtype=object), "code": codes, "error": block.errors(books)})

    kept = state.select("ids", "labels", "x", "code", "ends", "keys", "vectors")
    return kept.mapInPandas(finish, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _changes(state: DataFrame, width: int) -> pd.DataFrame:
    """What a round changes of each entry's count and sums: a row for each entry at most."""
    rows = state.select(F.explode(F.arrays_zip("slot", "change")).alias("c")).select("c.slot", "c.change")
    sums = [F.sum(F.col("change")[0]).alias("n"), *(F.sum(F.col("change")[k + 1]).alias(f"s{k}") for k in range(width))]
    return rows.groupBy("slot").agg(*sums).toPandas()
