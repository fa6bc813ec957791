"""Substring deduplication by prefix-partitioned suffix trees over words.

Every word starts a suffix. Suffixes are split into memory-sized groups by prefixes of
variable length: a prefix whose group would be too large is lengthened. Each group is a
subtree. Sorting its suffixes by the path down to the asked depth yields the internal
nodes there: each one is a repeat, and the least document among its leaves is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import plain_text

#: Words of a window.
WINDOW = 13
#: Lengths of the prefixes, in words; the last is the window itself.
PREFIXES = (1, 2, 4)
#: Suffixes of a group, at most (but for repeats of one window, which are dealt apart).
GROUP_SUFFIXES = 4_000_000
#: Documents for each slot of the prefix counters, and the least and most slots.
SLOT_DOCUMENTS, LEAST_SLOTS, MOST_SLOTS = 256, 1 << 8, 1 << 20
#: Documents of a block whose repeats are gathered together, on average.
BLOCK_DOCUMENTS = 2048
#: Bytes of a window's hash that travel with a leaf. With the group they make the path;
#: two unlike windows of a group of a million are taken for one with odds of 1 in 70,000.
PATH_BYTES = 7
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: Characters of the texts whose suffixes are grouped together, about.
BLOCK_CHARACTERS = 1 << 22

#: White space between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(2026)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, "u8") * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(int(_BASE), PIECE + 1)
_INVERSE = _powers(pow(int(_BASE), -1, 1 << 64), PIECE + 1)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of one piece of UTF-8 text (at most ``PIECE`` bytes)."""
    b = np.frombuffer(raw, "u1")
    word = ~SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, "u8")
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=total[1:])
    return mixed((total[end] - total[start]) * _INVERSE[start])


def hashed_documents(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words. Short texts
    are hashed together; long ones in pieces cut at spaces."""
    hashes, counts, held, size = [], np.zeros(len(texts), "i8"), [], 0

    def flush() -> None:
        if held:
            joined = b"\n".join(raw for _, raw in held)
            hashes.append(word_hashes(joined))
            ends = np.cumsum([len(raw) + 1 for _, raw in held])
            word = ~SPACE[np.frombuffer(joined, "u1")]
            starts = np.flatnonzero(word & np.append(True, ~word[:-1])) if len(word) else np.zeros(0, int)
            n = np.diff(np.searchsorted(starts, ends), prepend=0)
            for (i, _), k in zip(held, n, strict=True):
                counts[i] += k
            held.clear()

    for i, text in enumerate(texts):
        raw = text.encode()
        while len(raw) > PIECE // 2:
            cut = max(map(raw[: PIECE // 2].rfind, (b" ", b"\n", b"\t")))
            if cut <= 0:  # one endless word: cut after it, or hash it whole
                nexts = [k for k in map(raw.find, (b" ", b"\n", b"\t")) if k >= 0]
                cut = min(nexts, default=len(raw))
                if cut > PIECE // 2:
                    flush()
                    digest = hashlib.blake2b(raw[:cut].strip(), digest_size=8).digest()
                    hashes.append(np.frombuffer(digest, "<u8"))
                    counts[i] += 1
                    raw, size = raw[cut:], 0
                    continue
            flush()
            held.append((i, raw[: max(cut, 1)]))
            flush()
            raw, size = raw[max(cut, 1) :], 0
        if size + len(raw) + 1 > PIECE:
            flush()
            size = 0
        held.append((i, raw))
        size += len(raw) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, "u8")), counts


def paths(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text number and place of every suffix of ``window`` words or more, and the hashes
    of its first words: one array for each prefix length, last the window's."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, "i8")
    n = np.maximum(counts - window + 1, 0)
    of = np.repeat(np.arange(len(counts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(starts, n) + place
    out, h = [], np.zeros(max(len(words) - window + 1, 0), "u8")
    for k in range(window):
        h = h * _BASE + words[k : k + len(h)]
        if k + 1 in PREFIXES and k + 1 < window:
            out.append(mixed(h)[at])
    out.append(mixed(h)[at])
    return of, place, out


def blocks_of_texts(texts: list[str], keys: list) -> Iterator[tuple[list[str], np.ndarray]]:
    """Runs of texts of a bounded size, without null keys."""
    held, ids, size = [], [], 0
    for text, key in zip(texts, keys, strict=True):
        if key is None or key != key:
            continue
        held.append(text)
        ids.append(int(key))
        size += len(text)
        if size > BLOCK_CHARACTERS:
            yield held, np.array(ids, "i8")
            held, ids, size = [], [], 0
    if held:
        yield held, np.array(ids, "i8")


def packed(doc: np.ndarray, place: np.ndarray, path: np.ndarray | None = None) -> bytes:
    """Leaves sorted by document and place, as differences, compressed."""
    step = np.diff(doc, prepend=0)
    at = np.where(step == 0, np.diff(place, prepend=0), place).astype("u4")
    wide = zstandard.compress(step.astype("i8").tobytes() + at.tobytes(), 1)
    head = np.array([len(doc), len(wide)], "<u4").tobytes()
    if path is None:
        return head + wide
    return head + wide + path.astype("<u8").view("u1").reshape(-1, 8)[:, 8 - PATH_BYTES :].tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    wide = zstandard.decompress(data[8 : 8 + m])
    step, at = np.frombuffer(wide, "i8", n), np.frombuffer(wide, "u4", n, 8 * n).astype("i8")
    # Places are differences inside a document: sum them, less the sum before its first one.
    first = np.flatnonzero(np.append(True, step[1:] != 0)) if n else np.zeros(0, int)
    total = np.cumsum(at)
    base = np.repeat((total - at)[first], np.diff(np.append(first, n)))
    path = np.zeros((n, 8), "u1")
    if len(data) > 8 + m:
        path[:, 8 - PATH_BYTES :] = np.frombuffer(data, "u1", offset=8 + m).reshape(n, PATH_BYTES)
    return np.cumsum(step), total - base, path.view("<u8").ravel()


class Prefixes:
    """The group of every suffix, by the counters of the prefix slots."""

    def __init__(self, slots: int, counts: np.ndarray, limit: int):
        self.slots, self.fits = slots, counts <= limit
        self.crowded = counts[-1] > limit

    def groups(self, hashes: list[np.ndarray]) -> np.ndarray:
        """The shortest prefix whose slot fits; windows of crowded slots get -1."""
        mask = np.uint64(self.slots - 1)
        group = np.full(len(hashes[0]), -1, "i8")
        for level, h in reversed(list(enumerate(hashes))):
            slot = (h & mask).astype("i8")
            group = np.where(self.fits[level][slot], level * self.slots + slot, group)
        return group


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``block, repeats``: of every ``(id, text)``, the windows whose words also start
    in a document with a smaller id. A row holds packed (id, place) pairs of one block
    of documents (:func:`unpacked`); a document's pairs lie in one block."""
    spark = docs.sparkSession
    n = docs.count()
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (n // SLOT_DOCUMENTS).bit_length()))
    blocks = max(1, -(-n // BLOCK_DOCUMENTS))
    levels = len([k for k in PREFIXES if k < window]) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((levels, slots), "i8")
        for batch in batches:
            for texts, _ in blocks_of_texts(batch["text"].tolist(), batch["id"].tolist()):
                for level, h in enumerate(paths(*hashed_documents(texts), window)[2]):
                    total[level] += np.bincount((h & np.uint64(slots - 1)).astype("i8"), minlength=slots)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total.ravel()[at]})

    rows = docs.mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(levels * slots, "i8")
    counts[rows["slot"].to_numpy("i8")] = rows["n"].to_numpy("i8")
    counts = counts.reshape(levels, slots)
    limit = min(GROUP_SUFFIXES, max(1024, 2 * int(counts[0].sum()) // slots))
    # The last prefix is the window: more than the others, its slots may hold a group's most.
    prefixes = Prefixes(slots, counts, limit)
    prefixes.fits[-1] = counts[-1] <= GROUP_SUFFIXES
    sent = spark.sparkContext.broadcast(prefixes)

    def leaves(batches: Iterator[pd.DataFrame], crowded: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts, ids in blocks_of_texts(batch["text"].tolist(), batch["id"].tolist()):
                order = np.argsort(ids, kind="stable")
                of, place, hashes = paths(*hashed_documents([texts[k] for k in order]), window)
                doc, group, path = ids[order][of], sent.value.groups(hashes), hashes[-1]
                if crowded:
                    some = group < 0
                    yield pd.DataFrame({"path": path[some].view("i8"), "id": doc[some], "place": place[some]})
                    continue
                by = np.argsort(group, kind="stable")
                by = by[np.searchsorted(group[by], 0) :]
                cuts = np.flatnonzero(np.diff(group[by], prepend=-1))
                parts = np.split(by, cuts[1:]) if len(by) else []
                yield pd.DataFrame(
                    {
                        "part": group[by[cuts]],
                        "leaves": [packed(doc[p], place[p], path[p]) for p in parts],
                    }
                )

    def subtree(group: pd.DataFrame) -> pd.DataFrame:
        doc, place, path = (np.concatenate(x) for x in zip(*map(unpacked, group["leaves"]), strict=True))
        by = np.lexsort((doc, path))
        doc, place, path = doc[by], place[by], path[by]
        node = np.cumsum(np.diff(path, prepend=path[:1]) != 0)
        least = doc[np.flatnonzero(np.diff(node, prepend=-1))]
        again = doc > least[node]
        return _by_block(doc[again], place[again], blocks)

    found = docs.mapInPandas(lambda b: leaves(b, False), "part long, leaves binary")
    found = found.groupBy("part").applyInPandas(subtree, "block long, repeats binary")
    if prefixes.crowded.any() and (counts[-1] > GROUP_SUFFIXES).any():
        # Windows that repeat more often than a group holds: only their least document
        # is gathered, and met again by salted parts of their places.
        every = docs.mapInPandas(lambda b: leaves(b, True), "path long, id long, place long")
        every = every.withColumn("salt", F.pmod(F.xxhash64("id", "place"), F.lit(64)))
        least = every.groupBy("path").agg(F.min("id").alias("least"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
        again = every.join(least, ["path", "salt"]).where("id > least").select("id", "place")

        def pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                doc, place = batch["id"].to_numpy("i8"), batch["place"].to_numpy("i8")
                yield _by_block(doc, place, blocks)

        found = found.unionByName(again.mapInPandas(pack_rows, "block long, repeats binary"))
    return found


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.astype("u8") * _BASE) % np.uint64(blocks)).astype("i8")


def _by_block(doc: np.ndarray, place: np.ndarray, blocks: int) -> pd.DataFrame:
    block = block_of(doc, blocks)
    by = np.lexsort((place, doc, block))
    doc, place, block = doc[by], place[by], block[by]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(cuts[1:], len(block))[: len(cuts)]
    data = [packed(doc[a:b], place[a:b]) for a, b in zip(cuts, ends, strict=True)]
    return pd.DataFrame({"block": block[cuts], "repeats": data})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word that a repeated window covers.

    Words are runs of anything but ASCII white space, unchanged. A window is ``window``
    consecutive words of a document; it is a repeat if its words also start in a
    document with a smaller id. Windows are judged on the input. Returns ``id_col,
    n_words, n_removed, kept_text`` (kept words joined by single spaces), a row for
    each input row. Null texts have no words. Ids are integers; rows with equal ids do
    not repeat each other, and rows with a null id are kept whole and repeat nothing.
    An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), plain_text(text_col).alias("text"))
    blocks = max(1, -(-rows.count() // BLOCK_DOCUMENTS))
    found = repeated_windows(rows, window)

    @F.pandas_udf("long")
    def block(ids: pd.Series) -> pd.Series:
        some = ids.notna()
        return pd.Series(np.where(some, block_of(ids.fillna(0).astype("i8").to_numpy(), blocks), -1))

    def kept(texts: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        doc, place = np.zeros(0, "i8"), np.zeros(0, "i8")
        if len(repeats):
            doc, place, _ = (np.concatenate(x) for x in zip(*map(unpacked, repeats["repeats"]), strict=True))
        by = np.argsort(doc, kind="stable")
        doc, place = doc[by], place[by]
        out = []
        for key, text in zip(texts["id"].tolist(), texts["text"].tolist(), strict=True):
            words = text.encode().split()
            n, removed = len(words), 0
            if key is not None and key == key:
                a, b = np.searchsorted(doc, [key, key + 1])
                if a < b:
                    cover = np.zeros(n + window, "i4")
                    np.add.at(cover, place[a:b], 1)
                    np.add.at(cover, place[a:b] + window, -1)
                    keep = np.cumsum(cover)[:n] == 0
                    words = list(compress(words, keep.tolist()))
                    removed = n - len(words)
            out.append((key, n, removed, b" ".join(words).decode()))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_text"]).astype({"id": "Int64"})

    left = rows.withColumn("block", block("id")).groupBy("block")
    result = left.cogroup(found.groupBy("block")).applyInPandas(
        kept, "id long, n_words long, n_removed long, kept_text string"
    )
    return result.withColumnRenamed("id", id_col)
