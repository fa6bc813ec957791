"""Removal of repeated bytes by the common-prefix interval tree of an enhanced suffix array.

The suffixes of all texts are dealt to subtrees by content: a window of ``LEAST`` bytes
goes where the least k-mer inside it (by a hash) sends it, so equal windows of any two
documents meet. Neighbouring windows mostly share that k-mer and travel as one segment of
text. In a subtree the suffixes are put in order by their bytes, common-prefix lengths of
neighbours make the enhanced array, and one scan with a stack yields its intervals: the
internal nodes of the suffix tree. An interval whose suffixes are preceded by different
bytes cannot be extended to the left: it is a maximal repeat, and all suffixes in it are
its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import numbered, plain_text, stored

#: Bytes of the shortest repeat.
LEAST = 50
#: Bytes of the k-mers that deal windows out.
KMER = 16
#: Bytes of text that are cut into segments together, and that a worker hashes at once.
BLOCK_BYTES, PIECE = 1 << 22, 1 << 18
#: Bytes of segments in a subtree, on average, and at most; windows of fuller subtrees are
#: dealt out one by one.
SUBTREE_BYTES, CROWDED_BYTES = 1 << 24, 1 << 26
#: Counters of subtrees, at most; from there on subtrees grow.
MOST_SUBTREES = 1 << 20
#: Bytes of segments for each byte of text, about.
SPREAD = 4
#: Bytes of texts whose repeats are gathered together, on average.
GATHERED_BYTES = 1 << 23
#: Suffixes whose order is made together, about.
ORDERED = 1 << 18

_POSITION = 20  # bits of a packed k-mer that hold its place
_A, _B, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_BYTE = np.random.default_rng(2026).integers(0, 1 << 63, 256, "u8") * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(int(_A), PIECE + 1024)
_INVERSE = _powers(pow(int(_A), -1, 1 << 64), PIECE + 1024)


def _hashed(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of at most ``PIECE`` + 1023 bytes."""
    total = np.zeros(len(b) + 1, "u8")
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=total[1:])
    h = (total[stop] - total[start]) * _INVERSE[start]
    return (h ^ (h >> np.uint64(31))) * _MIX


def _least_kmers(b: np.ndarray, least: int) -> np.ndarray:
    """For each window of ``least`` bytes the hash of its least k-mer, with its place."""
    n = len(b) - KMER + 1
    u = np.ndarray((n + 8,), "<u8", b, 0, (1,))
    m = (u[:n] * _A) ^ (u[8:] * _B)
    m ^= m >> np.uint64(29)
    m *= _MIX
    m ^= m >> np.uint64(32)
    m >>= np.uint64(_POSITION)
    m <<= np.uint64(_POSITION)
    m |= np.arange(n, dtype="u8")
    width, done = least - KMER + 1, 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(m) - (width - done)], m[width - done :]) if done < width else m


def segments(raw: bytes, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their least k-mer, of texts joined in ``raw`` that end
    at ``ends``: first and last-but-one window, text number, k-mer and hash of the run's bytes."""
    lasts = ends - least + 1  # a text's windows end here
    inner = np.unique(np.concatenate([[0], ends, lasts[lasts > 0]]))
    found = []
    for p in range(0, len(raw) - least + 1, PIECE):
        b = np.frombuffer(raw, "u1", min(PIECE + least - 1, len(raw) - p), p)
        m = _least_kmers(b, least)
        a, z = np.searchsorted(inner, [p, p + len(m)])
        cut = np.unique(np.concatenate([[p], np.flatnonzero(m[1:] != m[:-1]) + (p + 1), inner[a:z]]))
        stop = np.append(cut[1:], p + len(m))
        text = np.searchsorted(ends, cut, "right")
        some = stop <= lasts[text]
        cut, stop, text = cut[some], stop[some], text[some]
        found.append((cut, stop, text, m[cut - p] >> np.uint64(_POSITION), _hashed(b, cut - p, stop - p + least - 1)))
    if not found:
        return (*(np.zeros(0, "i8") for _ in range(3)), np.zeros(0, "u8"), np.zeros(0, "u8"))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def equal_runs(digest: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each slice of ``raw`` the number of the first one with the same bytes."""
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    again = np.flatnonzero(d[1:] == d[:-1]) + 1
    first = np.arange(len(d))
    first[again] = 0
    first = order[np.maximum.accumulate(first)]
    of = np.arange(len(d))
    of[order] = first
    some = order[again]
    other = of[some]
    same = [raw[a:b] == raw[c:d] for a, b, c, d in zip(start[some].tolist(), stop[some].tolist(), start[other].tolist(), stop[other].tolist(), strict=True)]
    apart = some[~np.array(same, bool)]  # unlike bytes of one hash
    of[apart] = apart
    return of


def common_prefixes(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of neighbours; words are eight bytes each, big-endian."""
    x = words[1:] ^ words[:-1]
    differs = x != 0
    at = differs.argmax(1)
    w = x[np.arange(len(x)), at]
    inside = np.zeros(len(x), "i8")
    for k in range(1, 8):
        inside += w < np.uint64(1 << (64 - 8 * k))
    n = np.where(differs.any(1), 8 * at + inside, 1 << 30)
    return np.minimum(n, np.minimum(length[1:], length[:-1]))


def interval_tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of suffixes with a common prefix of ``least`` or more, children before
    parents: depth, first and last suffix. ``lcp[i]`` is of suffixes ``i`` and ``i + 1``."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # depth and first suffix of the open intervals
    some = np.flatnonzero(lcp >= least)
    last = -2
    for i, depth in zip(some.tolist(), lcp[some].tolist(), strict=True):
        if i != last + 1:
            while stack:
                out.append((*stack.pop(), last + 1))
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
        last = i
    while stack:
        out.append((*stack.pop(), last + 1))
    return tuple(np.array(out, "i8").reshape(-1, 3).T)


def ordered_suffixes(raw: np.ndarray, at: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes ``at`` in the order of their bytes up to ``stop``, in slices that share
    no first eight bytes, with the common-prefix lengths of neighbours. A suffix that ends
    comes before those that go on. ``raw`` has 16 bytes to spare."""
    if not len(at):
        return
    wide = np.ndarray((len(raw) - 8,), ">u8", raw, 0, (1,))
    first = wide[at].astype("u8")
    order = np.argsort(first, kind="stable")
    heads = np.flatnonzero(np.diff(first[order], prepend=first[order[0]] + np.uint64(1)) != 0)
    cuts, begin = [], 0
    for end in [*heads[1:].tolist(), len(order)]:
        if end - begin >= ORDERED or end == len(order):
            cuts.append((begin, end))
            begin = end
    n_words = int(-(-(stop - at).max() // 8))
    mask = np.array([0, *(((1 << (8 * k)) - 1) << (64 - 8 * k) for k in range(1, 9))], "u8")
    for begin, end in cuts:
        some = order[begin:end]
        length = (stop - at)[some]
        words = np.empty((len(some), n_words), "u8")
        for k in range(n_words):
            left = np.clip(length - 8 * k, 0, 8)
            words[:, k] = wide[np.minimum(at[some] + 8 * k, len(wide) - 1)].astype("u8") & mask[left]
        by = np.lexsort((length, *words.T[::-1]))
        yield some[by], common_prefixes(words[by], length[by])


class Segments:
    """Distinct segments of text and where they occur: ``doc`` and ``row`` of the document
    and ``start`` in it, for segment ``of``."""

    def __init__(self, raw: bytes, size: np.ndarray, of: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray):
        self.raw, self.size, self.of, self.doc, self.row, self.start = raw, size, of, doc, row, start

    def packed(self) -> bytes:
        counts = np.bincount(self.of, minlength=len(self.size)).astype("u4")
        arrays = [self.size.astype("u1"), counts, np.diff(self.doc, prepend=0).astype("i8"), np.diff(self.row, prepend=0).astype("i8"), self.start.astype("u4")]
        head = np.array([len(self.size), len(self.of)], "<u4").tobytes()
        return zstandard.compress(head + b"".join(a.tobytes() for a in arrays) + self.raw, 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Segments:
        data = zstandard.decompress(data)
        n, k = np.frombuffer(data, "<u4", 2).tolist()
        at, out = 8, []
        for kind, m in (("u1", n), ("u4", n), ("i8", k), ("i8", k), ("u4", k)):
            out.append(np.frombuffer(data, kind, m, at).astype("i8"))
            at += m * np.dtype(kind).itemsize
        size, counts, doc, row, start = out
        return cls(data[at:], size, np.repeat(np.arange(n), counts), np.cumsum(doc), np.cumsum(row), start)

    @classmethod
    def joined(cls, parts: list[Segments], least: int) -> Segments:
        """All parts as one, equal segments once; occurrences by segment, document, row and start."""
        raw = b"".join(p.raw for p in parts)
        size = np.concatenate([p.size for p in parts])
        before = np.cumsum([0, *(len(p.size) for p in parts)])
        of = np.concatenate([p.of + b for p, b in zip(parts, before, strict=False)])
        stop = np.cumsum(size)
        start = stop - size
        same = equal_runs(_digests(raw, start, stop), raw, start, stop)
        first = np.flatnonzero(same == np.arange(len(same)))
        number = np.zeros(len(size), "i8")
        number[first] = np.arange(len(first))
        if len(first) < len(size):
            raw = b"".join([raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
        doc, row, place = (np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "row", "start"))
        of = number[same[of]]
        by = np.lexsort((place, row, doc, of))
        return cls(raw, size[first], of[by], doc[by], row[by], place[by])

    def take(self, some: np.ndarray) -> None:
        self.of, self.doc, self.row, self.start = self.of[some], self.doc[some], self.row[some], self.start[some]

    def least(self) -> np.ndarray:
        """Least document of each segment; occurrences are sorted."""
        return self.doc[np.searchsorted(self.of, np.arange(len(self.size)))]


def _digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out, k = np.empty(len(start), "u8"), 0
    while k < len(start):
        base = int(start[k])
        z = max(k + 1, int(np.searchsorted(stop, base + PIECE, "right")))
        b = np.frombuffer(raw, "u1", int(stop[z - 1]) - base, base)
        out[k:z] = _hashed(b, start[k:z] - base, stop[k:z] - base)
        k = z
    return out


def _repeated_windows(s: Segments, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and place in ``raw`` of the windows whose hash is there more than once:
    no other suffix can share ``least`` bytes with another one."""
    stop = np.cumsum(s.size)
    n = s.size - least + 1
    hashes, k = [], 0
    while k < len(n):
        base = int(stop[k] - s.size[k])
        z = max(k + 1, int(np.searchsorted(stop, base + PIECE, "right")))
        b = np.frombuffer(s.raw, "u1", int(stop[z - 1]) - base, base)
        at = np.arange(n[k:z].sum()) + np.repeat(stop[k:z] - s.size[k:z] - base - (np.cumsum(n[k:z]) - n[k:z]), n[k:z])
        hashes.append(_hashed(b, at, at + least))
        k = z
    h = np.concatenate(hashes) if hashes else np.zeros(0, "u8")
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    seen = np.zeros(1 << 20, bool)
    seen[twice >> np.uint64(44)] = True
    some = np.flatnonzero(seen[h >> np.uint64(44)])
    some = some[np.isin(h[some], twice)]
    before = np.cumsum(n) - n
    of = np.searchsorted(before, some, "right") - 1
    return of, some - before[of] + (stop - s.size)[of]


def repeats_of(s: Segments, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal repeats inside a subtree: of each slice of the suffix array the segments and
    offsets of all suffixes, and the intervals ``(depth, first, last)`` that no common byte extends to
    the left. A segment's edge counts as a byte of its own."""
    of, at = _repeated_windows(s, least)
    stop = np.cumsum(s.size)
    raw = np.frombuffer(s.raw + bytes(16), "u1")
    offset = at - (stop - s.size)[of]
    left = np.where(offset > 0, raw[at - 1].astype("i8"), -1 - np.arange(len(at)))
    for order, lcp in ordered_suffixes(raw, at, stop[of]):
        depth, first, last = interval_tree(lcp, least)
        changes = np.concatenate([[0], np.cumsum(np.diff(left[order]) != 0)])
        some = changes[last] > changes[first]
        yield of[order], offset[order], np.stack([depth, first, last])[:, some]


def _removed(s: Segments, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of what documents with smaller ids hold too."""
    doc = s.least()
    later = s.doc > doc[s.of]
    out = [(s.row[later], s.start[later], s.size[s.of[later]])]
    s.take(~later)
    begin = np.searchsorted(s.of, np.arange(len(s.size) + 1))
    for of, offset, (depth, first, last) in repeats_of(s, least):
        docs, reach = doc[of], np.zeros(len(of), "i8")
        for d, a, z in zip(depth.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            if z - a == 2:
                x, y = docs[a], docs[a + 1]
                if x != y:
                    k = a if x > y else a + 1
                    reach[k] = max(reach[k], d)
            else:
                some = docs[a:z]
                reach[a:z] = np.where(some > some.min(), np.maximum(reach[a:z], d), reach[a:z])
        hit = np.flatnonzero(reach)
        n = (begin[1:] - begin[:-1])[of[hit]]
        k = np.arange(n.sum()) + np.repeat(begin[of[hit]] - (np.cumsum(n) - n), n)
        hit = np.repeat(hit, n)
        out.append((s.row[k], s.start[k] + offset[hit], reach[hit]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _occurrences(s: Segments, least: int) -> pd.DataFrame:
    """A row for each occurrence of each maximal repeat."""
    begin = np.searchsorted(s.of, np.arange(len(s.size) + 1))
    frames, done = [], 0

    def add(of: np.ndarray, offset: np.ndarray, repeat: np.ndarray, length: np.ndarray) -> None:
        n = (begin[1:] - begin[:-1])[of]
        k = np.arange(n.sum()) + np.repeat(begin[of] - (np.cumsum(n) - n), n)
        frames.append({"repeat": np.repeat(repeat, n), "length": np.repeat(length, n), "doc": s.doc[k], "row": s.row[k], "start": s.start[k] + np.repeat(offset, n)})

    several = np.flatnonzero(begin[1:] - begin[:-1] > 1)  # whole segments that are equal
    add(several, np.zeros(len(several), "i8"), np.arange(len(several)), s.size[several])
    done = len(several)
    for of, offset, (depth, first, last) in repeats_of(s, least):
        n = last - first + 1
        k = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        add(of[k], offset[k], np.repeat(done + np.arange(len(n)), n), np.repeat(depth, n))
        done += len(n)
    return pd.DataFrame({name: np.concatenate([f[name] for f in frames]) for name in frames[0]})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to a bounded size, by ascending id: bytes, ends, ids and rows."""

    def joined() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        held.sort(key=lambda x: x[:2])
        ids, rows, raws = zip(*held, strict=True)
        return b"".join(raws), np.cumsum([len(r) for r in raws]), np.array(ids, "i8"), np.array(rows, "i8")

    held, size = [], 0
    for batch in batches:
        for key, row, text in zip(batch["id"].tolist(), batch["row"].tolist(), batch["text"].tolist(), strict=True):
            if key is None or key != key:
                continue
            raw = text.encode()
            if held and size + len(raw) > BLOCK_BYTES:
                yield joined()
                held, size = [], 0
            held.append((int(key), row, raw))
            size += len(raw)
    if held:
        yield joined()


class Subtrees:
    """The subtree of every segment, by its k-mer; those that are too full are none (-1)."""

    def __init__(self, n: int, size: np.ndarray, most: int):
        self.n, self.crowded = n, size > most

    def of(self, kmer: np.ndarray) -> np.ndarray:
        part = (kmer % np.uint64(self.n)).astype("i8")
        return np.where(self.crowded[part], -1, part)


class Job:
    """What a run over documents shares: rows ``id, row, text``, numbers of subtrees and of gathered blocks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, least: int, crowded: int):
        if least < KMER:
            raise ValueError(f"a repeat has {KMER} bytes at least")
        self.least = least
        rows = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
        self.rows = rows.select("_all.id", "row", plain_text("_all.text").alias("text"))
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.gathered = max(1, -(-total // GATHERED_BYTES))
        n = int(min(MOST_SUBTREES, max(1, -(-total * SPREAD // SUBTREE_BYTES))))
        size = np.zeros(n, "i8")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(n, "i8")
            for raw, ends, _, _ in _blocks(batches):
                start, stop, _, kmer, _ = segments(raw, ends, least)
                total += np.bincount((kmer % np.uint64(n)).astype("i8"), stop - start + least - 1, n).astype("i8")
            some = np.flatnonzero(total)
            yield pd.DataFrame({"part": some, "n": total[some]})

        counted = self.rows.mapInPandas(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toPandas()
        size[counted["part"].to_numpy("i8")] = counted["n"].to_numpy("i8")
        self.subtrees = Subtrees(n, size, crowded)
        self.sent = docs.sparkSession.sparkContext.broadcast(self.subtrees)

    def dealt(self, every: bool) -> DataFrame:
        """``part, data``: packed segments of each subtree, equal ones of a block once. Unless
        ``every`` occurrence is asked for, those that a smaller id of the block holds too are
        removed at once: rows of part -1 hold such spans."""
        least, sent, gathered = self.least, self.sent, self.gathered

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for raw, ends, ids, rows in _blocks(batches):
                start, stop, text, kmer, digest = segments(raw, ends, least)
                part = sent.value.of(kmer)
                some = np.flatnonzero(part >= 0)
                start, stop, text, part, digest = start[some], stop[some] + least - 1, text[some], part[some], digest[some]
                of = equal_runs(digest, raw, start, stop)
                doc, row, place = ids[text], rows[text], start - (ends[text] - np.diff(ends, prepend=0)[text])
                if not every:
                    later = doc > doc[of]
                    if later.any():
                        spans = packed_spans(row[later], place[later], (stop - start)[later], gathered)
                        yield pd.DataFrame({"part": -1 - spans["block"], "data": spans["spans"]})
                    some = np.flatnonzero(~later)
                else:
                    some = np.arange(len(of))
                by = some[np.lexsort((some, of[some], part[some]))]
                cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
                data = []
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
                    k = by[a:z]
                    new = np.diff(of[k], prepend=-1) != 0
                    first = k[new]
                    joined = b"".join([raw[x:y] for x, y in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
                    data.append(Segments(joined, (stop - start)[first], np.cumsum(new) - 1, doc[k], row[k], place[k]).packed())
                yield pd.DataFrame({"part": part[by[cuts]], "data": data})

        return self.rows.mapInPandas(deal, "part long, data binary")

    def crowded_windows(self) -> DataFrame | None:
        """``window, id, row, start`` of every window that a crowded subtree would get."""
        if not self.subtrees.crowded.any():
            return None
        least, sent = self.least, self.sent

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for raw, ends, ids, rows in _blocks(batches):
                start, stop, text, kmer, _ = segments(raw, ends, least)
                some = np.flatnonzero(sent.value.of(kmer) < 0)
                n = (stop - start)[some]
                at = np.arange(n.sum()) + np.repeat(start[some] - (np.cumsum(n) - n), n)
                of = np.repeat(text[some], n)
                place = at - (ends[of] - np.diff(ends, prepend=0)[of])
                for k in range(0, len(at), 1 << 16):
                    a, t = at[k : k + (1 << 16)], of[k : k + (1 << 16)]
                    yield pd.DataFrame({"window": [raw[x : x + least] for x in a.tolist()], "id": ids[t], "row": rows[t], "start": place[k : k + (1 << 16)]})

        return self.rows.mapInPandas(windows, "window binary, id long, row long, start long")


def packed_spans(row: np.ndarray, start: np.ndarray, length: np.ndarray, gathered: int) -> pd.DataFrame:
    """``block, spans``: spans of each gathered block, sorted, overlapping ones joined."""
    by = np.lexsort((start, row))
    row, start, stop = row[by], start[by], (start + length)[by]
    if len(row):
        base = np.cumsum(np.diff(row, prepend=row[0]) != 0) << 33  # rows lie apart
        reach = np.maximum.accumulate(base + stop)
        new = np.append(True, (base + start)[1:] > reach[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
        row, start, stop = row[new], start[new], (reach - base)[last]
    block = row_block(row, gathered)
    by = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[by], prepend=-1))
    data = []
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
        k = by[a:z]
        data.append(zstandard.compress(np.diff(row[k], prepend=0).astype("i8").tobytes() + start[k].astype("u4").tobytes() + (stop - start)[k].astype("u4").tobytes(), 1))
    return pd.DataFrame({"block": block[by[cuts]], "spans": data})


def _unpacked_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    n = len(data) // 16
    return np.cumsum(np.frombuffer(data, "i8", n)), np.frombuffer(data, "u4", n, 8 * n).astype("i8"), np.frombuffer(data, "u4", n, 12 * n).astype("i8")


def row_block(row: np.ndarray, gathered: int) -> np.ndarray:
    h = row.astype("u8") * _A
    return ((h ^ (h >> np.uint64(32))) % np.uint64(gathered)).astype("i8")


def _removed_spans(job: Job) -> DataFrame:
    """``block, spans`` of all bytes to remove."""
    gathered, least, rows = job.gathered, job.least, "block long, spans binary"
    dealt = job.dealt(every=False)

    def subtree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"block": -1 - group["part"], "spans": group["data"]})
        joined = Segments.joined([Segments.unpacked(x) for x in group.pop("data")], least)
        return packed_spans(*_removed(joined, least), gathered)

    found = dealt.groupBy("part").applyInPandas(subtree, rows)
    windows = job.crowded_windows()
    if windows is not None:
        # Each window is a subtree of its own: its least document is known by a sum, and
        # met again by salted parts of the rows.
        windows = windows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16)))
        known = windows.groupBy("window").agg(F.min("id").alias("least"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        again = windows.join(known, ["window", "salt"]).where("id > least").select("row", "start")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield packed_spans(batch["row"].to_numpy("i8"), batch["start"].to_numpy("i8"), np.full(len(batch), least), gathered)

        found = found.unionByName(again.mapInPandas(pack, rows))
    return found


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, crowded: int = CROWDED_BYTES) -> DataFrame:
    """Groups of equal byte strings of ``least`` or more, with all their occurrences.

    Returns ``repeat`` (of the group), ``length``, ``id_col``, ``start``: a row for each
    occurrence. No group can be extended to either side by a byte that all its
    occurrences share, but for the bounds of segments: a string that goes on beyond the
    windows that share their least k-mer (at most ``2 * least - KMER`` bytes) comes as
    several groups, each overlapping the next by ``least - 1`` bytes. So whatever two
    places share lies in the union of the groups that hold both. In crowded subtrees the
    groups are windows of ``least`` bytes. Null texts are empty, rows with null ids are
    left out; equal rows repeat each other. An empty table gives no rows.
    """
    job = Job(docs, id_col, text_col, least, crowded)

    def subtree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = _occurrences(Segments.joined([Segments.unpacked(x) for x in group.pop("data")], least), least)
        out["repeat"] = str(key[0]) + ":" + out["repeat"].astype(str)
        return out[["repeat", "length", "doc", "start"]]

    found = job.dealt(every=True).groupBy("part").applyInPandas(subtree, "repeat string, length long, doc long, start long")
    windows = job.crowded_windows()
    if windows is not None:
        several = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
        again = windows.join(several, "window").select(F.hex("window").alias("repeat"), F.lit(least).cast("long").alias("length"), F.col("id").alias("doc"), "start")
        found = found.unionByName(again)
    return found.withColumnRenamed("doc", id_col)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, crowded: int = CROWDED_BYTES) -> DataFrame:
    """Remove every byte that a string of ``least`` bytes covers which also starts in a
    document with a smaller id.

    Texts are UTF-8 bytes; strings are judged on the input and may overlap; no string
    crosses documents. Returns ``id_col, n_bytes, n_removed, spans`` (maximal removed runs:
    ``start, length``) and ``kept`` (the remaining bytes, which need not be UTF-8 any
    more), a row for each input row. Null texts are empty. Rows with equal ids do not
    repeat each other; rows with a null id are kept whole and repeat nothing. An empty
    table gives no rows; other columns are not read.
    """
    job = Job(docs, id_col, text_col, least, crowded)
    gathered = job.gathered
    spans = stored(_removed_spans(job))

    @F.pandas_udf("block long, data binary")
    def prepared(rows: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"block": row_block(rows.to_numpy("i8"), gathered), "data": [zstandard.compress(t.encode(), 1) for t in texts]})

    def kept(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row, start, length = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        if len(found):
            row, start, length = (np.concatenate(x) for x in zip(*map(_unpacked_spans, found.pop("spans")), strict=True))
        by = np.lexsort((start, row))
        row, start, stop = row[by], start[by].tolist(), (start + length)[by].tolist()
        out = []
        for key, number, data in zip(texts["id"].tolist(), texts["row"].tolist(), texts["data"].tolist(), strict=True):
            raw, runs = zstandard.decompress(data), []
            a, z = np.searchsorted(row, [number, number + 1])
            for x, y in zip(start[a:z], stop[a:z], strict=True):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            left = raw
            if runs:
                edges = [0, *(e for run in runs for e in run), len(raw)]
                left = b"".join([raw[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)])
            out.append((key, len(raw), len(raw) - len(left), [{"start": x, "length": y - x} for x, y in runs], left))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"]).astype({"id": "Int64"})

    texts = job.rows.select("id", "row", prepared("row", "text").alias("_p")).select("id", "row", "_p.*")
    result = texts.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(
        kept, "id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"
    )
    return result.withColumnRenamed("id", id_col)
