"""Packing by best-fit decreasing. A segment tree indexed by remaining capacity finds
the tightest open window; overlong documents are first cut into full windows."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import own_worker, plain_text

WINDOW = 4096
#: Id after each document.
END_ID = 2
#: Documents of a group that is packed together, on average.
GROUP_DOCUMENTS = 2048
#: Marks that may follow a word; the tokenizer's pattern takes them as one match.
MARKS = ".,;:!?*&$%#\")]}"
#: The settings of a tokenizer whose texts may be cut at white space: its normalizers, and its pattern of matches.
NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks whose ids a worker keeps, in two generations: frequent ones stay, rare ones go.
STORED_CHUNKS = 700_000
#: Longer chunks are not stored.
STORED_LENGTH = 64
#: Texts (and about their characters) of which what is missing is encoded together.
BLOCK_TEXTS, BLOCK_CHARS = 256, 1 << 20


class ChunkIds:
    """Packed ids of texts, from the ids of their chunks between spaces. That holds for a
    tokenizer that drops white space, whose pattern has no match with any, and whose
    normalizers don't look beyond it; texts of other tokenizers, and texts that may hold
    one of its added tokens, are encoded whole."""

    def __init__(self, path: str, most: int = STORED_CHUNKS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable, self.heads = settings(json.loads(self.tokenizer.to_str()))
        self.ends = word_ends(json.loads(self.tokenizer.to_str()))
        self.stored: dict[str, bytes] = {}
        self.stored_before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or (end - at < BLOCK_TEXTS and size + len(texts[end]) <= BLOCK_CHARS)):
                size, end = size + len(texts[end]), end + 1
            yield from self._block(texts[at:end])
            at = end

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        """What is missing for all texts of a block is encoded together."""
        cut = [t.replace("\n", " ").split(" ") if self.cuttable and not any(h in t for h in self.heads) else None for t in texts]
        rows, missing = self._looked_up(cut)
        if len(self.stored) + 2 * len(missing) > self.most // 2:
            # What is asked for again comes back from here; what was here before is forgotten.
            self.stored_before, self.stored, self.marks = self.stored, {}, {"": b""}
            rows, missing = self._looked_up(cut)
        self._recall(missing)
        found, passing = self.stored, self._make(missing)
        for text, chunks, (ids, lacking) in zip(texts, cut, rows, strict=True):
            if chunks is None:
                yield self._encoded([text])[0]
                continue
            for k in lacking:
                ids[k] = found[chunks[k]]
            yield b"".join(ids)
        for c in passing:
            del found[c]

    def _looked_up(self, cut: list[list[str] | None]) -> tuple[list[tuple[list, list[int]]], set[str]]:
        """Ids of each text's chunks with the places where they lack, and the chunks that lack."""
        get, missing, rows = self.stored.get, set(), []
        for chunks in cut:
            ids = list(map(get, chunks or ()))
            lacking = [k for k, x in enumerate(ids) if x is None]
            missing.update([chunks[k] for k in lacking])
            rows.append((ids, lacking))
        return rows, missing

    def _recall(self, missing: set[str]) -> None:
        """What was kept before is kept again, and no longer missing."""
        found, before = self.stored, self.stored_before
        for c in before.keys() & missing:
            found[c] = before.pop(c)
            missing.discard(c)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in encoded]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, encoded as one text and cut after the ids that end a word."""
        if len(words) < 2 or not self.ends:
            return self._encoded(words)
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        cuts = [k for k, x in enumerate(map(self.ends.__contains__, ids), 1) if x]
        if len(cuts) != len(words):
            return self._encoded(words)
        packed = pack(f"<{len(ids)}I", *ids)
        return [packed[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]

    def _make(self, chunks: set[str]) -> list[str]:
        """Store the ids of chunks, and of the words they have; returns those too long to stay.
        Letters and the marks after them are encoded apart, as the tokenizer's pattern parts
        them; other chunks are encoded whole."""
        found, words, parted, others = self.stored, set(), [], []
        for c in chunks:
            body = c if c.isalpha() else c.rstrip(MARKS)
            if body.isascii() and body.isalpha():
                word = body.lower()
            elif letters_alone(body):
                word = body
            else:
                others.append(c)
                continue
            if word == c:
                words.add(c)
            else:
                parted.append((c, word, c[len(body) :]))
        lacking = {word for _, word, _ in parted if word not in found}
        self._recall(lacking)
        words |= lacking
        marks = {m for _, _, m in parted if m not in self.marks}
        for store, new, encoded in ((found, words, self._encoded_words), (found, others, self._encoded), (self.marks, marks, self._encoded)):
            new = list(new)
            for at in range(0, len(new), 1024):
                some = new[at : at + 1024]
                store.update(zip(some, encoded(some), strict=True))
        for c, word, m in parted:
            found[c] = found[word] + self.marks[m]
        for m in [m for m in marks if len(m) > STORED_LENGTH]:
            del self.marks[m]
        return [c for c in chunks | words if len(c) > STORED_LENGTH]


def letters_alone(body: str) -> bool:
    """Whether a word is letters for the tokenizer's pattern too, when it has been composed
    and every character put in lower case. Characters beyond the first plane, of which
    versions of Unicode differ, are left to the tokenizer."""
    return body.isalpha() and max(body) <= "\uffff" and unicodedata.normalize("NFC", body).lower().isalpha()


def settings(made: dict) -> tuple[bool, list[str]]:
    """Whether texts may be cut at white space, and what a text holds that may hold an added token."""
    normalizer, first = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    normalizers = normalizer.get("normalizers", [normalizer] if normalizer else [])
    split, *rest = first.get("pretokenizers", [first])
    known = split.get("type") == "Split" and split["pattern"] == {"Regex": PATTERN} and split["invert"] and split["behavior"] == "Removed"
    known = known and all(p.get("type") == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest)
    known = known and all(n in NORMALIZERS for n in normalizers)
    known = known and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in made.get("added_tokens", []))
    return known, sorted({t["content"][:2] for t in made.get("added_tokens", [])})


def word_ends(made: dict) -> frozenset[int]:
    """The ids that end a match of the pattern, of a vocabulary that marks them by a suffix."""
    suffix = made["model"].get("end_of_word_suffix")
    return frozenset(i for token, i in made["model"]["vocab"].items() if suffix and token.endswith(suffix))


@lru_cache(maxsize=1)
def chunk_ids(path: str, most: int) -> ChunkIds:
    return ChunkIds(path, most)


class TightestWindow:
    """Open windows by remaining capacity. Node ``k`` of the tree counts the windows
    below it; a descent finds the least capacity that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        k = capacity + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Capacity and id of the tightest window with room for ``length``, or None."""
        count, k = self.count, length + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each item; items are at most a window long."""
    tree, opened = TightestWindow(window), 0
    where, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, w = found
        where[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.add(capacity - n, w)
    return where, offset


def tokenized_pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, stored_chunks: int = STORED_CHUNKS
) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, _row``: every document's ids with the
    end id, cut into full windows and a rest."""
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_worker("packing", chunk_ids.cache_clear)
        store = chunk_ids(vocabulary, stored_chunks)
        for batch in batches:
            made = []
            for key, row, ids in zip(batch["id"], batch["_row"], store.of(batch["text"].tolist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    made.append((key, start, len(part) // 4, zlib.crc32(part), n, row))
            yield pd.DataFrame(made, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "_row"])

    return rows.mapInPandas(
        pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _row long"
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group_documents: int = GROUP_DOCUMENTS,
    stored_chunks: int = STORED_CHUNKS,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    Returns a row for each piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. A null or empty text is the end id alone. Rows are dealt at
    random (by their place in the input, so repeated ids and hot sources spread too)
    into groups of about ``group_documents`` documents; each group is packed by
    best-fit decreasing. A group leaves a few unfilled windows, so padding does not
    grow with the input. Equal lengths are packed in input order. An empty table
    gives no rows; other columns are not read. A worker keeps the ids of
    ``stored_chunks`` chunks at most, which takes memory and saves time.
    """
    groups = max(1, -(-docs.count() // group_documents))
    p = tokenized_pieces(docs, vocabulary, id_col, text_col, window, stored_chunks)
    p = p.withColumn("_group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups)))
    kind = p.schema["id"].dataType.simpleString()

    def packed_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_row", "start"], kind="stable", ignore_index=True)
        where, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        out = group[["id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"], out["offset"] = (int(key[0]) << 32) + where, offset
        return out

    packed = p.groupBy("_group").applyInPandas(
        packed_group,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("id", id_col)
