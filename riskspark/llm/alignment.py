"""Alignment of two tokenizers by labels of bytes.

Every byte of a text gets a label: no token ends there, one of A, one of B, or one of both.
A regular expression takes the labels up to each "both": that is a group of tokens that
cover the same bytes, and its labels count the tokens of either side. Between two ends of
any kind one token of A lies over one of B: that is a link.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import own_worker, plain_text, stored

#: Labels of a byte: the end of a token of A, of B, of both.
END_A, END_B, BOTH = 1, 2, 3
GROUP = re.compile(rb"[\x00-\x02]*\x03")
#: Chunks whose alignment a worker keeps; beyond it the store is emptied. Longer ones are not kept.
STORED_CHUNKS, STORED_LENGTH = 500_000, 48
#: Characters of the texts whose links are gathered together, about.
BLOCK_CHARACTERS = 1 << 22
#: The mark that stands for a space in pieces.
MARK = "▁"


def byte_of_character() -> dict[str, int]:
    """The bytes behind the characters of a byte-level vocabulary: printable ones stand for
    themselves, all others for the characters from 256 on, in turn."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        of = byte_of_character()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(of.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], "i8") for t in (self.bytes_a, self.bytes_b))
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        # A text may be cut where a space follows another character, if neither tokenizer
        # changes texts and no token goes on behind such a place.
        self.cuttable = (
            self.a.normalizer is None
            and "ByteLevel" in str(self.a.pre_tokenizer)
            and "use_regex=True" in str(self.a.pre_tokenizer)
            and "add_prefix_space=False" in str(self.a.pre_tokenizer)
            and not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and not any(MARK in p.lstrip(MARK) for p in pieces)
            and not any(p.type == model.SentencePiece.USER_DEFINED for p in model.pieces)
        )
        self.stored: dict[str, tuple] = {}
        self.glued: set[str] = set()

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of B; the empty text that follows a last space is that space."""
        found = self.b.encode(texts, num_threads=1)
        return [ids if text else [self.b.piece_to_id(MARK)] for text, ids in zip(texts, found, strict=True)]

    def aligned(self, texts: list[str]) -> list[tuple[str, bytes, int] | None]:
        """Of each space + text: groups, links as packed ``a << 32 | b`` and number of A's
        tokens. None where the tokens' bytes are not the text's."""
        raws = [b" " + t.encode() for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.ids_b(texts)
        good = [self._spelled(x, y, raw) for x, y, raw in zip(ids_a, ids_b, raws, strict=True)]
        some = [k for k, g in enumerate(good) if g]
        out: list[tuple[str, bytes, int] | None] = [None] * len(texts)
        found = self._groups([i for k in some for i in ids_a[k]], [i for k in some for i in ids_b[k]], [len(raws[k]) for k in some])
        for k, f in zip(some, found, strict=True):
            out[k] = f
        return out

    def aligned_chunks(self, chunks: list[str]) -> list[tuple[str, bytes, int] | None]:
        """The same, of chunks: those that may stand one after another in a text are encoded as one."""
        in_turn = [c and not c[-1].isspace() for c in chunks]
        if len(chunks) > 1 and all(in_turn):
            joined = " ".join(chunks)
            ids_a, ids_b = self.a.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, self.b.encode(joined)
            if self._spelled(ids_a, ids_b, b" " + joined.encode()):
                return self._groups(ids_a, ids_b, [len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in chunks])
        return self.aligned(chunks)

    def _spelled(self, ids_a: list[int], ids_b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))

    def _groups(self, ids_a: list[int], ids_b: list[int], sizes: list[int]) -> list[tuple[str, bytes, int]]:
        if not sizes:
            return []
        a, b, ends = np.array(ids_a, "i8"), np.array(ids_b, "i8"), np.cumsum(sizes)
        labels = np.zeros(ends[-1], "u1")
        labels[np.cumsum(self.size_a[a]) - 1] = END_A
        labels[np.cumsum(self.size_b[b]) - 1] += np.uint8(END_B)
        at = np.flatnonzero(labels)
        kind = labels[at]
        in_a, in_b = kind & END_A, kind >> 1
        links = ((a[np.cumsum(in_a, dtype="i8") - in_a] << 32) | b[np.cumsum(in_b, dtype="i8") - in_b]).astype("<i8").tobytes()
        cuts = (8 * np.searchsorted(at, ends)).tolist()
        name_a, name_b = list(map(str, ids_a)), list(map(str, ids_b))
        out, spans, place, i, j, cut = [], iter(GROUP.findall(labels.tobytes())), 0, 0, 0, 0
        for end, stop in zip(ends.tolist(), cuts, strict=True):
            groups, first = [], i
            while place < end:
                span = next(spans)
                place += len(span)
                x, y = i + 1 + span.count(END_A), j + 1 + span.count(END_B)
                if x - i == y - j == 1:
                    groups.append(name_a[i] + "|" + name_b[j])
                else:
                    groups.append(",".join(name_a[i:x]) + "|" + ",".join(name_b[j:y]))
                i, j = x, y
            out.append((";".join(groups), links[cut:stop], i - first))
            cut = stop
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut at spaces that follow a character that is no white space."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for part in parts[1:]:
            if not held or held[-1].isspace():
                held += " " + part
            else:
                out.append(held)
                held = part
        return [*out, held]

    def of(self, text: str) -> tuple[str, bytes, int] | None:
        """The same as :meth:`aligned`, from stored alignments of the text's chunks."""
        if not self.cuttable:
            return self.aligned([text])[0]
        chunks = text.split(" ")
        distinct = set(chunks)
        if len(self.stored) + len(distinct) > STORED_CHUNKS:
            self.stored, self.glued = {}, set()
        missing = distinct.difference(self.stored)
        odd = {c for c in missing if not c or c[-1].isspace()}
        self.glued |= odd
        if not self.glued.isdisjoint(distinct):
            chunks = self.chunks(text)
            missing = set(chunks).difference(self.stored)
        new = list(missing)
        for k in range(0, len(new), 2048):
            self.stored.update(zip(new[k : k + 2048], self.aligned_chunks(new[k : k + 2048]), strict=True))
        found = list(map(self.stored.__getitem__, chunks))
        for c in new:
            if len(c) > STORED_LENGTH:
                del self.stored[c]
        if None in found:  # in such a text other tokens might make up for it
            return self.aligned([text])[0]
        groups, links, n_a = zip(*found, strict=True)
        return ";".join(groups), b"".join(links), sum(n_a)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _block(ids: list, found: list[tuple[str, bytes, int] | None], digests: bool) -> dict:
    """One row for the documents of a block: their figures, the distinct links of the block
    with the number of documents that hold them, and which of them each document has how often."""
    codes = np.frombuffer(b"".join(f[1] for f in found if f), "<i8")
    n_links = np.array([len(f[1]) // 8 if f else 0 for f in found], "i8")
    distinct, at = np.unique(codes, return_inverse=True)
    pairs, times = np.unique(np.repeat(np.arange(len(found)), n_links) * max(1, len(distinct)) + at, return_counts=True)
    doc, place = np.divmod(pairs, max(1, len(distinct)))
    held = np.bincount(place, minlength=len(distinct))
    per_doc = np.bincount(doc, minlength=len(found))
    step = np.where(np.diff(doc, prepend=-1) == 0, np.diff(place, prepend=0), place)
    n_a = np.array([f[2] if f else 0 for f in found], "i8")
    groups = [f[0] if f else "" for f in found]
    n_groups = np.array([g.count("|") for g in groups], "i8")
    return {
        "ids": ids,
        "n_a": n_a,
        "n_b": n_links - n_a + n_groups,  # a group of x and y tokens has x + y - 1 links
        "n_groups": n_groups,
        "n_links": n_links,
        "groups": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digests else groups,
        "uses": zstandard.compress(per_doc.astype("u4").tobytes() + step.astype("u4").tobytes() + times.astype("u4").tobytes(), 1),
        "a": (distinct >> 32).astype("i4"),
        "b": (distinct & 0xFFFFFFFF).astype("i4"),
        "held": held.astype("i4"),
    }


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_worker("alignment", aligner.cache_clear)
        both = aligner(path_a, path_b)
        ids, found, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if key != key else key)
                found.append(both.of(text) if text else None)
                size += len(text)
                if size > BLOCK_CHARACTERS:
                    yield pd.DataFrame([_block(ids, found, digests)])
                    ids, found, size = [], [], 0
        if ids:
            yield pd.DataFrame([_block(ids, found, digests)])

    return rows.mapInPandas(
        align,
        f"ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, uses binary, a array<int>, b array<int>, held array<int>",
    ).withColumn("block", F.monotonically_increasing_id())


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Align the tokens that two tokenizers give each space + text.

    A is a byte-level BPE file, B a piece model that puts the space itself; strings of
    special tokens are plain text. Returns ``id_col, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``: a row for each input row. ``groups`` is ``a1,a2|b1;a3|b2,b3``, or
    its SHA-256 with ``digests``. A link is a token of A over a token of B that share
    bytes; a pair of ids counts the documents of the whole table that hold it linked.
    ``n_best`` is the number of links whose count is the highest of their A id,
    ``count_sum`` the sum of all links' counts. Texts that are null or empty, or that the
    tokens' bytes do not give back, have zeros and an empty ``groups``. Equal and null ids
    are rows like others; an empty table gives no rows; other columns are not read.
    Executors need both files.
    """
    blocks = stored(aligned_blocks(docs, path_a, path_b, id_col, text_col, digests))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    links = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "held")).alias("place", "l"))
    links = links.select("block", "place", "l.a", "l.b", "l.held")
    counts = links.groupBy("a", "b").agg(F.sum("held").alias("n"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # no more rows than A has ids
    known = stored(counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))
    met = links.join(known, ["a", "b"]).select(F.col("block").alias("of"), "place", "n", "best")

    def scored(block: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(links), "i8"), np.zeros(len(links), "i8")
        place = links["place"].to_numpy()
        n[place], best[place] = links["n"].to_numpy("i8"), links["best"].to_numpy(bool)
        row = block.iloc[0]
        data, k = zstandard.decompress(row["uses"]), len(row["ids"])
        per_doc = np.frombuffer(data, "u4", k).astype("i8")
        m = (len(data) // 4 - k) // 2
        step, times = (np.frombuffer(data, "u4", m, 4 * (k + at)).astype("i8") for at in (0, m))
        doc = np.repeat(np.arange(k), per_doc)
        total = np.cumsum(step)
        first = (np.cumsum(per_doc) - per_doc)[doc]  # places are differences inside a document
        place = total - (total - step)[first] if m else step
        out = {"id": list(row["ids"])} | {c: row[c] for c in ("n_a", "n_b", "n_groups", "n_links")}
        for name, values in (("n_best", best), ("count_sum", n)):
            sums = np.zeros(k, "i8")
            np.add.at(sums, doc, values[place] * times)
            out[name] = sums
        return pd.DataFrame(out | {"groups": list(row["groups"])})

    result = blocks.drop("a", "b", "held").groupBy("block").cogroup(met.groupBy("of")).applyInPandas(
        scored, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return result.withColumnRenamed("id", id_col)
