"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece exactly one token can be the last of the prefix's
encoding: the one that forms a valid pair with the last token of what is before it.
Storing that token for each prefix makes appends exact (earlier entries never
change) and lets an edit keep all entries before it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import own_worker, plain_text

#: Pieces whose ids a worker keeps in each of two generations (:class:`_Stored`), and pairs
#: whose check it keeps, so that a worker's memory stays bounded however long it lives.
STORED_PIECES, STORED_PAIRS = 200_000, 400_000
#: Longer pieces are not stored.
STORED_LENGTH = 64


class Ranks:
    """Token ranks with what pair checks need: each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._splits: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}  # by left << 32 | right

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            rows = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in rows})

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own halves."""
        found = self._splits.get(token)
        if found is None:
            whole, found = self.tokens[token], (token, token)
            for k in range(1, len(whole)):
                a, b = self.ranks.get(whole[:k]), self.ranks.get(whole[k:])
                if a is not None and b is not None and a < token and b < token and self.valid(a, b, token):
                    found = (a, b)
                    break
            self._splits[token] = found
        return found

    def valid(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether two tokens stay side by side when their joined bytes are encoded
        (with ranks under ``below`` only)."""
        if below is None and (known := self._pairs.get(left << 32 | right)) is not None:
            return known
        a, b, limit, answer = left, right, below if below is not None else 1 << 62, None
        while answer is None:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                answer = False
                break
            # Undo the later merge of the two that touch the border.
            for side in ("right", "left") if a < b else ("left", "right"):
                if side == "left":
                    inner = self.split(a)[1]
                    if inner != a:
                        limit, a = min(limit, a), inner
                        break
                else:
                    inner = self.split(b)[0]
                    if inner != b:
                        limit, b = min(limit, b + 1), inner
                        break
            else:
                answer = True
        if below is None:
            if len(self._pairs) >= STORED_PAIRS:
                self._pairs.clear()
            self._pairs[left << 32 | right] = answer
        return answer


class PrefixEncoding:
    """The last tokens of all prefixes of one piece."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoding:
        """Add bytes at the end; the entries of earlier prefixes stay as they are."""
        r, piece, last = self.ranks, self.piece + more, self.last
        get, longest, valid, known = r.ranks.get, r.longest, r.valid, r._pairs.get
        for end in range(len(self.piece) + 1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(piece[start:end])
                if token is None:
                    continue
                if start:
                    fits = known(last[start] << 32 | token)
                    if fits is None:
                        fits = valid(last[start], token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the ranks lack a single byte")
        self.piece = piece
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixEncoding:
        """Replace bytes ``start`` to ``end``; entries before ``start`` are kept."""
        tail = self.piece[end:]
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.ranks.tokens[self.last[at]])
        return out[::-1]


class Encoder:
    """Encodes whole texts: each match of the pattern on its own."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.stored = _Stored(ranks)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.stored.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


class _Stored(dict):
    """Piece to packed ids, made when first asked for. When ``STORED_PIECES`` are kept
    they become ``before``, from which come back those that are asked for again, and
    what was there is forgotten: so rare pieces go and frequent ones stay."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.before = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.pop(piece, None)
        if packed is None:
            raw = piece.encode()
            whole = self.ranks.ranks.get(raw)
            ids = [whole] if whole is not None else PrefixEncoding(self.ranks, raw).ids()
            packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= STORED_LENGTH:
            if len(self) >= STORED_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(Ranks.load(path), pattern)


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` of every whole text: ``ids`` are packed
    little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand for.

    Null and empty texts have no ids. Repeated rows stay repeated; other columns are
    not read. ``vocabulary`` is a rank file that every executor has.
    """

    @F.pandas_udf("n_tokens long, ids binary, decoded binary")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        own_worker("bytebpe", encoder.cache_clear)
        e = encoder(vocabulary, pattern)
        ids = [e.encode_bytes(t) for t in texts]
        back = [e.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": back})

    return docs.select(F.col(id_col), encoded(plain_text(text_col)).alias("_e")).select(id_col, "_e.*")


def encoding_digests(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every whole text; the same
    encoding as :func:`encode_documents`, digested where it is made."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own_worker("bytebpe", encoder.cache_clear)
        e = encoder(vocabulary, pattern)
        rows = []
        for t in texts:
            ids = e.encode_bytes(t)
            back = e.decode(np.frombuffer(ids, "<u4").tolist())
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(plain_text(text_col)).alias("_e")).select(id_col, "_e.*")
