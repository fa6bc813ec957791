"""Tokenizers of the text models, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Special ids of the byte and of the subword tokenizer.
BYTE_START, BYTE_END = 101, 102
PAD, UNKNOWN, START, END = 0, 1, 2, 3
MAX_LENGTH = 512
WORD_MARK = "▁"


def byte_ids(text: str, length: int) -> list[int]:
    """Start id, UTF-8 bytes cut between characters, end id and zeros."""
    body = text.encode()
    room = length - 2
    if len(body) > room:
        body = body[:room].decode(errors="ignore").encode() if room > 0 else b""
    ids = [BYTE_START, *body, BYTE_END]
    return ids[:length] + [0] * (length - len(ids))


def byte_encode(c: Column, length: int = MAX_LENGTH) -> Column:
    """Ids of the byte tokenizer, ``length`` of them. Null stays null."""

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else byte_ids(t, length))

    return encode(c)


def merged(word: str, vocabulary: dict[str, int]) -> list[str]:
    """Join the neighbours whose union has the least id, at all its places, until none has one."""
    parts = list(word)
    while len(parts) > 1:
        unions = [vocabulary.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        least = int(np.argmin(unions))
        if unions[least] == np.inf:
            break
        left, right, out = parts[least], parts[least + 1], []
        for p in parts:
            if out and out[-1] == left and p == right and not out[-1:] == [left + right]:
                out[-1] = left + right
            else:
                out.append(p)
        parts = out
    return parts


def pieces(text: str, vocabulary: dict[str, int]) -> list[str]:
    """Lower-case ASCII words are merged; any other character stands alone."""
    out, word = [], ""
    for ch in text + "\0":
        if ch.isascii() and ch.isalpha():
            word += ch.lower()
            continue
        if word:
            out += merged(word, vocabulary)
            word = ""
        out.append(ch)
    return out[:-1]


def subword_ids(text: str, vocabulary: dict[str, int], length: int) -> list[int]:
    body = [vocabulary.get(p, UNKNOWN) for p in pieces(text, vocabulary)][: length - 2]
    ids = [START, *body, END]
    return ids + [PAD] * (length - len(ids))


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """A vocabulary file (one JSON object), read by whatever file system Spark knows.
    A vocabulary is a few thousand entries; it is sent to the tasks with their code."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def subword_encoder(vocabulary: dict[str, int], length: int = MAX_LENGTH) -> Callable[[Column], Column]:
    """A column function that gives the ids of the subword tokenizer; without a
    vocabulary it is the byte tokenizer."""

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        one = (lambda t: subword_ids(t, vocabulary, length)) if vocabulary else (lambda t: byte_ids(t, length))
        return texts.map(lambda t: None if t is None else one(t))

    return encode


def subword_decoder(vocabulary: dict[str, int]) -> Callable[[Column], Column]:
    """A column function from ids to text: special ids go, word marks become spaces."""
    token = {i: t for t, i in vocabulary.items()}

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        def text(x: np.ndarray | None) -> str | None:
            if x is None:
                return None
            return "".join(token.get(int(i), "") for i in x if int(i) > END).replace(WORD_MARK, " ").strip()

        return ids.map(text)

    return decode
