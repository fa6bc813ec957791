"""Alignments against plain tokenization and intervals."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskspark.llm import alignment, queries

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
BYTES = alignment.byte_of_character()


def token_bytes(text):
    """Ids and bytes of both sides of the whole text, one token after another."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    bytes_a = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    return a, b, bytes_a, bytes_b


def brute(text):
    """Groups and links by comparing byte ranges."""
    if not text:
        return "", [], 0, 0
    a, b, x, y = token_bytes(text)
    if not b"".join(x) == b"".join(y) == (" " + text).encode():
        return "", [], 0, 0

    def ranges(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            out.append((at, at + len(p), i))
            at += len(p)
        return out

    ra, rb = ranges(a, x), ranges(b, y)
    cuts = sorted({r[1] for r in ra} & {r[1] for r in rb})
    groups, low = [], 0
    for high in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in r if low <= s and e <= high) for r in (ra, rb)))
        low = high
    links = [(i, j) for s, e, i in ra for t, f, j in rb if s < f and t < e]
    return ";".join(groups), links, len(a), len(b)


def wanted(texts):
    made = [brute(t) for t in texts]
    counts = Counter(p for _, links, _, _ in made for p in set(links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [(n_a, n_b, g.count("|"), len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), g) for g, ls, n_a, n_b in made]


PARTS = [" ", "  ", "\n", "\t", "a", "the", "Zürich", "▁", "<|endoftext|>", "<s>", "é", "é", "😀", "'s", "\x00", "\x1c", "\xa0", "　", "123", "...", "語", "​", "<0x0A>"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_any_text(text):
    aligner = alignment.aligner(*PATHS)
    assert aligner.cuttable
    got = aligner.of(text) if text else None
    groups, links, n_a, _ = brute(text)
    if not links:
        assert got is None
    else:
        assert got[0] == groups and got[2] == n_a
        codes = [int.from_bytes(got[1][k : k + 8], "little") for k in range(0, len(got[1]), 8)]
        assert [(c >> 32, c & 0xFFFFFFFF) for c in codes] == links


def test_many_mixed_texts():
    r = random.Random(5)
    for _ in range(1500):
        test_text = "".join(r.choices(PARTS, k=r.randint(1, 12)))
        found = alignment.aligner(*PATHS).of(test_text)
        assert (found[0] if found else "") == brute(test_text)[0], test_text


def test_without_chunks_and_with_small_stores(monkeypatch):
    plain = alignment.Aligner(*PATHS)
    plain.cuttable = False
    monkeypatch.setattr(alignment, "STORED_CHUNKS", 3)
    small = alignment.Aligner(*PATHS)
    for text in ["one two  three\n four ", "x" * 300 + " y", " ", "a b c d e f"]:
        assert plain.of(text) == small.of(text) is not None


@pytest.mark.parametrize("characters", [1 << 22, 500])
def test_query(spark, monkeypatch, characters):
    monkeypatch.setattr(alignment, "BLOCK_CHARACTERS", characters)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").orderBy("doc_id")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], wanted([r.text for r in rows]), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_documents(docs, *PATHS).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 5_000
    digests = {r.doc_id: r.groups for r in alignment.align_documents(docs, *PATHS, digests=True).collect()}
    assert digests == {k: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for k, w in want.items()}


def test_registered_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_token_alignment(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        groups, links, n_a, n_b = brute(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 1500 else (None, None, r.n_a, r.n_b)
        assert (r.n_a, r.n_b) == (n_a, n_b) and r.n_links == r.n_a + r.n_b - r.n_groups
        if groups is not None:
            assert r.n_links == len(links) and r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "word " * 40_000), (7, "x" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "block", "a", "b", "held", "n", "groups", "ids")})
    got = sorted((tuple(r) for r in alignment.align_documents(docs, *PATHS).collect()), key=str)
    assert got == sorted([(k, *w) for (k, _), w in zip(rows[:7], wanted([t for _, t in rows[:7]]), strict=True)] + [g for g in got if g[0] in (6, 7)], key=str)
    assert len(got) == 9 and {g[0]: g[1] for g in got}[6] == 40_001
    assert alignment.align_documents(docs.limit(0), *PATHS).count() == 0
