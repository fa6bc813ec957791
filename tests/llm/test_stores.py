"""What workers keep between texts: bounded, with frequent pieces kept."""

import random

import numpy as np
import public_tokenizers

from riskspark.llm import bytebpe, packing

LETTERS = "abcdefghijklmnoprstuéñß"


def _texts(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choices(LETTERS, k=r.randint(3, 14))) + r.choice(["", ",", ".", "***"])
    common = [word() for _ in range(40)]
    return [" ".join([*r.sample(common, 40), *[word() for _ in range(20)], "x-1", "12"]) for _ in range(n)]


def test_byte_bpe_stores_are_bounded(monkeypatch):
    import tiktoken

    monkeypatch.setattr(bytebpe, "STORED_PIECES", 150)
    monkeypatch.setattr(bytebpe, "STORED_PAIRS", 300)
    ranks = bytebpe.Ranks.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    e, made = bytebpe.Encoder(ranks, public_tokenizers.PATTERN), []
    encoding = bytebpe.PrefixEncoding
    monkeypatch.setattr(bytebpe, "PrefixEncoding", lambda r, piece: made.append(piece) or encoding(r, piece))
    for text in _texts(100):
        assert e.encode(text) == plain.encode_ordinary(text)
        assert len(e.stored) <= 150 and len(e.stored.before) <= 150 and len(ranks._pairs) <= 300
    # Words that every text has (but as its first) stay, though the stores were full many times.
    assert max(made.count(piece) for piece in set(made) if piece[:1] == b" ") <= 3


def test_packing_encodes_what_texts_lack_together():
    path, texts = public_tokenizers.path("word_bpe_49k.json"), _texts(600)
    ids = packing.ChunkIds(path, 2_000)
    plain, calls = ids.tokenizer, []

    class Counted:
        def encode_batch_fast(self, some, **kw):
            calls.append(len(some))
            return plain.encode_batch_fast(some, **kw)

    ids.tokenizer = Counted()
    got = list(ids.of(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    # A call for at most 1,024 words and one for other chunks, not one for each text.
    assert len(calls) <= 40


def test_packing_of_words_whose_ends_are_not_marked(monkeypatch):
    path, texts = public_tokenizers.path("word_bpe_49k.json"), _texts(20)
    ids, want = packing.ChunkIds(path, 500), list(packing.ChunkIds(path).of(texts))
    ids.ends = frozenset()
    assert list(ids.of(texts)) == want
    ids = packing.ChunkIds(path, 500)
    ids.ends = frozenset(list(ids.ends)[::2])  # the count of ends doesn't fit: words are encoded apart
    assert list(ids.of(texts)) == want


def test_packing_looks_up_a_chunk_once():
    path, texts = public_tokenizers.path("word_bpe_49k.json"), _texts(300)
    ids, asked = packing.ChunkIds(path), []

    class Counted(dict):
        def get(self, c):
            asked.append(c)
            return super().get(c)

        def __getitem__(self, c):
            asked.append(c)
            return super().__getitem__(c)

        def __contains__(self, c):
            asked.append(c)
            return super().__contains__(c)

    want = list(ids.of(texts))
    ids.stored = Counted(ids.stored)
    assert list(ids.of(texts)) == want
    assert len(asked) == sum(len(t.split(" ")) for t in texts)


def test_packing_keeps_words_with_their_chunks():
    """Words, their forms with capitals and marks, and what is too long to stay, in a store that is often full."""
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    words = ["na", "über", "élan", "ΌΔΟΣ", "İstanbul", "ǅ", "ét", "x" * 70, "é" * 70, "don't", "12", "a\tb", "c\r", "日本", "\U0001e900"]
    forms = [f for w in words for f in (w, w.upper(), w.capitalize(), w + ",", w.upper() + "!?", w + "." * 70)] + ["", ".", "." * 70]
    texts = [" ".join([*r.sample(forms, 40), *t.split(" ")]) for t in _texts(200)]
    for most in (200, 2_000, 100_000):
        ids = packing.ChunkIds(path, most)
        got = [x for k in range(0, 200, 50) for x in ids.of(texts[k : k + 50])]
        assert got == [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert not any(len(c) > packing.STORED_LENGTH for kept in (ids.stored, ids.stored_before, ids.marks) for c in kept)
