"""Repeated bytes against brute force over all strings."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from riskspark.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    """Removed bytes of each row: covered by a string that starts in a smaller id too."""
    first = {}
    for key, raw in rows:
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, raw in rows:
        gone = [False] * len(raw)
        for i in range(len(raw) - least + 1):
            if first[raw[i : i + least]] < key:
                gone[i : i + least] = [True] * least
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed, n=120):
    """Copies, near copies, shared passages, one common line with many contexts, runs of one byte and of zeros."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé ", k=r.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=30)) for _ in range(5)]
    line = "This message was posted here by nobody at all in the year of "
    rows = []
    for key in range(n):
        text = " ".join(r.choices(words, k=r.randint(0, 60)))
        kind = r.randrange(8)
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1 and rows:
            text = r.choice(rows)[1]
            at = r.randrange(len(text) + 1)
            text = text[:at] + "#" + text[at:]
        elif kind == 2:
            text += r.choice(passages) + text[:40]
        elif kind == 3:
            text = line + str(r.randrange(10**18)) + " " + line + text
        elif kind == 4:
            text = r.choice(["a", "\0", "ab"]) * r.randrange(200) + text
        rows.append((key // 2 if r.random() < 0.1 else key, text))
    return rows


@pytest.mark.parametrize("crowded", [1 << 26, 1])  # by suffix arrays, and every window for itself
def test_against_brute_force(spark, crowded):
    rows = corpus(1)
    got = suffixes.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), crowded=crowded).collect()
    want = brute([(k, t.encode()) for k, t in rows], 50)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want
    assert sum(w[2] for w in want) > 1000


def test_many_subtrees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SUBTREE_BYTES", 4096)
    monkeypatch.setattr(suffixes, "GATHERED_BYTES", 4096)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2048)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute([(k, t.encode()) for k, t in rows], 50)
    for crowded in (1 << 26, 16384):  # some subtrees are crowded
        got = suffixes.remove_repeated_bytes(docs, crowded=crowded).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


def test_maximal_repeats(spark):
    rows = [(k, t) for k, t in enumerate(t for _, t in corpus(3, 60))]
    raw = {k: t.encode() for k, t in rows}
    groups = defaultdict(set)
    for r in suffixes.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.doc_id, r.start) not in groups[r.repeat, r.length]
        groups[r.repeat, r.length].add((r.doc_id, r.start))
    windows = defaultdict(set)
    for k, b in raw.items():
        for i in range(len(b) - 49):
            windows[b[i : i + 50]].add((k, i))
    covered = defaultdict(set)
    for (_, length), places in groups.items():
        strings = {raw[k][i : i + length] for k, i in places}
        assert len(strings) == 1 and len(places) > 1 and length >= 50
        for shift in range(length - 49):
            shifted = {(k, i + shift) for k, i in places}
            assert shifted <= windows[next(iter(strings))[shift : shift + 50]]
            for place in shifted:
                covered[place] |= shifted
    for places in windows.values():  # every occurrence of every repeated window, not only neighbours
        if len(places) > 1:
            assert all(covered[p] >= places for p in places)


def test_interval_tree_nests():
    lcp = np.array([3, 5, 5, 1, 4, 0, 3])
    got = set(zip(*(x.tolist() for x in suffixes.interval_tree(lcp, 3)), strict=True))
    assert got == {(5, 1, 3), (3, 0, 3), (4, 4, 5), (3, 6, 7)}


def test_suffix_order():
    raw = b"banana\0banana\0\0" + bytes(16)
    at = np.arange(15)
    order = np.concatenate([o for o, _ in suffixes.ordered_suffixes(np.frombuffer(raw, "u1"), at, np.full(15, 15))])
    assert [raw[at[k] : 15] for k in order] == sorted(raw[k:15] for k in at)


def test_hash_collisions_remove_nothing(spark, monkeypatch):
    """Hashes only choose what is compared: equal ones for all change no result."""
    real = suffixes._hashed
    monkeypatch.setattr(suffixes, "_hashed", lambda b, a, z: real(b, a, z) & np.uint64(3))
    rows = [(k, t.encode()) for k, t in corpus(4, 30)]
    ids, raws = zip(*sorted(rows), strict=True)
    start, stop, text, _, digest = suffixes.segments(b"".join(raws), np.cumsum([len(r) for r in raws]))
    joined = b"".join(raws)
    of = suffixes.equal_runs(digest, joined, start, stop + 49)
    assert all(joined[a : b + 49] == joined[start[k] : stop[k] + 49] for a, b, k in zip(start, stop, of, strict=True))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (None, "y" * 60), (5, "y" * 60), (6, "z" * 200), (6, "z" * 200), (7, "z" * 120), (8, "é" * 25), (9, "aé" + "é" * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "3 AS part", "4 AS block", "5 AS data", "6 AS spans")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in suffixes.remove_repeated_bytes(docs).collect()), key=str)
    assert got == sorted([(1, 0, 0, []), (2, 0, 0, []), (3, 49, 0, []), (4, 49, 0, []), (None, 60, 0, []), (5, 60, 0, []), (6, 200, 0, []), (6, 200, 0, []), (7, 120, 120, [(0, 120)]), (8, 50, 0, []), (9, 51, 50, [(1, 50)])], key=str)
    assert suffixes.remove_repeated_bytes(docs.limit(0)).count() == 0 and suffixes.maximal_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in brute(texts, 50)]


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(con.sql(queries.ORACLES["op11_suffix_dedup"]).df()[names].itertuples(index=False, name=None))
    assert sorted(map(tuple, queries.op11_suffix_dedup(spark, SF).select(*names).collect())) == want
