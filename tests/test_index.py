"""The inverted index against plain counting, and growing against building at once."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.text import ngrams
from riskspark.operators import index
from riskspark.sources import scratch

SF = "/root/testdata/sf0.001"


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdef", k=r.randint(1, 5))) for _ in range(80)]
    topics = [r.sample(words, 12) for _ in range(10)]
    return [(k * 3, " ".join(r.choices(topics[k * 10 // n], k=r.randint(0, 40)))) for k in range(n)]


def plain_tokens(text):
    out, run = [], ""
    for c in [*text.lower(), " "]:
        if c.isalpha() or c.isdecimal():
            run += c
            continue
        if 0 < len(run) <= 2:
            out.append(run)
        elif run:
            out += [run[k : k + n] for n in (2, 3) for k in range(len(run) - n + 1)]
        run = ""
    return Counter(out)


def plain_postings(rows):
    bags = {k: plain_tokens(t) for k, t in rows if t and plain_tokens(t)}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    out = defaultdict(dict)
    for k, b in bags.items():
        for t, tf in b.items():
            score = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean))
            out[t][k] = min(math.floor(round(1000 * score, 9)), 65535)
    return out


def plain_search(postings, queries, k):
    out = []
    for q, text in queries:
        scores = Counter()
        for t, times in plain_tokens(text).items():
            for doc, s in postings.get(t, {}).items():
                scores[doc] += times * s
        out += [(q, doc, s, n) for n, (doc, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def token_rows(spark, df):
    return {tuple(r) for r in df.select(index.token_text(F.col("token")).alias("t"), "doc_id", "score").collect()}


@pytest.mark.parametrize("text", ["", "a", "ab", "abc d ef", "Ünïcödé 語言 12ab", "x-y_z", "İstanbul ΑΣ", "😀a😀bc", "\U0001d504\U0001d505\U0001d506 ٣٤٥", "a\x00b"])
def test_tokens_are_the_ngrams(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    low = df.select(F.lower("t")).first()[0]
    numbers = index.token_numbers(low)
    got = spark.createDataFrame([(int(n),) for n in numbers], "n long").select(index.token_text(F.col("n")).alias("t")).collect()
    assert Counter(r.t for r in got) == Counter(df.select(ngrams(F.col("t")).alias("g")).first()["g"])


def test_blocks_hold_all_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 16)
    rows = [*corpus(1, 90), (1000, None), (1001, ""), (1002, "!?"), (None, "abc")]
    ix = scratch.stored(index.blocks(frame(spark, rows).repartition(3)))
    want = plain_postings([r for r in rows if r[0] is not None])
    assert token_rows(spark, index.postings(ix, None)) == {(t, k, s) for t, p in want.items() for k, s in p.items()}
    best = {(t, k, s) for t, p in want.items() for k, s in sorted(p.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert token_rows(spark, index.postings(ix, 5)) == best
    asked = index.asked_tokens(frame(spark, [(1, "abc de")]), "doc_id", "text")
    assert token_rows(spark, index.postings(ix, 5, asked)) == {b for b in best if b[0] in plain_tokens("abc de")}


def test_search_skips_runs_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 8)
    monkeypatch.setattr(index, "FIRST_RUNS", 2)
    rows = corpus(2, 240)
    queries = [(k, t[: 5 + k]) for k, (_, t) in enumerate(rows[::16])] + [(99, "zzz"), (98, None)]
    queries += [(100, rows[40][1] + " " + rows[40][1])]
    ix = scratch.stored(index.blocks(frame(spark, rows).coalesce(1)))
    asked = scratch.stored(index.asked_tokens(frame(spark, queries), "doc_id", "text"))
    blocks = scratch.stored(index.impact_blocks(index.postings(ix, None, asked)))
    found, scored = index.search(asked, blocks, 4)
    assert sorted(map(tuple, found.collect())) == plain_search(plain_postings(rows), [q for q in queries if q[1]], 4)
    n_scored, n_runs = scored.distinct().count(), index.runs_to_score(asked, blocks).count()
    assert scored.count() == n_scored < 0.7 * n_runs


def test_search_of_repeated_documents(spark, monkeypatch):
    """Ties everywhere: the smaller ids win, in whatever run they are."""
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 4)
    rows = [(k, "same words here") for k in range(60)] + [(100, "other")]
    ix = scratch.stored(index.blocks(frame(spark, rows).repartition(4)))
    asked = index.asked_tokens(frame(spark, [(1, "same words")]), "doc_id", "text")
    found, _ = index.search(asked, index.impact_blocks(index.postings(ix, None, asked)), 7)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(7))


def test_segments_equal_one_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 16)
    rows = corpus(3, 120)
    random.Random(1).shuffle(rows)
    grown = index.Segments(spark, str(tmp_path / "index"))
    assert grown.n_documents() == 0 and grown.blocks().count() == 0
    for k in range(0, 120, 30):
        grown.inserted(frame(spark, rows[k : k + 30]))
        want = plain_postings(rows[: k + 30])
        assert token_rows(spark, index.postings(grown.blocks(), None)) == {(t, d, s) for t, p in want.items() for d, s in p.items()}
        if k == 30:
            assert len(grown.segments()) == 2 and len(grown.compacted().segments()) == 1
    at_once = index.blocks(frame(spark, rows))
    assert token_rows(spark, index.postings(grown.blocks(), 100)) == token_rows(spark, index.postings(at_once, 100))
    grown.compacted().cleaned()
    assert len(scratch.names(spark, str(tmp_path / "index/segments"))) == 1
    assert token_rows(spark, index.postings(grown.blocks(), 100)) == token_rows(spark, index.postings(at_once, 100))
    assert grown.emptied().n_documents() == 0


def test_segments_take_no_more_than_asked(spark, tmp_path):
    rows = [(k, f"word{k:03} text") for k in range(50)]
    grown = index.Segments(spark, str(tmp_path / "index"), most_documents=30)
    grown.inserted(frame(spark, rows[:20])).inserted(frame(spark, rows[20:]))
    assert grown.n_documents() == 30
    assert {k for _, k, _ in token_rows(spark, index.postings(grown.blocks(), None))} == set(range(30))
    assert grown.inserted(frame(spark, [(99, "more")])).n_documents() == 30


def test_an_unfinished_insert_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    grown = index.Segments(spark, path).inserted(frame(spark, [(1, "one two")]))
    frame(spark, [(2, "lost")]).write.parquet(f"{path}/segments/s00000002")  # its list was never written
    (tmp_path / "index/lists/v00000002").mkdir()
    assert index.Segments(spark, path).segments() == ["s00000001"]
    grown.inserted(frame(spark, [(3, "three")]))
    assert grown.n_documents() == 2 and len(grown.segments()) == 2


@pytest.fixture
def found_by_all(spark):
    """What a search by all postings finds, and how it did."""

    def of(rows, queries, k, parts=3):
        ix = scratch.stored(index.blocks(frame(spark, rows).repartition(parts)))
        asked = scratch.stored(index.asked_tokens(frame(spark, queries), "doc_id", "text"))
        return sorted(map(tuple, index.search_all(asked, ix, k).collect()))

    return of


@pytest.mark.parametrize("sent", [0, index.SENT_TOKENS])
def test_search_by_all_postings(found_by_all, monkeypatch, sent):
    """With queries sent to the workers, in several parts, and joined."""
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 16)
    monkeypatch.setattr(index, "SENT_TOKENS", sent)
    monkeypatch.setattr(index, "AT_ONCE", (3, 5))
    rows = [*corpus(4, 400), (5000, None), (5001, "")]
    queries = [(k, t[: 5 + 9 * k]) for k, (_, t) in enumerate(rows[:400:40])] + [(99, "zzz"), (98, None), (100, f"{rows[40][1]} {rows[40][1]}")]
    assert found_by_all(rows, queries, 4) == plain_search(plain_postings(rows), [q for q in queries if q[1]], 4)


@pytest.mark.parametrize("sent", [0, index.SENT_TOKENS])
def test_search_by_all_postings_finds_what_scores_nothing(found_by_all, monkeypatch, sent):
    """A token of every document has the score 0; ties go to smaller ids, in whatever run they are."""
    monkeypatch.setattr(index, "RUN_DOCUMENTS", 256)
    monkeypatch.setattr(index, "SENT_TOKENS", sent)
    rows = [(k, f"ab w{k % 7:03}") for k in range(3000)] + [(-5, "ab rare"), (-9, "ab"), (7000, "cd")]
    want = plain_search(plain_postings(rows), queries := [(1, "ab"), (2, "rare ab"), (3, "cd")], 6)
    assert {s for q, _, s, _ in want if q == 1} == {0}
    assert found_by_all(rows, queries, 6) == want


def test_search_by_all_postings_of_nothing(found_by_all):
    assert found_by_all([(1, "one")], [(1, None)], 3) == found_by_all([(1, "?")], [(1, "one")], 3) == []


def test_scores_of_arrays_are_those_of_columns(spark):
    scores = [abs(w / 1000 + d) for w in (0, 1, 7, 0.5, 64_999, 65_535, 70_000) for d in (0.0, 4e-13, -4e-13, 6e-13, -6e-13, 1e-11, -1e-11, 5e-4)]
    want = spark.createDataFrame([(s,) for s in scores], "s double").select(index.fixed_point(F.col("s"))).collect()
    assert list(index.fixed_points(np.array(scores))) == [r[0] for r in want]
