"""Vector codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.llm import queries, vectorcodes

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, label, [math.floor(1024 * c) for c in v]) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def distance(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((distance(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                held = [c[p] for c, o in zip(cut, own, strict=True) if o[p][1] == k]
                if held:
                    books[p][k] = [sum(column) // len(held) for column in zip(*held, strict=True)]
    own = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in o) for o in own]
    by_label = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((r[0], r[1], "".join(f"{k:02x}" for _, k in o), e, by_label[r[1]], digest) for r, o, e in zip(kept, own, error, strict=True)), key=str)


def vectors(seed, n, width, scale=1.0, ties=False):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(width)] for _ in range(7)]
    rows = []
    for k in range(n):
        c = r.choice(centres)
        v = [round(x + r.gauss(0, 0.2 * scale), 1) if ties else x + r.gauss(0, 0.2 * scale) for x in c]
        if rows and r.random() < 0.1:
            v = list(r.choice(rows)[1])
        rows.append((k, v, r.choice([None, 1, 2, 3])))
    r.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("n", "width", "scale", "ties"), [(150, 8, 1.0, False), (200, 8, 0.002, True), (60, 4, 1.0, True), (120, 8, 1e5, False)])
def test_against_brute_force(spark, monkeypatch, n, width, scale, ties):
    monkeypatch.setattr(vectorcodes, "BLOCK_VECTORS", 37)
    rows = vectors(n, n, width, scale, ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vectorcodes.compress(df, entries=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, entries=16)


def test_heaps_skip_what_cannot_change():
    r = np.random.default_rng(3)
    x = (r.normal(0, 4000, (40, 8))[r.integers(0, 40, 3000)] + r.normal(0, 40, (3000, 8))).astype("i8")
    books = vectorcodes.Codebooks(np.stack(np.split(x[:64], 2, axis=1)))
    block = vectorcodes.Block.new(x, books)
    change, compared = block.assign(books, first=True), []
    for _ in range(8):
        some = np.flatnonzero(change.any(1))
        frame = pd.DataFrame({"slot": some, "n": change[some, 0]} | {f"s{k}": change[some, k + 1] for k in range(4)})
        books = books.moved(frame)
        before = block.compared
        change = block.assign(books)
        compared.append(block.compared - before)
        for p in range(2):
            best, near, _ = vectorcodes.nearest(x[:, 4 * p : 4 * p + 4], books.entries[p])
            assert (block.code[:, p] == best).all()
    assert compared[-1] < 3000 and sum(compared) < 30_000  # of 6,000 and 48,000 parts
    heaps = block.heaps
    begin = np.append(0, heaps.ends[:-1])
    for a, z in zip(begin, heaps.ends, strict=True):  # each is a heap, and all parts are in one
        keys = heaps.keys[a:z]
        assert all(keys[(k - 1) // 2] <= keys[k] for k in range(1, len(keys)))
    assert heaps.ends[-1] == 2 * 3000


def test_labels_by_a_shuffle(spark, monkeypatch):
    rows = vectors(9, 50, 4)
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    got = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA), entries=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, entries=8)


def test_edges(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], 1), (4, None, 1), (5, [1.0, None, 3.0, 4.0], 1), (6, [1.0, float("nan"), 0.0, 0.0], 1), (7, [1.0, float("inf"), 0.0, 0.0], 1),
            (8, [1.0, 2.0], None), (None, [-0.5, 1e-9, -1e-9, 1e30], None), (9, [], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "_x", "_v", "code", "error", "x", "ids")})
    got = {}
    for r in vectorcodes.compress(df).collect():
        got.setdefault(r.vec_id, []).append((r.code, r.error, r.label_error))
    assert set(got) == {3, 8, 9, None} and len(got[3]) == 2
    assert got[3] == [("00000000", 0, 0)] * 2 and got[8] == [(None, None, 0)] and got[None] == [("02020202", 0, 0)] and got[9][0][0] is None
    assert vectorcodes.compress(df.limit(0)).count() == 0
    assert {r.code for r in vectorcodes.compress(df.where("vec_id = 8")).collect()} == {None}


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, queries.op13_vector_codes(spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert len(got) == len(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(queries.ORACLES["op13_vector_codes"]).df()
    assert got == sorted(want[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].itertuples(index=False, name=None))
