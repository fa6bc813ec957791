"""Streams against their batch folds: shuffled micro-batches, restarts, expiry; hot devices in pieces."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.streaming import folds, ordered

FAR = 10**12


@pytest.fixture
def states(spark):
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    yield spark
    spark.conf.set(ordered.PROVIDER, before)


class Feed:
    """Files that a stream reads one a micro-batch, and what it has given so far."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.schema, self.made, self.n = spark, folder, schema, made, 0
        (folder / "in").mkdir(parents=True)

    def put(self, *batches):
        names = [c.split()[0] for c in self.schema.split(", ")]
        for rows in batches:
            self.n += 1
            part = self.folder / f"part{self.n}"
            part.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
            os.utime(part, (1_700_000_000 + self.n,) * 2)  # a source takes the oldest file first
            part.rename(self.folder / "in" / f"{self.n:04}.json")

    def run(self):
        """One start of the query: it reads what is new and stops, as after a lost driver."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        q = self.made(stream).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp"))
        assert q.trigger(availableNow=True).start().awaitTermination(300)
        return self.spark.read.parquet(str(self.folder / "out"))


def shuffled(rows, seed, parts, reach):
    """Batches of the rows, out of order by ``reach`` places at most."""
    r = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + r.random() * reach)
    size = -(-len(rows) // parts)
    return [[rows[k] for k in order[a : a + size]] for a in range(0, len(rows), size)]


def feedback(seed, n=120):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3]), 1000 * k + 1, k, r.random(), r.choice(["PHISHING", "FALSE_POSITIVE"])) for k in range(n)]


def test_thresholds_as_a_stream(states, tmp_path):
    schema = "device long, ms long, tie long, modelScore double, label string"
    rows = feedback(1)
    want = {r.device: (r.n, r.suspicious, r.dangerous) for r in folds.calibrate(states.createDataFrame(rows, schema), "device", "ms", "tie").collect()}
    feed = Feed(states, tmp_path, schema, lambda s: folds.stream_calibrate(s, "device", "ms", "tie", late="60 seconds"))
    batches = shuffled(rows, 2, 6, 20)
    feed.put(*batches[:3])
    feed.run()
    feed.put(*batches[3:], [rows[-1]])  # a restart from the checkpoint; one row comes twice
    feed.run()
    feed.put([(99, FAR, 0, 0.5, "PHISHING")])
    got = {}
    for r in feed.run().orderBy("as_of").collect():
        got[r.device] = (r.n, r.suspicious, r.dangerous)
    assert {k: v for k, v in got.items() if k != 99} == want


def test_cooldown_as_a_stream(states, tmp_path):
    r = random.Random(3)
    schema = "device long, key string, ms long, tie long, cooldown double"
    times = np.cumsum([r.choice([500, 3000, 9000, 40_000, 900_000]) for _ in range(80)]).tolist()
    rows = [(r.choice([1, 1, 2]), r.choice("ab"), t, k, r.choice([5.0, 10.0])) for k, t in enumerate(times)]
    batch = folds.replay_cooldown(states.createDataFrame(rows, schema).withColumn("limited", F.lit(True)), "device", "key", "ms", "tie", "cooldown", "limited")
    want = {(x.device, x.tie): x.launched for x in batch.collect()}
    feed = Feed(states, tmp_path, schema, lambda s: folds.stream_cooldown(s, "device", "key", "ms", "tie", "cooldown", late="1 hour"))
    feed.put(*shuffled(rows, 4, 4, 6)[:2])
    feed.run()
    feed.put(*shuffled(rows, 4, 4, 6)[2:], [(99, "a", FAR, 0, 1.0)])
    got = {(x.device, x.tie): x.launched for x in feed.run().collect()}
    got.pop((99, 0), None)
    assert got == want and 10 < sum(want.values()) < 80


def payloads_and_reads(seed, n=90):
    r = random.Random(seed)
    return [(r.choice("kkkm"), 7000 * k + 1 + r.randrange(5000), r.choice([f"p{k}", f"p{k}", None])) for k in range(n)]


def plain_consumed(rows, ttl):
    """Puts (with a payload) and reads, one after another."""
    held, out = {}, []
    for key, ms, payload in sorted(rows, key=lambda x: (x[1], x[2] is None, x[2] or "")):
        if payload is not None:
            held[key] = (payload, ms)
        elif key in held:
            p, written = held.pop(key)
            if ms - written <= ttl:
                out.append((key, p, written, ms))
    return sorted(out)


SPLIT = "key string, ms long, payload string"


def both(df):
    return df.where("payload IS NOT NULL").select("key", "ms", "payload"), df.where("payload IS NULL").select("key", "ms")


@pytest.mark.parametrize("ttl", [5_000, 15_000, 60_000])
def test_consumed_once(spark, ttl):
    rows = [*payloads_and_reads(5, 300), ("t", 0, "a"), ("t", 0, "b"), ("t", 0, None), ("t", ttl, "c"), ("t", 2 * ttl, None), ("u", 1, "d"), ("u", ttl + 2, None), ("v", -5, "e"), ("v", 3, None)]
    got = sorted(map(tuple, folds.consumed_once(*both(spark.createDataFrame(rows, SPLIT)), "key", "ms", ttl).collect()))
    assert got == plain_consumed(rows, ttl) and ("t", "b", 0, 0) in got and ("t", "c", ttl, 2 * ttl) in got and not any(g[0] == "u" for g in got)


def test_consumed_once_as_a_stream(states, tmp_path):
    rows = payloads_and_reads(6)
    want = sorted(map(tuple, folds.consumed_once(*both(states.createDataFrame(rows, SPLIT)), "key", "ms").collect()))
    feed = Feed(states, tmp_path, SPLIT, lambda s: folds.stream_consumed_once(*both(s), "key", "ms", late="3 minutes"))
    batches = shuffled(rows, 7, 5, 8)
    feed.put(*batches[:2])
    feed.run()
    feed.put(*batches[2:])
    early = feed.run().count()
    feed.put([("z", FAR, None)])
    got = sorted(map(tuple, feed.run().collect()))
    assert got == want and 0 < early <= len(want)


def test_payloads_expire_by_event_time(states, tmp_path):
    feed = Feed(states, tmp_path, SPLIT, lambda s: folds.stream_consumed_once(*both(s), "key", "ms", late="1 second"))
    feed.put([("a", 1, "x"), ("b", 1, "y")], [("c", 50_000, None)], [("a", 59_000, None)], [("c", 62_000, None)], [("b", 61_000, None)], [("c", FAR, None)])
    assert sorted(map(tuple, feed.run().collect())) == [("a", "x", 1, 59_000)]


def test_streams_say_what_store_they_need(spark):
    rate = spark.readStream.format("rate").load().selectExpr("value AS key", "value AS ms", "value AS payload")
    with pytest.raises(RuntimeError, match="stateStore"):
        folds.stream_consumed_once(rate, rate.select("key", "ms"), "key", "ms")


def clicks(seed, n):
    r = random.Random(seed)
    out, t = [], 0
    for k in range(n):
        t += r.choice([100, 1000, 4000, 20_000, 400_000])
        out.append((r.choice([7, 7, 7, 1, 2, None]), r.choice("abc"), t, k, r.choice([10.0, 300.0]), r.random() < 0.5))
    return out


EVENTS = "device long, key string, ms long, tie long, cooldown double, limited boolean"


@pytest.mark.parametrize("piece_events", [1, 7, 20_000])
def test_pieces_change_nothing(spark, monkeypatch, piece_events):
    monkeypatch.setattr(folds, "PIECE_EVENTS", piece_events)
    rows = clicks(8, 400)
    want, states_ = {}, {}
    for device, key, ms, tie, cooldown, limited in rows:  # all events of a device, one after another
        want[tie] = states_.setdefault(device, folds.Cooldown()).launches(key, ms, cooldown, limited)
    df = spark.createDataFrame(rows, EVENTS)
    got = folds.replay_cooldown(df.repartition(5), "device", "key", "ms", "tie", "cooldown", "limited")
    assert got.columns == [*df.columns, "launched"] and {r.tie: r.launched for r in got.collect()} == want


def test_a_hot_device_runs_in_as_many_pieces_as_it_has_silences(spark):
    rows = [(7, 1000 * (k % 10) + 10_000_000 * (k // 10)) for k in range(500)] + [(k + 100, k) for k in range(400)]
    cut = folds.pieces(spark.createDataFrame(rows, "device long, ms long"), "device", "ms", 300_001, 1)
    assert cut.where("device = 7").select("piece").distinct().count() == 50
    whole = folds.pieces(spark.createDataFrame(rows, "device long, ms long"), "device", "ms", 300_001)
    assert whole.where("device = 7").select("piece").distinct().count() == 1


def test_events_without_time(spark):
    rows = [(1, "a", None, 0, 5.0, False), (1, "a", 0, 1, 5.0, False), (1, "a", 4999, 2, 5.0, False)]
    got = folds.replay_cooldown(spark.createDataFrame(rows, EVENTS), "device", "key", "ms", "tie", "cooldown")
    assert {r.tie: r.launched for r in got.collect()} == {0: None, 1: True, 2: False}


def test_thresholds_of_many_devices_and_batches(spark):
    rows = [*feedback(9, 700), (None, 5, 0, 0.9, "FALSE_POSITIVE")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = {r.device: (r.n, r.suspicious, r.dangerous) for r in folds.calibrate(spark.createDataFrame(rows, "device long, ms long, tie long, modelScore double, label string"), "device", "ms", "tie").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for device in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == device]
        assert got[device] == (len(own), *folds.calibrated([r[3] for r in own], [r[4] == "PHISHING" for r in own]))
