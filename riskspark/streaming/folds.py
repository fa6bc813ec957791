"""Ordered folds over event streams: batch replays and their streaming twins.

The folds are serial for a device by nature (a suppressed event does not restart a
clock), but a silence longer than every clock ends what came before: what lies between
such silences runs in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.streaming.ordered import folded

# Seconds of the global limiter, of an entry's life, of an idle gap.
GLOBAL_S, FORGET_S, IDLE_S = 5, 600, 120
# Of the threshold recurrence.
MOMENTUM, RATE, BASE_SUSPICIOUS, BASE_DANGEROUS = (np.float32(x) for x in (0.9, 0.1, 0.10, 0.50))
MOST_SUSPICIOUS, MOST_DANGEROUS, DECAY_EVERY, DECAY = np.float32(0.30), np.float32(0.20), 10, np.float32(0.95)
LEAST_DANGEROUS = np.float32(0.40)


class Cooldown:
    """What was launched when, by key, and last of all."""

    def __init__(self, last: dict[str, int] | None = None, launched: int | None = None):
        self.last, self.launched = last or {}, launched

    def launches(self, key: str, at_ms: int, cooldown_s: float, limited: bool) -> bool:
        """Whether an event launches. Only a launch starts the clocks; a key that has
        been silent for ``FORGET_S`` is forgotten."""
        before = self.last.get(key)
        if cooldown_s > 0 and before is not None and at_ms - before < cooldown_s * 1000:
            return False
        if limited and self.launched is not None and at_ms - self.launched < GLOBAL_S * 1000:
            return False
        self.last[key] = at_ms
        if limited:
            self.launched = at_ms
        for k in [k for k, t in self.last.items() if at_ms - t > FORGET_S * 1000 and cooldown_s < FORGET_S]:
            del self.last[k]
        return True


#: Events of a piece, about: pieces of a device are folded apart from each other.
PIECE_EVENTS = 20_000


def pieces(events: DataFrame, device: str, time_ms: str, gap_ms: int, most: int | None = None) -> DataFrame:
    """``device, bucket, piece`` of the stretches of time (``gap_ms`` each) that have events.

    A piece begins after a silence of ``gap_ms`` or more, when no clock that is shorter can
    still run, so a device's pieces do not depend on each other. Short ones are put together
    up to about ``most`` events. Only counted stretches are ordered by device, not events.
    """
    times = events.groupBy(device, F.floor(F.col(time_ms) / gap_ms).alias("bucket"))
    times = times.agg(F.min(time_ms).alias("first"), F.max(time_ms).alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(device).orderBy("bucket")
    silent = F.col("first") - F.lag("last").over(w) >= gap_ms
    before = F.sum("n").over(w) - F.col("n")
    times = times.withColumn("begins", F.coalesce(silent, F.lit(True))).withColumn("at", F.floor(before / F.lit(most or PIECE_EVENTS)))
    return times.select(device, "bucket", F.max(F.when(F.col("begins"), F.col("at"))).over(w).alias("piece"))


def replay_cooldown(events: DataFrame, device: str, key: str, time_ms: str, tie: str, cooldown: str, limited: str | None = None) -> DataFrame:
    """All columns and ``launched``. Events of a device are taken in order of time and
    ``tie``; ``cooldown`` is a column of seconds. With ``limited`` (a boolean column) the
    events marked there also share the global limiter. A device that has fallen silent for
    longer than any cooldown starts anew, so its events are folded in :func:`pieces`, several
    small ones in one task. Events without a time have a null ``launched``."""
    schema = T.StructType([*events.schema.fields, T.StructField("launched", T.BooleanType())])
    timed = events.where(F.col(time_ms).isNotNull())
    total, longest = timed.agg(F.count(F.lit(1)), F.max(cooldown)).first()
    gap_ms = int(1000 * max(float(longest or 0), GLOBAL_S)) + 1
    cut = pieces(timed, device, time_ms, gap_ms).select(F.col(device).alias("_device"), F.col("bucket").alias("_bucket"), F.col("piece").alias("_piece"))
    met = F.col(device).eqNullSafe(F.col("_device")) & (F.floor(F.col(time_ms) / gap_ms) == F.col("_bucket"))
    rows = timed.join(cut, met).drop("_device", "_bucket")
    groups = max(1, -(-total // PIECE_EVENTS))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(device, "_piece"), F.lit(groups)))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([device, "_piece", time_ms, tie], kind="stable", ignore_index=True)
        new = (group[device].ne(group[device].shift()) & ~(group[device].isna() & group[device].shift().isna())) | group["_piece"].ne(group["_piece"].shift())
        marks = group[limited].tolist() if limited else [False] * len(group)
        launched, state = [], Cooldown()
        for first, k, t, c, m in zip(new.tolist(), group[key], group[time_ms], group[cooldown], marks, strict=True):
            if first:
                state = Cooldown()
            launched.append(state.launches(str(k), int(t), float(c), bool(m)))
        group["launched"] = launched
        return group.drop(columns=["_piece", "_group"])

    replayed = rows.groupBy("_group").applyInPandas(fold, schema)
    return replayed.unionByName(events.where(F.col(time_ms).isNull()).withColumn("launched", F.lit(None).cast("boolean")))


#: Milliseconds between two scans, and between two looks at a frame.
SCAN_MS, FRAME_MS = 1500, 500


def debounced(events: DataFrame, device: str, time_ms: str, tie: str, interval_ms: int = SCAN_MS) -> DataFrame:
    """All columns and ``taken``: whether the event comes ``interval_ms`` or more after the
    last one of its device that was taken."""
    rows = events.withColumns({"_key": F.lit("scan"), "_pause": F.lit(interval_ms / 1000)})
    return replay_cooldown(rows, device, "_key", time_ms, tie, "_pause").withColumnRenamed("launched", "taken").drop("_key", "_pause")


def stream_cooldown(events: DataFrame, device: str, key: str, time_ms: str, tie: str, cooldown: str, late: str = "10 minutes") -> DataFrame:
    """The same fold on a stream, with the global limiter for all events: ``device, key,
    time_ms, tie, launched``. Events are folded in order of event time; a device's state goes
    when it has been silent for ten minutes of event time, or for its longest cooldown if that is more."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def fold(state: tuple | None, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        names, times, launched, longest, latest = state or ([], [], None, float(FORGET_S), 0)
        c, made = Cooldown(dict(zip(names, times, strict=True)), launched), []
        for r in rows:
            made.append((r[key], r[time_ms], r[tie], c.launches(str(r[key]), int(r[time_ms]), float(r[cooldown]), True)))
            longest, latest = max(longest, float(r[cooldown])), int(r[time_ms])
        return (list(c.last), list(c.last.values()), c.launched, longest, latest), made

    return folded(
        events.select(device, key, time_ms, tie, cooldown), device, time_ms, tie, fold,
        "names array<string>, times array<long>, launched long, longest double, latest long",
        f"{key} {kinds[key]}, {time_ms} long, {tie} {kinds[tie]}, launched boolean",
        late, lambda state: int(state[4] + 1000 * state[3]) + 1,
    )


class Calibration:
    """Biases of both thresholds after so many feedback rows."""

    def __init__(self, n: int = 0, suspicious: float = 0.0, dangerous: float = 0.0):
        self.n, self.suspicious, self.dangerous = n, np.float32(suspicious), np.float32(dangerous)

    def add(self, score: float, bad: bool) -> None:
        """Every tenth row shrinks the biases, then a missed phishing pulls one and a false
        alarm pushes the other."""
        self.n += 1
        score = np.float32(score)
        if self.n % DECAY_EVERY == 0:
            self.suspicious, self.dangerous = self.suspicious * DECAY, self.dangerous * DECAY
        if bad and score < BASE_DANGEROUS:
            pull = MOMENTUM * self.dangerous + (np.float32(1) - MOMENTUM) * ((score - BASE_DANGEROUS) * RATE)
            self.dangerous = min(max(pull, -MOST_DANGEROUS), MOST_DANGEROUS)
        elif not bad and score > BASE_SUSPICIOUS:
            push = MOMENTUM * self.suspicious + (np.float32(1) - MOMENTUM) * ((score - BASE_SUSPICIOUS) * RATE)
            self.suspicious = min(max(push, np.float32(0)), MOST_SUSPICIOUS)

    def thresholds(self) -> tuple[float, float]:
        return (
            float(np.clip(BASE_SUSPICIOUS + self.suspicious, BASE_SUSPICIOUS, BASE_SUSPICIOUS + MOST_SUSPICIOUS)),
            float(np.clip(BASE_DANGEROUS + self.dangerous, LEAST_DANGEROUS, BASE_DANGEROUS + MOST_DANGEROUS)),
        )


def calibrated(scores: list[float], phishing: list[bool]) -> tuple[float, float]:
    """Both thresholds after feedback in order."""
    c = Calibration()
    for score, bad in zip(scores, phishing, strict=True):
        c.add(score, bad)
    return c.thresholds()


def calibrate(feedback: DataFrame, device: str, time: str, tie: str, score: str = "modelScore", label: str = "label") -> DataFrame:
    """``device, n, suspicious, dangerous``: the thresholds after all of a device's feedback.
    The recurrence is serial for a device; its rows are sorted by Spark and pass through in
    batches, so that a device of any size takes a batch's memory."""
    kind = feedback.schema[device].dataType.simpleString()
    rows = feedback.select(F.col(device).alias("device"), F.col(score).cast("double").alias("score"), (F.col(label) == "PHISHING").alias("bad"), F.col(time).alias("time"), F.col(tie).alias("tie"))
    rows = rows.repartition("device").sortWithinPartitions("device", "time", "tie").select("device", "score", "bad")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row() -> tuple:
            return (held, c.n, *c.thresholds())

        held, c = None, Calibration()
        for batch in batches:
            done = []
            for d, s, b in zip(batch["device"].tolist(), batch["score"].tolist(), batch["bad"].tolist(), strict=True):
                d = None if d != d else d
                if c.n and d != held:
                    done.append(row())
                    c = Calibration()
                held = d
                c.add(s, bool(b))
            if done:
                yield _thresholds(done, device)
        if c.n:
            yield _thresholds([row()], device)

    return rows.mapInPandas(fold, f"{device} {kind}, n long, suspicious double, dangerous double")


def _thresholds(rows: list[tuple], device: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[device, "n", "suspicious", "dangerous"])
    out[device] = pd.Series([r[0] for r in rows], dtype=object)
    return out


def stream_calibrate(feedback: DataFrame, device: str, time_ms: str, tie: str, score: str = "modelScore", label: str = "label", late: str = "10 minutes") -> DataFrame:
    """The same recurrence on a stream: ``device, n, suspicious, dangerous, as_of`` each time
    the watermark has passed new feedback; the latest row of a device is its state."""

    def fold(state: tuple | None, rows: list[dict]) -> tuple[tuple, list[tuple]]:
        c = Calibration(*(state or ()))
        for r in rows:
            c.add(r[score], r[label] == "PHISHING")
        return (c.n, float(c.suspicious), float(c.dangerous)), [(c.n, *c.thresholds(), rows[-1][time_ms])]

    rows = feedback.select(device, time_ms, tie, F.col(score).cast("double").alias(score), label)
    return folded(rows, device, time_ms, tie, fold, "n long, suspicious double, dangerous double", "n long, suspicious double, dangerous double, as_of long", late)


def counts_by_type(events: DataFrame, kind: str) -> DataFrame:
    """Running counts; as a stream, in complete or update mode."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes") -> DataFrame:
    day = F.window(time, "1 day")
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(day.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def first_verdicts(domains: DataFrame, key: str, time: str, ttl: str = "5 minutes") -> DataFrame:
    """A stream in which a key comes through once in its cache time."""
    return domains.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def idle_gaps(events: DataFrame, device: str, time: str, gap_s: int = IDLE_S, late: str = "10 minutes") -> DataFrame:
    """``device, idle_from``: where nothing came for ``gap_s`` seconds (sessions' ends
    less the gap); in a stream a gap is told when the watermark has passed it."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    s = F.session_window(time, f"{gap_s} seconds")
    ends = df.groupBy(device, s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return ends.select(device, (F.col("s.end") - F.expr(f"interval {gap_s} seconds")).alias("idle_from"), "n")


PUT, READ = 0, 1


def _tagged(payloads: DataFrame, reads: DataFrame, key: str, time_ms: str) -> DataFrame:
    """Both inputs as one: payloads come before reads of the same time."""
    p = payloads.select(F.col(key).alias("key"), F.col(time_ms).cast("long").alias("ms"), F.lit(PUT).alias("kind"), "payload")
    r = reads.select(F.col(key).alias("key"), F.col(time_ms).cast("long").alias("ms"), F.lit(READ).alias("kind"), F.lit(None).cast(payloads.schema["payload"].dataType).alias("payload"))
    return p.unionByName(r)


def consumed_once(payloads: DataFrame, reads: DataFrame, key: str, time_ms: str, ttl_ms: int = 60_000) -> DataFrame:
    """``key, payload, written, read``: the first read of each payload within its life.
    A later payload of the key takes the place of the one before (of equal times the
    greatest counts). What consumes a payload is the very next thing that happens to its
    key, so it lies in the same stretch of ``ttl_ms`` or the next: each stretch of a key is
    looked at apart, with the beginning of the one after it. Null keys and times are left out."""
    rows = _tagged(payloads, reads, key, time_ms).where("key IS NOT NULL AND ms IS NOT NULL")
    stretch = F.floor(F.col("ms") / ttl_ms)
    rows = rows.withColumn("stretch", F.explode(F.array(stretch, stretch - 1))).withColumn("own", F.col("stretch") == stretch)
    w = Window.partitionBy("key", "stretch").orderBy("ms", "kind", "payload")
    rows = rows.withColumns({"next": F.lead("ms").over(w), "next_kind": F.lead("kind").over(w)})
    used = rows.where(F.col("own") & (F.col("kind") == PUT) & (F.col("next_kind") == READ) & (F.col("next") - F.col("ms") <= ttl_ms))
    return used.select(F.col("key").alias(key), "payload", F.col("ms").alias("written"), F.col("next").alias("read"))


def stream_consumed_once(payloads: DataFrame, reads: DataFrame, key: str, time_ms: str, ttl_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """The same on two streams, of one state a key: ``key, payload, written, read``. A payload
    is gone when it has been read, replaced or, by event time, outlived."""
    kind = payloads.schema["payload"].dataType.simpleString()
    rows = _tagged(payloads, reads, key, time_ms).where("key IS NOT NULL").withColumnRenamed("key", key)
    rows = rows.withColumn("tie", F.concat_ws(":", "kind", F.col("payload").cast("string")))

    def fold(state: tuple | None, events: list[dict]) -> tuple[tuple, list[tuple]]:
        (payload, written), made = state or (None, None), []
        for e in events:
            if e["kind"] == PUT:
                payload, written = e["payload"], e["ms"]
            elif written is not None:
                if e["ms"] - written <= ttl_ms:
                    made.append((payload, written, e["ms"]))
                payload = written = None
        return (payload, written), made

    return folded(rows, key, "ms", "tie", fold, f"payload {kind}, written long", f"payload {kind}, written long, read long", late,
                  lambda state: 0 if state[1] is None else state[1] + ttl_ms + 1)
