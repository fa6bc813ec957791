"""Folds over streams in order of event time, with typed keyed state.

Events may come in any order within the watermark. They wait in the state of their key
until the watermark has passed them, and are then folded by time and tie, so that the
result does not depend on how micro-batches cut the stream. State lives in the state store:
a query that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``fold(state, events)``: the state (a tuple, or None at first) after events (dicts, in
#: order), and what they give. The state is gone once ``lasts(state)`` (ms; None: never) has passed.
Fold = Callable[[tuple | None, list[dict]], tuple[tuple, list[tuple]]]
Lasts = Callable[[tuple], int | None]


class OrderedFold(StatefulProcessor):
    """Keeps events until the watermark has passed them, then folds them in order."""

    def __init__(self, key: str, time_ms: str, tie: str, event: T.StructType, state: str, out: T.StructType, fold: Fold, lasts: Lasts | None):
        self.key, self.time_ms, self.tie, self.event, self.state, self.out = key, time_ms, tie, event, state, out
        self.fold, self.lasts = fold, lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {f.name: f.dataType for f in self.event}
        order = T.StructType([T.StructField("ms", T.LongType()), T.StructField("tie", kinds[self.tie])])
        self.handle, self.names = handle, [f.name for f in self.event if f.name not in (self.time_ms, self.tie)]
        rest = T.StructType([f for f in self.event if f.name in self.names])
        self.pending = handle.getMapState("pending", order, rest)
        self.folded = handle.getValueState("folded", self.state)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        latest = None
        for batch in rows:
            for event in batch.to_dict("records"):
                ms = int(event[self.time_ms])
                if until is not None and ms <= until:
                    continue  # too late: what comes after it has been folded
                self.pending.updateValue((ms, event[self.tie]), tuple(_plain(event[n]) for n in self.names))
                latest = ms if latest is None else max(latest, ms)
        if latest is not None:
            self.handle.registerTimer(latest)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.pending.iterator() if k[0] <= now)
        state, made = (tuple(self.folded.get()) if self.folded.exists() else None), []
        if due:
            events = [{self.time_ms: k[0], self.tie: k[1], **dict(zip(self.names, v, strict=True))} for k, v in due]
            state, made = self.fold(state, events)
            for k, _ in due:
                self.pending.removeKey(k)
            self.folded.update(state)
            self.until.update((due[-1][0][0],))
        if state is not None and self.lasts is not None and (end := self.lasts(state)) is not None:
            if end <= now:  # later events are folded as if it had never been
                self.folded.clear()
                self.until.clear()
            elif due:
                self.handle.registerTimer(end)
        yield self._frame(key, made)

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        made = [(key[0], *row) for row in rows]
        return pd.DataFrame(made, columns=[f.name for f in self.out])

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def needs_state_store(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"folds over streams need {PROVIDER} = {ROCKSDB}")


def folded(events: DataFrame, key: str, time_ms: str, tie: str, fold: Fold, state: str, out: str, late: str = "10 minutes", lasts: Lasts | None = None) -> DataFrame:
    """``key`` and the columns ``out`` that the fold gives, as a stream.

    ``time_ms`` are milliseconds (rows without are left out); with ``tie`` they tell a key's
    events apart: an event that comes twice counts once. Events later than ``late`` (the
    watermark's delay) after newer ones may be dropped, as in any watermarked stream.
    """
    needs_state_store(events.sparkSession)
    rows = events.where(F.col(time_ms).isNotNull()).withColumn(time_ms, F.col(time_ms).cast("long"))
    event = T.StructType([f for f in rows.schema if f.name != key])
    timed = rows.withColumn("_at", F.timestamp_millis(F.col(time_ms))).withWatermark("_at", late)
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(out)])
    processor = OrderedFold(key, time_ms, tie, event, state, schema, fold, lasts)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "eventTime")
