"""Data sources beyond files at rest: rule updates of an endpoint, lines appended to files."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, InputPartition

from riskspark.sources.indexfile import store

#: Tries of a request, and seconds before the second one, doubled each time.
TRIES, PAUSE_S = 5, 0.5
#: Answers after which a request is tried again.
TRY_AGAIN = (408, 425, 429, 500, 502, 503, 504)
#: Bytes of appended lines that a task reads.
SPLIT_BYTES = 1 << 26
LOOK_BACK = 1 << 16


def answer(url: str, headers: dict[str, str], tries: int, pause_s: float, timeout_s: float) -> tuple[int, bytes]:
    """Status and body; refused connections, time-outs and busy servers are asked again."""
    from urllib.error import HTTPError, URLError
    from urllib.request import Request, urlopen

    for n in range(1, tries + 1):
        wait = pause_s * 2 ** (n - 1)
        try:
            with urlopen(Request(url, headers=headers), timeout=timeout_s) as got:
                return got.status, got.read()
        except HTTPError as e:
            if e.code == 304:
                return 304, b""
            if e.code not in TRY_AGAIN or n == tries:
                raise
            after = e.headers.get("Retry-After") or ""
            wait = max(wait, float(after)) if after.isdigit() else wait
        except (URLError, TimeoutError, ConnectionError):
            if n == tries:
                raise
        time.sleep(wait)
    raise AssertionError("no try was made")


class RuleUpdates(DataSource):
    """``spark.read.format("rule_updates").option("url", ...)``: the diff that leads to the
    endpoint's latest version, a row for each of its pages. The option ``localVersion`` is sent
    along, so that nothing is fetched if nothing is newer. With the option ``pushFilters``
    (and ``spark.sql.python.filterPushdown.enabled``) a filter ``version > '...'`` does the same."""

    @classmethod
    def name(cls) -> str:
        return "rule_updates"

    def schema(self) -> str:
        return "version string, page int, adds array<string>, removes array<string>, signature string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        pushed = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (_FilteredRuleReader if pushed else _RuleReader)(dict(self.options))


class _RuleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.local, self.only = options["url"].rstrip("/"), options.get("localversion", options.get("localVersion", "")), None
        self.ask = (int(options.get("tries", TRIES)), float(options.get("pause", PAUSE_S)), float(options.get("timeout", "10")))

    def partitions(self) -> Sequence[InputPartition]:
        _, body = answer(f"{self.url}/api/rules/latest-version", {}, *self.ask)
        version = json.loads(body)["version"]
        newer = version != self.local and (self.only is None or version == self.only)
        return [InputPartition(version)] if newer else [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        page, following = 0, f"{self.url}/api/rules/diff"
        while following:
            status, body = answer(following, {"If-None-Match": self.local}, *self.ask)
            if status == 304:
                return
            found = json.loads(body)
            yield partition.value, page, list(found.get("adds") or []), list(found.get("removes") or []), found.get("signature")
            page += 1
            following = found.get("next") and (found["next"] if "://" in found["next"] else self.url + found["next"])


class _FilteredRuleReader(_RuleReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("version",):
                self.local = f.value
                yield f  # versions are compared as strings by Spark too, as the filter says
            elif isinstance(f, EqualTo) and f.attribute == ("version",):
                self.only = f.value
                yield f
            else:
                yield f


def rule_updates(spark: SparkSession, url: str, local_version: str = "", tries: int = TRIES, pause_s: float = PAUSE_S) -> DataFrame:
    """``version, adds, removes, signature``: one row with all pages of the update, none if the local version is the latest."""
    spark.dataSource.register(RuleUpdates)
    rows = spark.read.format("rule_updates").options(url=url, localVersion=local_version, tries=tries, pause=pause_s).load()
    in_turn = F.sort_array(F.collect_list(F.struct("page", "adds", "removes", "signature")))
    made = rows.groupBy("version").agg(in_turn.alias("p"))
    return made.select("version", F.flatten("p.adds").alias("adds"), F.flatten("p.removes").alias("removes"), F.element_at("p", -1)["signature"].alias("signature"))


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    end: int


class AppendedLines(DataSource):
    """``spark.readStream.format("appended_lines")``: the lines that are appended to the files
    of a folder, each once: ``file, offset, value``. Offsets are bytes up to the last line feed, so a
    line that is still being written waits. A file that has become shorter is read anew."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _AppendedReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


class _AppendedReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, at = store(self.path)
        info = files.get_file_info(at)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return {f.path: end for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", ".")) and (end := self._whole_lines(files, f)) is not None}

    def _whole_lines(self, files: pafs.FileSystem, info: pafs.FileInfo) -> int | None:
        """Where the last line feed of a file is, which may be far back in a long line."""
        end = info.size
        with files.open_input_file(info.path) as f:
            while end > 0:
                begin = max(0, end - LOOK_BACK)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts: list[InputPartition] = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            if stop < begin:
                begin = 0
            parts += [Stretch(path, a, min(a + self.split_bytes, stop)) for a in range(begin, stop, self.split_bytes)]
        return parts

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the stretch. One that goes on behind it is read to its end."""
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as f:
            at, held = partition.begin, b""
            if at:  # a line begins here if a line feed is before it
                f.seek(at - 1)
                at, held = at - 1, None
            else:
                f.seek(0)
            values, offsets = [], []
            while True:
                data = f.read(1 << 20)
                if not data:
                    break
                if held is None:
                    cut = data.find(b"\n")
                    if cut < 0:
                        at += len(data)
                        continue
                    at, data, held = at + cut + 1, data[cut + 1 :], b""
                *lines, held = (held + data).split(b"\n")
                done = False
                for line in lines:
                    if at >= partition.end:
                        done = True
                        break
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    offsets.append(at)
                    at += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values)), pa.array(offsets, pa.int64()), pa.array(values)], names=["file", "offset", "value"])
                    values, offsets = [], []
                if done or at >= partition.end:
                    break

    def commit(self, end: dict) -> None:
        pass


def appended_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of the lines appended to a file or to the files of a folder."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("splitBytes", split_bytes).load(path)


def records(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The JSON objects of lines as columns; what is no such object is left out."""
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok").select("r.*")


def packets(lines: DataFrame) -> DataFrame:
    """``device, ms, packet`` of lines with base64 payloads (null if broken)."""
    rows = records(lines, "device string, ms long, packet string")
    return rows.withColumn("packet", F.try_to_binary("packet", F.lit("base64")))


def usage_events(lines: DataFrame) -> DataFrame:
    """``device, app, kind, ms`` of screen use."""
    return records(lines, "device string, app string, kind int, ms long")


def messages(lines: DataFrame) -> DataFrame:
    """``device, sender, body, ms`` of received messages; those without a body are left out."""
    return records(lines, "device string, sender string, body string, ms long").where("body IS NOT NULL")
