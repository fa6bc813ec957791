"""Readers of the rule, corpus and log files. Paths may lie in any store that Spark knows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schemas
from riskspark.sources.endpoints import rule_updates


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has a file, asked of the path's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of the paths that exists, such as the newest version of a file."""
    return next((p for p in paths if exists(spark, p)), None)


def or_empty(spark: SparkSession, path: str, reader, schema: T.StructType) -> DataFrame:
    """What the reader reads, or an empty table if there is nothing at the path."""
    return reader(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``domain, reason, source``."""
    return spark.read.schema(schemas.RULE_FILE).option("multiLine", True).json(path)


def seed_rules(rules: DataFrame, whitelist: DataFrame, blacklist: DataFrame, added_at: int) -> DataFrame:
    """The stored rules, or those of the files if none is stored."""
    def of(df: DataFrame, category: str) -> DataFrame:
        return df.select(
            "domain", F.lit(category).alias("category"), "source",
            F.lit(added_at).cast("bigint").alias("addedAt"), F.lit(1.0).cast("float").alias("confidence"),
        )

    return of(whitelist, "WHITELIST").unionByName(of(blacklist, "BLACKLIST")) if rules.isEmpty() else rules


def keyword_list(spark: SparkSession, path: str, default: Sequence[str] = ()) -> list[str]:
    """The words of a JSON list, or the default. Word lists are configuration: they are
    held on the driver and may have 100,000 entries at most."""
    if not exists(spark, path):
        return list(default)
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("w"))
    words = [r["w"] for r in raw.limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("a keyword list has more than 100,000 words")
    return words or list(default)


def csv_with_header(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV file or a folder of them; quoted fields may hold line feeds."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Tab-separated rows after a header; rows of fewer fields are dropped."""
    raw = spark.read.text(path).where(F.col("value") != "")
    fields = F.split("value", "\t")
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    rows = raw.select(fields.alias("f"), (first & F.startswith(F.lower("value"), F.lit(names[0].lower()))).alias("head"))
    rows = rows.where(~F.col("head") & (F.size("f") >= len(names)))
    return rows.select(*[F.trim(F.col("f")[k]).alias(x) for k, x in enumerate(names)])


def labelled_lines(spark: SparkSession, path: str, fields: int = 2, labels: Sequence[str] | None = None) -> DataFrame:
    """``label`` and ``text`` of ``label<tab>text`` lines (of ``fields`` parts, the text
    being the second); lines of fewer parts are dropped. Broken UTF-8 is replaced."""
    raw = spark.read.text(path)
    parts = F.split(F.make_valid_utf8("value"), "\t", fields)
    df = raw.select(parts.alias("p")).where(F.size("p") >= fields)
    df = df.select(F.col("p")[0].alias("label"), F.trim(F.col("p")[1]).alias("text"))
    return df.where(F.col("label").isin(list(labels))) if labels is not None else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines of a feed or of a folder of files."""
    return spark.read.text(path).select(F.trim(F.make_valid_utf8("value")).alias("text")).where("text != ''")


def union_all(frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of all frames, tagged with their source."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def rules_diff(spark: SparkSession, path_or_url: str) -> DataFrame:
    """A rule update (adds, removes, signature), from a landed file or an endpoint."""
    if path_or_url.startswith(("http://", "https://")):
        return rule_updates(spark, path_or_url).select("adds", "removes", "signature")
    return spark.read.schema(schemas.RULES_DIFF).option("multiLine", True).json(path_or_url)


def phish_feed(spark: SparkSession, path: str) -> DataFrame:
    """Verified entries of a phishing feed."""
    return spark.read.schema(schemas.PHISH_FEED).option("multiLine", True).json(path).where("verified")


def stream_of(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json") -> DataFrame:
    """New files of a folder as a stream: messages, packets, usage events or log lines."""
    r = spark.readStream.format(kind)
    return (r if kind == "text" else r.schema(schema)).load(path)


