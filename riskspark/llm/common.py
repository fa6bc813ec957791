"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns in one struct, so that no name clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("_all")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: what the session names in ``spark.checkpoint.dir``.
    Only a local master, whose executors are the driver, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"{tempfile.gettempdir()}/riskspark").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, for what a result goes on reading."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """The table, written as Parquet in the shared folder, for what :func:`dropped`
    deletes when it is no longer read (at the program's end at the latest)."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/riskspark-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete what :func:`stored` wrote of these tables."""
    for df in tables:
        _delete(getattr(df, "stored_at", None) if df is not None else None)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete(path: str | None) -> None:
    if path in _written:
        delete_folder(_written.pop(path), path)


@atexit.register
def _delete_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for path in list(_written):
            _delete(path)


def numbered(df: DataFrame) -> DataFrame:
    """The rows in one column ``_all`` and their numbers in ``row``. A number is a row's
    place in the files that are scanned, which a task that is run again reads alike; rows
    that come from anything but a scan with its filters and columns are stored first."""

    def scan(plan) -> bool:
        kind, below = plan.nodeName(), plan.children()
        if below.isEmpty():
            return "Relation" in kind and "LocalRelation" not in kind
        return kind in ("Project", "Filter") and plan.deterministic() and scan(below.head())

    rows = df.select(whole_row(df))
    if not scan(df._jdf.queryExecution().optimizedPlan()):
        rows = checkpointed(rows)
    return rows.withColumn("row", F.monotonically_increasing_id())


#: Rows of an Arrow batch of whole texts.
BATCH_TEXTS = 1024


def small_batches(spark: SparkSession) -> None:
    """From now on workers get whole texts in batches of ``BATCH_TEXTS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_TEXTS)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While jobs run inside, an Arrow batch has at most so many rows (of large values)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_stores: dict[str, Callable[[], None]] = {}


def own_worker(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called where an operator's task begins in a Python worker: what other operators
    keep there is forgotten, so that stages that follow each other do not add up. An
    operator that keeps something says how it is forgotten."""
    for other in [o for o in _stores if o != owner]:
        _stores.pop(other)()
    if forget is not None:
        _stores[owner] = forget
