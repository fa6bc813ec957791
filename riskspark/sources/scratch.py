"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``. Only a local master, whose
    executors are the driver, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"{tempfile.gettempdir()}/riskspark").rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder; what is written there goes at the program's end at the latest."""
    path = f"{shared_folder(spark)}/riskspark-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """The table, written as Parquet and read again, so that its lineage ends there."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete what :func:`stored` wrote of these tables."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path in _written:
            delete(_written.pop(path), path)


def files(spark: SparkSession, path: str) -> tuple:
    """The path for the file system that holds it, and that file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = files(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    at, fs = files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


@atexit.register
def _delete_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for path in list(_written):
            delete(_written.pop(path), path)
