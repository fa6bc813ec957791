"""Tables of files that are never changed: a version is a list of the files that it has.

What is written takes effect when a new list is complete, as a whole; readers see the last
complete list, and a job that dies leaves files that no list names. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.scratch import delete, names, new_folder, stored


class Lists:
    """Versioned lists of names in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/lists"

    def version(self) -> int:
        done = [v for v in names(self.spark, self.path) if "_SUCCESS" in names(self.spark, f"{self.path}/{v}")]
        return max((int(v.removeprefix("v")) for v in done), default=0)

    def held(self) -> list[str]:
        version = self.version()
        return [r["value"] for r in self.spark.read.text(f"{self.path}/v{version:08}").collect()] if version else []

    def publish(self, held: Sequence[str]) -> None:
        at = f"{self.path}/v{self.version() + 1:08}"
        self.spark.createDataFrame([(h,) for h in held], "value string").coalesce(1).write.mode("overwrite").text(at)

    def forget_old(self) -> None:
        version = self.version()
        for v in names(self.spark, self.path):
            if int(v.removeprefix("v")) < version:
                delete(self.spark, f"{self.path}/{v}")


class FileTable:
    """Rows in Parquet files, changed by key: only files that hold a changed key are written
    again, under new names; all others stay as they are."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key, self.lists = spark, path.rstrip("/"), key, Lists(spark, path)

    def files(self) -> list[str]:
        return self.lists.held()

    def rows(self) -> DataFrame:
        held = self.files()
        if not held:
            raise ValueError(f"no rows were ever written to {self.path}")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in held])

    def _written(self, rows: DataFrame) -> list[str]:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return [f"{name}/{f}" for f in names(self.spark, f"{self.path}/{name}") if f.endswith(".parquet")]

    def created(self, rows: DataFrame) -> FileTable:
        """The table has these rows and no others."""
        self.lists.publish(self._written(rows))
        return self

    def appended(self, rows: DataFrame) -> FileTable:
        self.lists.publish([*self.files(), *self._written(rows)])
        return self

    def _touched(self, keys: DataFrame) -> list[str]:
        """Files with any of the keys (a column ``_key``). Only the key column is read; what
        reaches the driver are names of files."""
        held = self.rows().select(F.col(self.key).alias("_held"), F.col("_metadata.file_path").alias("file"))
        met = held.join(keys, F.col("_held").eqNullSafe(F.col("_key")), "left_semi").select("file").distinct()
        return ["/".join(r["file"].split("/")[-3:]) for r in met.collect()]

    def merged(self, changes: DataFrame, seq: str | None = None, insert: bool = True) -> FileTable:
        """Every row gets the columns that the changes of its key have, from the newest by
        ``seq`` (without it, a key may have one change only). Other columns keep their values.
        With ``insert``, keys that the table lacks become rows. A null key is a key like others."""
        rest = [c for c in changes.columns if c not in (self.key, seq)]
        new = changes.groupBy(F.col(self.key).alias("_key")).agg(
            F.max_by(F.struct(*rest), F.col(seq) if seq else F.lit(0)).alias("_new"), F.count(F.lit(1)).alias("_n")
        )
        new = stored(new)
        if seq is None and new.where("_n > 1").limit(1).count():
            raise ValueError("a key has several changes, and nothing tells which is the newest")
        touched, held = self._touched(new.select("_key")), self.files()
        made = []
        if touched:
            old = self.spark.read.schema(self.rows().schema).parquet(*[f"{self.path}/{f}" for f in touched])
            met = old.join(new, F.col(self.key).eqNullSafe(F.col("_key")), "left")
            columns = [F.when(F.col("_n").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in old.columns]
            columns += [F.col(f"_new.{c}").alias(c) for c in rest if c not in old.columns]
            made += self._written(met.select(*columns))
        if insert:
            keys = self.rows().select(F.col(self.key).alias("_held"))
            fresh = new.join(keys, F.col("_held").eqNullSafe(F.col("_key")), "left_anti")
            fresh = fresh.select(F.col("_key").alias(self.key), *[F.col(f"_new.{c}").alias(c) for c in rest])
            if fresh.limit(1).count():
                made += self._written(fresh)
        self.lists.publish([f for f in held if f not in set(touched)] + made)
        return self

    def without(self, keys: DataFrame) -> FileTable:
        """The rows of these keys go."""
        gone = stored(keys.select(F.col(self.key).alias("_key")).distinct())
        touched, held = self._touched(gone), self.files()
        made = []
        if touched:
            old = self.spark.read.schema(self.rows().schema).parquet(*[f"{self.path}/{f}" for f in touched])
            made = self._written(old.join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti"))
        self.lists.publish([f for f in held if f not in set(touched)] + made)
        return self

    def updated(self, condition: Column, values: dict[str, Column]) -> FileTable:
        """Columns get new values where a condition holds."""
        new = self.rows().where(condition).select(self.key, *[v.alias(c) for c, v in values.items()])
        return self.merged(stored(new.dropDuplicates([self.key])), insert=False)

    def cleaned(self) -> FileTable:
        """Delete files and lists of older versions."""
        held = set(self.files())
        for folder in names(self.spark, f"{self.path}/data"):
            for f in names(self.spark, f"{self.path}/data/{folder}"):
                if f.endswith(".parquet") and f"data/{folder}/{f}" not in held:
                    delete(self.spark, f"{self.path}/data/{folder}/{f}")
        self.lists.forget_old()
        return self


def scratch_table(spark: SparkSession, rows: DataFrame, key: str) -> FileTable:
    """A table that goes at the program's end."""
    return FileTable(spark, new_folder(spark), key).created(rows)

