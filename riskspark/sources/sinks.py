"""Writers, and table rewrites for stores without an update statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """The rows of both, one for each key: the newest of the new ones (by ``seq``; the
    greatest row of equal ones, or without it), else the old one. Keys are compared as they
    are; null keys are one key. New rows are merged before they are shuffled, and meet old
    ones in one join; columns that only the old ones have are null in new rows."""
    columns = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c != key]
    row = F.struct(*[F.col(c) for c in new.columns if c != key])
    newest_row = F.max_by(row, F.struct(F.col(seq), row)) if seq else F.max(row)
    b = new.groupBy(F.col(key).alias("_key")).agg(newest_row.alias("_new"), F.lit(True).alias("_is_new"))
    a = old.select(F.col(key).alias("_old_key"), F.struct(*[F.col(c) for c in old.columns if c != key]).alias("_old"))
    both = a.join(b, F.col("_old_key").eqNullSafe(F.col("_key")), "full")
    of_new = F.coalesce("_is_new", F.lit(False))

    def value(c: str) -> Column:
        first = F.col(f"_new.{c}") if c in new.columns else F.lit(None)
        return F.when(of_new, first).otherwise(F.col(f"_old.{c}") if c in old.columns else F.lit(None)).alias(c)

    order = [key, *columns] if key not in old.columns[1:] else [*old.columns, *[c for c in columns if c not in old.columns]]
    picked = both.select(F.when(of_new, F.col("_key")).otherwise(F.col("_old_key")).alias(key), *map(value, columns))
    return picked.select(order)


def without(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those that go."""
    return old.join(gone.select(key), key, "left_anti")


def emptied(old: DataFrame) -> DataFrame:
    return old.limit(0)


def newest(df: DataFrame, n: int, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """Retention: the ``n`` newest rows."""
    return df.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_split(df: DataFrame, parts: dict[str, Column], path: str) -> None:
    """One output for each named condition, from one pass over the kept frame."""
    df = df.persist()
    try:
        for name, condition in parts.items():
            df.where(condition).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    finally:
        df.unpersist()


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def masked_log(alerts: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` oldest alerts as lines with masked domains and URLs."""
    from riskspark.functions.text import mask_domain, mask_url

    oldest = alerts.orderBy("timestamp", "id").limit(n)
    return oldest.select(
        F.concat_ws(
            ",", F.col("timestamp").cast("string"), "type", F.coalesce(mask_domain(F.col("domain")), F.lit("")),
            F.coalesce(mask_url(F.col("url")), F.lit("")),
        ).alias("value")
    )


def migrated(old: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The old rows in a wider schema: columns that are missing get their default."""
    return old.select("*", *[c.alias(name) for name, c in added.items() if name not in old.columns])


def write_vocabulary(vocabulary: dict[str, int], df_session, path: str) -> None:
    """A vocabulary as one JSON object, by whatever file system Spark knows."""
    import json

    df_session.createDataFrame([(json.dumps(vocabulary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
