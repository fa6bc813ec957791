"""Lookups, counts and rankings over rule, alert and feedback tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import text as X

#: Rows up to this number are broadcast after they have been counted.
BROADCAST_ROWS = 200_000
# Alert types that count as blocked.
BLOCKED = ("BLACKLIST_BLOCKED", "SUSPICIOUS_DOMAIN")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def equal_to(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def known(df: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """The keys of a list that the table has."""
    return df.where(F.col(key).isin(list(keys))).select(key).distinct()


def since(df: DataFrame, time: str, start: object) -> DataFrame:
    return df.where(F.col(time) >= F.lit(start))


def flagged(left: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """All rows, with whether their key is among the members."""
    m = small(members.select(F.col(key)).distinct()).withColumn(flag, F.lit(True))
    return left.join(m, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def among(left: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a member. Spark adds a Bloom filter of its own where one pays."""
    return left.join(members.select(key), key, "left_semi")


def not_among(left: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return left.join(members.select(key), key, "left_anti")


def recent(df: DataFrame, n: int, time: str = "timestamp", tie: str = "id", oldest: bool = False) -> DataFrame:
    """The ``n`` newest (or oldest) rows in order; ties by id."""
    a, b = F.col(time), F.col(tie)
    return df.orderBy(*((a.asc(), b.asc()) if oldest else (a.desc(), b.desc()))).limit(n)


def latest(df: DataFrame, key: str | None, time: str, tie: str) -> DataFrame:
    """The newest row (of each key)."""
    names = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*names), F.struct(time, tie)).alias("_r")
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(best).select(*([key] if key else []), "_r.*")


def alert_counts(alerts: DataFrame, start: object, kind: str = "type", time: str = "timestamp") -> DataFrame:
    """One row: all alerts since then, blocked ones, and those of each named type."""
    a = since(alerts, time, start)
    counts = [F.count_if(F.col(kind) == t).alias(f"n_{t.lower()}") for t in ("VISITED", "SMS_PHISHING", "PHISHING_PAGE")]
    return a.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col(kind).isin(*BLOCKED)).alias("n_blocked"), *counts)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    label = F.col("label")
    return feedback.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(label == "PHISHING").alias("n_phishing"),
        F.count_if(label == "FALSE_POSITIVE").alias("n_false_positive"),
    )


def metrics(df: DataFrame, name: str, duration: str) -> DataFrame:
    """Count, total, most and least of each metric; durations of zero only count."""
    d = F.when(F.col(duration) > 0, F.col(duration))
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(d), F.lit(0)).alias("total"),
        F.coalesce(F.max(d), F.lit(0)).alias("most"),
        F.min(d).alias("least"),
    )


def recent_feed(alerts: DataFrame, fetch: int = 100, show: int = 20) -> DataFrame:
    """What the alert list shows: type, subject and time of day of the newest ones."""
    top = recent(recent(alerts, fetch), show)
    return top.select(
        "id", "type", F.coalesce("domain", "url", F.lit("")).alias("subject"),
        F.date_format(F.expr("timestampadd(MILLISECOND, timestamp, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "HH:mm").alias("at"),
    )


def whitelisted_texts(texts: DataFrame, feedback: DataFrame, text: str = "text") -> DataFrame:
    """The texts with the label that was first given to an equal text (least id), or null."""
    first = feedback.groupBy("textHash").agg(F.min_by("label", "id").alias("label"))
    hashed = texts.withColumn("textHash", F.md5(F.col(text)))
    return hashed.join(first, "textHash", "left")


def screen_share_risk(events: DataFrame, banks: Sequence[str] | DataFrame, sharing: Sequence[str] | DataFrame, by: str, app: str, time: str) -> DataFrame:
    """In windows of five seconds that start every three: whether the last app is a
    bank's while a screen-sharing app ran. Apps are told by lists, or by tables of one
    column, which are joined (and broadcast if they are small)."""
    w = F.window(time, "5 seconds", "3 seconds")

    def member(apps: Sequence[str] | DataFrame, df: DataFrame, name: str) -> DataFrame:
        if not isinstance(apps, DataFrame):
            return df.withColumn(name, F.col(app).isin(list(apps)))
        held = small(apps.select(F.col(apps.columns[0]).alias("_app")).dropna().distinct().withColumn("_held", F.lit(True)))
        joined = df.join(held, F.col(app) == F.col("_app"), "left")
        return joined.withColumn(name, F.coalesce("_held", F.lit(False))).drop("_app", "_held")

    marked = member(sharing, member(banks, events, "_bank"), "_sharing")
    last = F.max_by(F.struct(F.col(app).alias("app"), F.col("_bank").alias("bank")), F.col(time)).alias("front")
    seen = marked.groupBy(by, w.alias("w")).agg(last, F.bool_or("_sharing").alias("shared"))
    return seen.select(by, F.col("w.start").alias("start"), F.col("front.app").alias("front"), (F.col("front.bank") & F.col("shared")).alias("risk"))


def user_reports(reports: DataFrame, report_id: str, domain: str, description: str, time_ms: Column) -> DataFrame:
    """Reports that name a domain, as alert rows (``schemas.ALERTS``); blank ones are none."""
    return reports.where(F.col(domain).rlike(r"\S")).select(
        F.col(report_id).cast("bigint").alias("id"), time_ms.cast("bigint").alias("timestamp"), F.lit("SUSPICIOUS_DOMAIN").alias("type"),
        F.col(domain).alias("domain"), F.lit(None).cast("string").alias("url"), F.lit("USER_REPORT").alias("riskLevel"), F.col(description).alias("userAction"),
    )


def ranked(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def masked(df: DataFrame, domain: str) -> DataFrame:
    return df.withColumn(domain, X.mask_domain(F.col(domain)))


def bloom_members(left: DataFrame, members: DataFrame, key: str, rate: float = 0.001, items: int | None = None) -> DataFrame:
    """Distinct keys with ``maybe``: whether a Bloom filter of the members may hold them
    (never false for a member). The filter is sized for ``items`` members, or for as many
    as there are. Its set bits are rows, met by a join."""
    from riskspark.functions.packets import bloom_bits, bloom_size

    names = members.select(key).dropna().distinct()
    bits, hashes = bloom_size(names.count(), rate, 1 << 32) if items is None else bloom_size(items, rate)
    places = bloom_bits(bits, hashes)
    held = names.select(F.explode(places(F.col(key))).alias("bit")).distinct().withColumn("set", F.lit(1))
    asked = left.select(key).dropna().distinct().select(key, F.explode(F.array_distinct(places(F.col(key)))).alias("bit"))
    found = asked.join(small(held, 10_000_000), "bit", "left")
    return found.groupBy(key).agg((F.count("set") == F.count(F.lit(1))).alias("maybe"))


def confirmed_members(left: DataFrame, members: DataFrame, key: str, rate: float = 0.001) -> DataFrame:
    """The distinct keys that are members: those that the Bloom filter refuses are not
    looked up, and those that it lets through are confirmed by a semi-join (exact)."""
    maybe = bloom_members(left, members, key, rate).where("maybe")
    return maybe.join(members.select(key), key, "left_semi")
