"""URL filters: host-suffix and path-prefix expressions joined to rules by short
hash prefixes, confirmed by full digests, decided by rule precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper- and lower-case ASCII letters: only these fold, as in a URL's host.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host up to "/", "?", "#" or the end; path up to "?", "#" or the end.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules up to this number are broadcast; more are joined by a salted shuffle.
BROADCAST_RULES = 200_000
#: Hash prefixes are this many hex digits (4 bytes).
PREFIX_HEX = 8
#: Salts of the shuffled join: a hot expression ("com/") meets its rules in so many tasks.
SALTS = 32
#: Distinct path lengths and numbers of host labels of rules that the plan lists; of more,
#: all up to the largest are expanded.
LISTED = 256
#: Stands between host and path where both are hashed, as neither has it.
BETWEEN = "\n"


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path)`` of every row. A null URL or one without ``://`` has
    an empty host and path; repeated rows stay repeated."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("id"),
        F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, URL_PARTS, 2).alias("path"),
    )


def _listed(values: DataFrame) -> tuple[list[int], int]:
    """The distinct numbers of a column, or none of them if they are many, and the largest."""
    few = sorted(x[0] for x in values.distinct().limit(LISTED + 1).collect())
    if len(few) <= LISTED:
        return few, max(few, default=0)
    return [], values.agg(F.max(values.columns[0])).first()[0]


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Judge every URL by the longest fitting rule.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule
    fits its host and all subdomains if the URL's path starts with the rule's path.
    The longest rule (host and path together) wins; of equally long ones the longer
    host, then ``block``. Returns ``id_col, host, path, rule, verdict``, one row for
    each input row: ``rule`` is null and ``verdict`` the default where none fits.

    Rules with a null host, path or verdict fit nothing; repeated rules count once.
    Empty tables give empty or all-default results. Other columns of either table are
    not read, whatever their names.
    """
    r = (
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("_host"),
            F.col("path").alias("_path"),
            F.col("verdict").alias("_verdict"),
        )
        .dropna()
        .groupBy("_host", "_path")
        .agg(F.max("_verdict").alias("_verdict"))
        .withColumn("_rule", F.concat("_host", "_path"))
        .withColumn("_digest", F.sha2(F.concat("_host", F.lit(BETWEEN), "_path"), 256))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    )
    u = split_url(pages, id_col, url_col).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    # Only suffixes and prefixes as long as those of some rule: a host of very many labels has few.
    counts, most_labels = _listed(r.select(F.size(F.split("_host", r"\.")).alias("n")))
    lengths, longest = _listed(r.select(F.length("_path").alias("n")))
    some = F.array(*map(F.lit, counts)) if counts else F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most_labels), F.size(labels))))
    hosts = F.transform(
        F.filter(some, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    some = F.array(*map(F.lit, lengths)) if lengths else F.sequence(F.lit(0), F.least(F.lit(longest), F.length("path")))
    paths = F.transform(F.filter(some, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    e = (
        u.withColumn("_h", F.explode_outer(hosts))
        .withColumn("_p", F.explode_outer(paths))
        .withColumn("_full", F.sha2(F.concat("_h", F.lit(BETWEEN), "_p"), 256))
        .withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    )
    on = F.col("_short") == F.col("_prefix")
    if r.limit(broadcast_rules + 1).count() <= broadcast_rules:
        joined = e.join(F.broadcast(r), on, "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        e = e.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        salted = r.withColumn("_rule_salt", salt)
        joined = e.join(salted, on & (F.col("_salt") == F.col("_rule_salt")), "left")
    best = F.max(
        F.when(  # rules of the same short prefix are confirmed by the whole digest
            F.col("_full") == F.col("_digest"),
            F.struct(
                F.length("_rule").alias("n"),
                F.length("_host").alias("h"),
                F.col("_verdict").alias("verdict"),
                F.col("_rule").alias("rule"),
            ),
        )
    ).alias("_best")
    # The expressions of a row lie in one task, so they are merged before the shuffle.
    return (
        joined.groupBy("_row", "id", "host", "path")
        .agg(best)
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )
