"""Verdicts made of several signals: domains, messages, pages, QR codes, rule updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import domains as D
from riskspark.functions import text as X
from riskspark.operators import editjoin
from riskspark.operators.tables import flagged, small
from riskspark.sources.sinks import upserted

# Cut-offs, scores of levels, weights, thresholds.
SUSPICIOUS_FROM, DANGEROUS_FROM = 0.30, 0.59
LEVEL_SCORES = {"SAFE": 0.15, "SUSPICIOUS": 0.445, "DANGEROUS": 0.795}
WEIGHTS = {"model": 0.5, "bm25": 0.2, "feedback": 0.2, "feature": 0.1}
HOMOPHONE_FROM, WEB3_FROM, SIMILAR_FROM, UNKNOWN_SCORE = 0.85, 0.7, 0.85, 0.5
QR_BLOCK, QR_WARN = 0.50, 0.10
MOST_RULE_CHANGES = 10_000
REPORT_SCORES = {"DANGEROUS": 0.8, "SUSPICIOUS": 0.3, "SAFE": 0.1}
#: Of each level: seconds of cooldown, and whether it asks, tells, sounds and shakes.
ALERT_CONFIG = [("SAFE", 0, False, False, False, False), ("SUSPICIOUS", 300, False, True, False, True), ("DANGEROUS", 300, True, True, True, True)]


def single(x: float) -> Column:
    return F.lit(x).cast("float")


def level(score: Column) -> Column:
    s = score.cast("float")
    return F.when(s < single(SUSPICIOUS_FROM), "SAFE").when(s < single(DANGEROUS_FROM), "SUSPICIOUS").otherwise("DANGEROUS")


def level_score(name: Column) -> Column:
    out = F
    for k, v in LEVEL_SCORES.items():
        out = out.when(name == k, single(v))
    return out


def rank(name: Column) -> Column:
    return F.when(name == "DANGEROUS", 2).when(name == "SUSPICIOUS", 1).otherwise(0)


def fused(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that are present (32-bit products, 64-bit sums); null
    if none is."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, c in scores.items():
        w = single(WEIGHTS[name])
        top = top + F.coalesce((c.cast("float") * w).cast("float").cast("double"), F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), w.cast("double")).otherwise(0.0)
    return F.when(weight > 0, (top / weight).cast("float"))


def sms_level(body: Column, rule: Column, fused_level: Column) -> Column:
    """Blank is safe, a dangerous rule decides, else the higher level."""
    higher = F.when(rank(rule) >= rank(F.coalesce(fused_level, F.lit("SAFE"))), rule).otherwise(fused_level)
    return F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "SAFE").when(rule == "DANGEROUS", "DANGEROUS").otherwise(higher)


def sms_risk(messages: DataFrame, signals: dict[str, DataFrame], words: list[str], whitelisted: DataFrame | None = None) -> DataFrame:
    """``msg_id, rule_level, score, level``. Each signal is ``msg_id, score``; a message
    without a score of a signal is fused without it."""
    df = messages.select("msg_id", "body")
    for name, s in signals.items():
        df = df.join(s.select("msg_id", F.col("score").alias(name)), "msg_id", "left")
    df = flagged(df, whitelisted, "msg_id", "ok") if whitelisted is not None else df.withColumn("ok", F.lit(False))
    rule = X.keyword_level(F.coalesce("body", F.lit("")), words)
    score = fused({n: F.col(n) for n in signals})
    df = df.select("msg_id", "body", "ok", rule.alias("rule_level"), score.alias("score"))
    fused_level = F.when(F.col("ok"), "SAFE").otherwise(level(F.col("score")))
    return df.select("msg_id", "rule_level", "score", sms_level(F.col("body"), F.col("rule_level"), fused_level).alias("level"))


def web_level(text: Column, words: list[str], model_score: Column | None = None) -> Column:
    """The model's level where it has a score, else that of the keywords."""
    rule = X.keyword_level(text, words)
    return rule if model_score is None else F.when(model_score.isNotNull(), level(model_score)).otherwise(rule)


def domain_verdicts(names: DataFrame, rules: DataFrame, domain: str = "domain", most_edits: int = 3) -> DataFrame:
    """``domain, verdict, reason, score`` of each distinct domain; the first that fits
    decides: whitelisted (blocked all the same if it is a homograph), homograph,
    blacklisted, homophone, name service, similar to a known name, suspicious
    characters; else unknown."""
    d = names.select(F.col(domain).alias("domain")).dropna().distinct()
    d = flagged(d, rules.where("category = 'WHITELIST'"), "domain", "white")
    d = flagged(d, rules.where("category = 'BLACKLIST'"), "domain", "black")
    near = editjoin.closest(d, rules, "domain", "domain", most_edits)
    near = near.select(F.col("query").alias("domain"), "word", "distance")
    d = d.join(near, "domain", "left")
    c = F.col("domain")
    d = d.select(
        "domain", "white", "black", D.homograph(c).alias("homograph"), D.homophone_score(c).alias("homophone"),
        D.web3(c).isNotNull().alias("web3"), D.web3_risk(c).alias("web3_risk"),
        editjoin.similarity(F.col("distance"), c, F.col("word")).alias("similar"), D.domain_level(c).alias("chars"),
    )
    reasons = [
        (F.col("white") & F.col("homograph").isNull(), "ALLOW", "WHITELIST"),
        (F.col("homograph").isNotNull(), "BLOCK", "SUSPICIOUS"),
        (F.col("black"), "BLOCK", "BLACKLIST"),
        (F.col("homophone") > single(HOMOPHONE_FROM), "BLOCK", "HOMOPHONE"),
        (F.col("web3") & (F.col("web3_risk") >= single(WEB3_FROM)), "BLOCK", "WEB3"),
        (F.col("similar") > single(SIMILAR_FROM), "BLOCK", "SIMILAR"),
        (F.col("chars") != "SAFE", "BLOCK", "MODEL"),
    ]
    verdict, reason = F, F
    for condition, v, r in reasons:
        verdict, reason = verdict.when(condition, v), reason.when(condition, r)
    return d.select(
        "domain", verdict.otherwise("UNKNOWN").alias("verdict"), reason.otherwise("NONE").alias("reason"),
        F.col("similar").alias("similar"),
    )


def qr_decisions(codes: DataFrame, verdicts: DataFrame, payload: str = "payload") -> DataFrame:
    """The codes with ``kind, domain, decision``: WiFi and plain text pass, a payment
    warns, and a URL (also one inside a text or payment) goes by its domain's verdict."""
    c = F.col(payload)
    kind = X.qr_kind(c)
    url = F.when(kind == "URL", c).when(kind.isin("PAYMENT", "TEXT"), X.embedded_url(c))
    df = codes.withColumn("kind", kind).withColumn("_url", url).withColumn("domain", X.host(F.col("_url")))
    df = df.join(verdicts.select("domain", "verdict"), "domain", "left")
    unknown = (
        F.when(F.lit(UNKNOWN_SCORE) >= QR_BLOCK, "BLOCK").when(F.lit(UNKNOWN_SCORE) >= QR_WARN, "WARN").otherwise("PASS")
    )
    by_verdict = (
        F.when(F.col("domain").isNull(), "PASS").when(F.col("verdict") == "BLOCK", "BLOCK")
        .when(F.col("verdict") == "ALLOW", "PASS").otherwise(unknown)
    )
    decision = F.when(F.col("_url").isNotNull(), by_verdict).when(F.col("kind") == "PAYMENT", "WARN").otherwise("PASS")
    return df.withColumn("decision", decision).drop("_url", "verdict")


def update_accepted(version: str, local: str, adds: int, removes: int) -> bool:
    """Whether an update is newer and of a bearable size (its signature is checked in the data)."""
    def parts(v: str) -> list[int]:
        return [int(p) if p.isdigit() else 0 for p in v.split(".")]

    a, b = parts(version), parts(local)
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) > b + [0] * (n - len(b)) and adds + removes <= MOST_RULE_CHANGES


def accepted_updates(updates: DataFrame, changes: DataFrame, local: str) -> DataFrame:
    """The updates (``seq, version, signature, at``) with ``accepted``: they are newer than
    the local version and every valid one that arrived (``seq``) before, have a bearable number of
    ``changes`` (``seq, gone, place, domain``), and their signature is right.

    Changes are counted first, so that those of an oversize update are never gathered. The
    digest is of an update's changes in order, additions first. What orders updates is one
    row for each of them."""
    counted = changes.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    sized = updates.join(counted, "seq", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bearable = sized.where(F.col("n") <= MOST_RULE_CHANGES)
    in_order = F.array_sort(F.collect_list(F.struct("gone", "place", "domain")))
    lists = changes.join(bearable.select("seq"), "seq", "left_semi").groupBy("seq").agg(in_order.alias("c"))
    digests = lists.select("seq", F.sha2(F.array_join("c.domain", "\n"), 256).alias("digest"))
    signed = sized.join(digests, "seq", "left")
    right = F.lower("signature") == F.coalesce("digest", F.sha2(F.lit(""), 256))
    signed = signed.withColumn("valid", (F.col("n") <= MOST_RULE_CHANGES) & F.coalesce(right, F.lit(False)))
    key, earlier = X.version_key(F.col("version")), Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    signed = signed.withColumn("key", key).withColumn("before", F.max(F.when(F.col("valid"), F.col("key"))).over(earlier))
    newest = F.greatest(F.coalesce("before", F.array(F.lit(0))), X.version_key(F.lit(local)))
    return signed.withColumn("accepted", F.col("valid") & (F.col("key") > newest)).drop("digest", "key", "before")


def chained_rules(rules: DataFrame, updates: DataFrame, changes: DataFrame, local: str) -> DataFrame:
    """The rules after a chain of signed updates, each applied in the order in which it
    arrived: additions become BLACKLIST unless whitelisted by then, removals then become
    WHITELIST; bad names, and updates that :func:`accepted_updates` refuses, change nothing.

    A removed name is whitelisted, which no addition undoes; so a name's last removal
    counts, else its last addition, and one merged row for each name meets the rules."""
    taken = accepted_updates(updates, changes, local).where("accepted").select("seq", "at")
    name = F.lower(F.trim(F.col("domain")))
    rows = changes.join(small(taken), "seq").select(name.alias("domain"), "gone", "seq", "at").where(D.is_domain_format(F.col("domain")))
    last = F.max(F.struct("gone", "seq", "at")).alias("last")
    changed = rows.groupBy("domain").agg(last).select("domain", "last.gone", "last.at")
    safe = rules.where("category = 'WHITELIST'").select("domain").withColumn("white", F.lit(True)).distinct()
    changed = changed.join(safe, "domain", "left").where(F.col("gone") | F.col("white").isNull())
    new = changed.select(
        "domain", F.when(F.col("gone"), "WHITELIST").otherwise("BLACKLIST").alias("category"), F.lit("remote").alias("source"),
        F.col("at").cast("bigint").alias("addedAt"), single(1.0).alias("confidence"),
    )
    return upserted(rules, new, "domain")


def updated_rules(rules: DataFrame, diff: DataFrame, now: int, local: str = "0") -> DataFrame:
    """:func:`chained_rules` of updates with ``adds`` and ``removes`` as arrays (``version`` may
    be missing if there is one), applied in the order of their versions."""
    versioned = diff if "version" in diff.columns else diff.withColumn("version", F.lit("1"))
    rows = versioned.withColumn("seq", F.struct(X.version_key(F.col("version")).alias("v"), F.col("version").alias("text"))).withColumn("at", F.lit(now))
    of = lambda c, gone: rows.select("seq", F.lit(gone).alias("gone"), F.posexplode(c).alias("place", "domain"))
    return chained_rules(rules, rows.select("seq", "version", "signature", "at"), of("adds", False).unionByName(of("removes", True)), local)


def alert_config(spark) -> DataFrame:
    return spark.createDataFrame(ALERT_CONFIG, "level string, cooldown_s int, confirm boolean, tip boolean, sound boolean, vibrate boolean")


def report_score(name: Column) -> Column:
    out = F
    for k, v in REPORT_SCORES.items():
        out = out.when(name == k, single(v))
    return out


def since_start(name: str, as_of: Column) -> Column:
    """Lower bound of a named time range."""
    hours = {"DAY": 24, "WEEK": 24 * 7, "MONTH": 24 * 30, "YEAR": 24 * 365}
    if name == "TODAY":
        return F.date_trunc("day", as_of)
    return F.timestamp_millis(F.lit(0)) if name == "ALL" else as_of - F.make_interval(hours=F.lit(hours[name]))
