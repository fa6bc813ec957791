"""Composite verdicts over page hosts and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import text as X
from riskspark.operators import decisions as C
from riskspark.plans.registry import query, table
from riskspark.plans.texts import HITS_SQL, HOST_SQL, WORDS
from riskspark.sources.scratch import stored

HOSTS_SQL = f"SELECT DISTINCT {HOST_SQL} AS domain FROM pages"
RULES_SQL = f"SELECT domain, CASE WHEN contains(domain, 'casino') THEN 'BLACKLIST' ELSE 'WHITELIST' END AS category FROM ({HOSTS_SQL}) WHERE contains(domain, 'casino') OR contains(domain, 'blog')"


def hosts(spark, sf):
    return table(spark, sf, "pages").select(X.host(F.col("url")).alias("domain")).distinct()


def rules(spark, sf):
    d, casino = F.col("domain"), F.contains("domain", F.lit("casino"))
    h = hosts(spark, sf).where(casino | F.contains("domain", F.lit("blog")))
    return h.select(d, F.when(casino, "BLACKLIST").otherwise("WHITELIST").alias("category"), F.lit("test").alias("source"),
                    F.lit(0).cast("bigint").alias("addedAt"), F.lit(1.0).cast("float").alias("confidence"))


SIMILAR_SQL = "(1::FLOAT - (min(levenshtein(h.domain, r.domain))::FLOAT / greatest(length(h.domain), length(arg_min(r.domain, (levenshtein(h.domain, r.domain), r.domain))))::FLOAT)::FLOAT)::FLOAT"


@query(f"""WITH h AS ({HOSTS_SQL}), r AS ({RULES_SQL}),
s AS (SELECT h.domain, {SIMILAR_SQL} AS sim FROM h, r WHERE levenshtein(h.domain, r.domain) <= 3 GROUP BY h.domain)
SELECT h.domain, CASE WHEN r.category = 'WHITELIST' THEN 'ALLOW' WHEN r.category = 'BLACKLIST' OR sim > 0.85::FLOAT THEN 'BLOCK' ELSE 'UNKNOWN' END AS verdict,
CASE WHEN r.category IS NOT NULL THEN r.category WHEN sim > 0.85::FLOAT THEN 'SIMILAR' ELSE 'NONE' END AS reason FROM h LEFT JOIN r USING (domain) LEFT JOIN s USING (domain)""")
def d1_domain_verdicts(spark, sf):
    return C.domain_verdicts(hosts(spark, sf), rules(spark, sf)).select("domain", "verdict", "reason")


@query(f"""WITH r AS ({RULES_SQL}) SELECT page_id, domain, CASE WHEN category = 'WHITELIST' THEN 'PASS' ELSE 'BLOCK' END AS decision FROM (SELECT page_id, {HOST_SQL} AS domain FROM pages) LEFT JOIN r USING (domain)""")
def d4_qr_decisions(spark, sf):
    v = C.domain_verdicts(hosts(spark, sf), rules(spark, sf))
    codes = table(spark, sf, "pages").select("page_id", F.col("url").alias("payload"))
    return C.qr_decisions(codes, v).select("page_id", "domain", "decision")


@query(f"""WITH r AS ({RULES_SQL}), h AS ({HOSTS_SQL}), n AS (SELECT count(*) AS n FROM h WHERE contains(domain, 'the')), m AS (SELECT count(*) AS n FROM r WHERE category = 'BLACKLIST'),
adds AS (SELECT domain FROM h, n WHERE contains(domain, 'the') AND n.n <= 10000 AND domain NOT IN (SELECT domain FROM r WHERE category = 'WHITELIST')),
gone AS (SELECT domain FROM r, m WHERE category = 'BLACKLIST' AND m.n <= 10000)
SELECT domain, CASE WHEN domain IN (SELECT domain FROM gone) THEN 'WHITELIST' WHEN domain IN (SELECT domain FROM adds) THEN 'BLACKLIST' ELSE (SELECT category FROM r WHERE r.domain = x.domain) END AS category,
  CASE WHEN domain IN (SELECT domain FROM gone) THEN 5 WHEN domain IN (SELECT domain FROM adds) THEN 2 ELSE 0 END AS "addedAt"
FROM (SELECT domain FROM r UNION SELECT domain FROM adds) x""")
def d6_rule_update(spark, sf):
    """Five updates arrive: one that is not newer, additions, an older one, a forged one, removals."""
    old, h = rules(spark, sf), hosts(spark, sf)
    black, the = old.where("category = 'BLACKLIST'").select("domain"), F.contains("domain", F.lit("the"))
    parts = {1: (h.where(~the), False), 2: (h.where(the), False), 3: (h, True), 4: (h.where(~the), False), 5: (black, True)}
    rows = [d.select(F.lit(seq).alias("seq"), F.lit(gone).alias("gone"), F.lit(0).alias("place"), "domain") for seq, (d, gone) in parts.items()]
    changes = stored(reduce(DataFrame.unionByName, rows))
    versions = spark.createDataFrame([(1, "1.0", 1), (2, "1.2", 2), (3, "1.1.9", 3), (4, "1.4", 4), (5, "1.10", 5)], "seq int, version string, at long")
    # Their signatures are right, but for the forged one and what is too large to be signed.
    counted = changes.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where("n <= 10000 AND seq <> 4")
    made = changes.join(counted, "seq", "left_semi").groupBy("seq").agg(F.array_sort(F.collect_list("domain")).alias("d"))
    updates = versions.join(made.select("seq", F.upper(F.sha2(F.array_join("d", "\n"), 256)).alias("signature")), "seq", "left")
    return C.chained_rules(old, updates, changes, "1.0").select("domain", "category", "addedAt")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN (CASE WHEN (doc_id % 97 / 97.0)::FLOAT < 0.3::FLOAT THEN 'SAFE' WHEN (doc_id % 97 / 97.0)::FLOAT < 0.59::FLOAT THEN 'SUSPICIOUS' ELSE 'DANGEROUS' END)
WHEN {HITS_SQL} >= 3 THEN 'DANGEROUS' WHEN {HITS_SQL} >= 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM documents""")
def d5_web_levels(spark, sf):
    """Every third document has no model score."""
    model = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 97 / 97.0)
    return table(spark, sf, "documents").select("doc_id", C.web_level(F.col("text"), WORDS, model).alias("level"))


FUSED_SQL = "((CASE WHEN m IS NULL THEN 0 ELSE (m::FLOAT * 0.5::FLOAT)::FLOAT::DOUBLE END + (b::FLOAT * 0.2::FLOAT)::FLOAT::DOUBLE) / (CASE WHEN m IS NULL THEN 0 ELSE 0.5::FLOAT::DOUBLE END + 0.2::FLOAT::DOUBLE))::FLOAT"


@query(f"""WITH s AS (SELECT doc_id, text, {HITS_SQL} AS hits, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 97) / 97.0::DOUBLE END AS m, (doc_id % 89) / 89.0::DOUBLE AS b FROM documents),
f AS (SELECT doc_id, CASE WHEN hits >= 3 THEN 'DANGEROUS' WHEN hits >= 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS rule_level, {FUSED_SQL} AS score FROM s),
g AS (SELECT *, CASE WHEN score < 0.3::FLOAT THEN 0 WHEN score < 0.59::FLOAT THEN 1 ELSE 2 END AS l, CASE rule_level WHEN 'SAFE' THEN 0 WHEN 'SUSPICIOUS' THEN 1 ELSE 2 END AS r FROM f)
SELECT doc_id AS msg_id, rule_level, round(score::DOUBLE, 5) AS score, CASE greatest(l, r) WHEN 0 THEN 'SAFE' WHEN 1 THEN 'SUSPICIOUS' ELSE 'DANGEROUS' END AS level FROM g""")
def d3_sms_risk(spark, sf):
    d = table(spark, sf, "documents")
    model = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("msg_id"), (F.col("doc_id") % 97 / 97.0).alias("score"))
    found = d.select(F.col("doc_id").alias("msg_id"), (F.col("doc_id") % 89 / 89.0).alias("score"))
    m = d.select(F.col("doc_id").alias("msg_id"), F.col("text").alias("body"))
    r = C.sms_risk(m, {"model": model, "bm25": found}, WORDS)
    return r.withColumn("score", F.round(F.col("score").cast("double"), 5))


@query("SELECT doc_id, CASE WHEN s < 0.3::FLOAT THEN 'SAFE' WHEN s < 0.59::FLOAT THEN 'SUSPICIOUS' ELSE 'DANGEROUS' END AS level FROM (SELECT doc_id, ((doc_id % 100) / 100.0::DOUBLE)::FLOAT AS s FROM documents)")
def f14_risk_bands(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.level(F.col("doc_id") % 100 / 100.0).alias("level"))
