"""Evaluation queries: a score that depends on the document, against its labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import evaluate
from riskspark.plans.registry import query, table

GRID = [k / 20 for k in range(1, 20)]
SCORED_SQL = "SELECT toxic AS label, ((doc_id * 37 + toxic * 400) % 1000) / 1000.0::DOUBLE AS score FROM labels"
RATES_SQL = """round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) AS accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / (tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1) + 1e-8), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(fn / greatest(fn + tp, 1), 6) AS fnr"""
COUNTS_SQL = "count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn"
SWEEP_SQL = f"SELECT t AS threshold, tp, fp, fn, tn, {RATES_SQL} FROM (SELECT t, {COUNTS_SQL} FROM ({SCORED_SQL}), (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS t) GROUP BY t)"


def scored(spark, sf):
    score = ((F.col("doc_id") * 37 + F.col("toxic") * 400) % 1000) / F.lit(1000.0)
    return table(spark, sf, "labels").select(F.col("toxic").alias("label"), score.alias("score"))


@query(f"SELECT tp, fp, fn, tn, {RATES_SQL} FROM (SELECT {COUNTS_SQL.replace('score >= t', 'score >= 0.5').replace('score < t', 'score < 0.5')} FROM ({SCORED_SQL}))")
def a13_confusion(spark, sf):
    return evaluate.confusion(scored(spark, sf), "score", "label", 0.5)


@query(SWEEP_SQL)
def a15_threshold_sweep(spark, sf):
    return evaluate.sweep(scored(spark, sf), "score", "label", GRID)


@query(f"""WITH s AS ({SWEEP_SQL})
SELECT 'best_f1' AS rule, (SELECT threshold FROM s ORDER BY f1 DESC, threshold LIMIT 1) AS threshold
UNION ALL SELECT 'best_f1_recall_0.85', (SELECT threshold FROM s WHERE recall >= 0.85 ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'best_f1_recall_0.95', (SELECT threshold FROM s WHERE recall >= 0.95 ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'best_f1_fpr_0.1', (SELECT threshold FROM s WHERE fpr <= 0.1 ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'dangerous', (SELECT max(threshold) FROM s WHERE recall >= 0.95 AND threshold <= 0.5)
UNION ALL SELECT 'safe', (SELECT max(threshold) / 2 FROM s WHERE recall >= 0.95 AND threshold <= 0.5)""")
def a16_best_thresholds(spark, sf):
    return evaluate.best_thresholds(evaluate.sweep(scored(spark, sf), "score", "label", GRID))


@query(f"""WITH s AS ({SCORED_SQL}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc,
count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM r""")
def a17_auc(spark, sf):
    return evaluate.auc(scored(spark, sf), "score", "label")


@query(f"""SELECT round(avg(score) FILTER (label = 1), 6) AS pos_mean, round(stddev_pop(score) FILTER (label = 1), 6) AS pos_std, min(score) FILTER (label = 1) AS pos_min, max(score) FILTER (label = 1) AS pos_max,
round(avg(score) FILTER (label = 0), 6) AS neg_mean, round(stddev_pop(score) FILTER (label = 0), 6) AS neg_std, min(score) FILTER (label = 0) AS neg_min, max(score) FILTER (label = 0) AS neg_max,
round(count(*) FILTER ((label = 1 AND score < 0.5) OR (label = 0 AND score >= 0.5)) / greatest(count(*), 1), 6) AS overlap, round(max(score) - min(score), 6) AS range,
round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS margin FROM ({SCORED_SQL})""")
def a18_health(spark, sf):
    return evaluate.health(scored(spark, sf), "score", "label")


def two(spark, sf):
    df = scored(spark, sf)
    return evaluate.confusion(df, "score", "label", 0.3), evaluate.confusion(df, "score", "label", 0.6)


TWO_SQL = f"WITH s AS (SELECT * FROM ({SWEEP_SQL})), a AS (SELECT f1 FROM s WHERE threshold = 0.3), b AS (SELECT f1 FROM s WHERE threshold = 0.6) "


@query(TWO_SQL + "SELECT CASE WHEN a.f1 - b.f1 > 0.1 THEN 'OVERFIT' WHEN a.f1 < 0.7 AND b.f1 < 0.7 THEN 'UNDERFIT' ELSE 'OK' END AS verdict, round(a.f1 - b.f1, 6) AS gap FROM a, b")
def a19_fit_verdict(spark, sf):
    return evaluate.fit_verdict(*two(spark, sf))


@query(TWO_SQL + "SELECT round(abs(a.f1 - b.f1), 6) AS gap, CASE WHEN abs(a.f1 - b.f1) < 0.03 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM a, b")
def a25_stability(spark, sf):
    return evaluate.stability(*two(spark, sf))


APART_SQL = SCORED_SQL.replace("((doc_id * 37 + toxic * 400) % 1000)", "((doc_id * 37) % 500 + toxic * 500)")


@query(f"""WITH s AS ({APART_SQL}), w AS ({SWEEP_SQL.replace(SCORED_SQL, 'SELECT * FROM s')}),
h AS (SELECT round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS margin, round(count(*) FILTER ((label = 1) <> (score >= 0.7)) / count(*), 6) AS overlap FROM s)
SELECT threshold, array_to_string(list_filter([CASE WHEN f1 < 0.85 THEN 'f1' END, CASE WHEN margin < 0.3 THEN 'margin' END, CASE WHEN threshold > 0.9 THEN 'overfit' END, CASE WHEN overlap > 0.2 THEN 'overlap' END,
  CASE WHEN fpr > 0.02 THEN 'fpr' END], lambda x: x IS NOT NULL), ',') AS violated FROM w, h""")
def a26_violated(spark, sf):
    """What every threshold breaks; the highest one counts as overfit."""
    score = ((F.col("doc_id") * 37) % 500 + F.col("toxic") * 500) / F.lit(1000.0)
    s = table(spark, sf, "labels").select(F.col("toxic").alias("label"), score.alias("score"))
    health = evaluate.health(s, "score", "label", 0.7).select("margin", "overlap")  # one row
    m = evaluate.sweep(s, "score", "label", GRID).withColumn("overfit", F.col("threshold") > 0.9).join(F.broadcast(health))
    return evaluate.violated(m, False).select("threshold", F.array_join("violated", ",").alias("violated"))


@query("""SELECT user_id, least, most, width, CASE WHEN width < 0.1 THEN 'NARROW' WHEN width > 0.5 THEN 'GOOD' ELSE 'MODERATE' END AS band
FROM (SELECT user_id, min(s) AS least, max(s) AS most, round(max(s) - min(s), 9) AS width FROM (SELECT user_id, value / 100 / (1 + user_id % 7) AS s FROM events WHERE event_type = 'click') GROUP BY 1)""")
def a20_score_bands(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select("user_id", (F.col("value") / 100 / (1 + F.col("user_id") % 7)).alias("s"))
    return evaluate.score_bands(e, "s", "user_id")
