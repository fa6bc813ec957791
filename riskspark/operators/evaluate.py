"""Evaluation of scores against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.sources.scratch import stored

# Limits of the verdicts.
LEAST_F1, LEAST_MARGIN, MOST_OVERLAP, MOST_FPR, STABLE_GAP = 0.85, 0.3, 0.2, 0.02, 0.03
OVERFIT_GAP, UNDERFIT_F1 = 0.1, 0.7


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates with denominators of one at least."""
    one = F.lit(1)
    precision, recall = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    return {
        "accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, one),
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / (precision + recall + 1e-8),
        "fpr": fp / F.greatest(fp + tn, one),
        "fnr": fn / F.greatest(fn + tp, one),
    }


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn and the rates (rounded to six places)."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    )
    r = rates(*map(F.col, ("tp", "fp", "fn", "tn")))
    return counts.select("*", *[F.round(c, 6).alias(n) for n, c in r.items()])


def sweep(df: DataFrame, score: str, label: str, grid: Sequence[float]) -> DataFrame:
    """The confusion row of each threshold of a grid. Rows are counted once, by the
    highest threshold that they reach; the counts are then summed down the grid."""
    grid = sorted(grid)
    reached = F.lit(-1)
    for k, t in enumerate(grid):
        reached = F.when(F.col(score) >= t, k).otherwise(reached)
    counts = df.select(reached.alias("k"), (F.col(label) == 1).alias("real")).groupBy("k").agg(
        F.count_if("real").alias("pos"), F.count_if(~F.col("real")).alias("neg")
    )
    rows = df.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(grid)], "k int, threshold double")
    rows = rows.unionByName(df.sparkSession.createDataFrame([(-1, None)], "k int, threshold double"))
    full = rows.join(F.broadcast(counts), "k", "left").fillna(0, ["pos", "neg"])  # as many rows as the grid
    down, whole = Window.orderBy(F.col("k").desc()), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    full = full.select(
        "k", "threshold", tp.alias("tp"), fp.alias("fp"),
        (F.sum("pos").over(whole) - tp).alias("fn"), (F.sum("neg").over(whole) - fp).alias("tn"),
    ).where("k >= 0")
    r = rates(*map(F.col, ("tp", "fp", "fn", "tn")))
    return full.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(n) for n, c in r.items()])


def best_thresholds(swept: DataFrame, recalls: Sequence[float] = (0.85, 0.95), fpr: float = 0.10) -> DataFrame:
    """``rule, threshold``: of best F1, of best F1 under each constraint, and the largest
    one up to 0.5 that keeps the highest recall, with half of it as the safe bound. Ties
    go to the lower threshold; a rule that nothing meets has a null."""
    def best(condition: Column) -> Column:
        return F.max(F.when(condition, F.struct("f1", (-F.col("threshold")).alias("t"))))["t"] * -1

    rules = {"best_f1": best(F.lit(True))}
    for r in recalls:
        rules[f"best_f1_recall_{r:g}"] = best(F.col("recall") >= r)
    rules[f"best_f1_fpr_{fpr:g}"] = best(F.col("fpr") <= fpr)
    largest = F.max(F.when((F.col("threshold") <= 0.5) & (F.col("recall") >= max(recalls)), F.col("threshold")))
    rules["dangerous"], rules["safe"] = largest, largest / 2
    row = swept.agg(*[c.alias(n) for n, c in rules.items()])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{r}`") for r in rules]))).alias("rule", "threshold"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc, n_pos, n_neg`` by average ranks, from counts at each distinct score.

    Distinct scores are dealt to ranges of about equal numbers of them (Spark samples the
    borders), however close they lie; the ranges' sums are added up in order, and then each
    range's own, so that no task ranks more than one range. Null scores are left out."""
    n = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s"))
    n = n.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    # Borders are sampled anew whenever the plan runs, so the ranges are written down.
    ranged = stored(n.repartitionByRange("s").withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("range").agg(F.sum("q").alias("q_range"))  # as many as shuffle partitions
    before = F.sum("q_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.join(F.broadcast(ranges), "range")
    ranked = ranked.withColumn("below", F.col("before") + F.coalesce(F.sum("q").over(w), F.lit(0)))
    sums = ranked.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.select(F.round(F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)), 6).alias("auc"), "n_pos", "n_neg")


def health(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Mean, population deviation, least and most of each class, margin and overlap."""
    s, real = F.col(score), F.col(label) == 1
    out = []
    for name, c in (("pos", real), ("neg", ~real)):
        x = F.when(c, s)
        out += [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
    wrong = F.count_if((real & (s < cut)) | (~real & (s >= cut))) / F.greatest(F.count(F.lit(1)), F.lit(1))
    row = df.agg(*out, wrong.alias("overlap"), (F.max(s) - F.min(s)).alias("range"))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns], F.round(F.col("pos_mean") - F.col("neg_mean"), 6).alias("margin"))


# Widths of a score range up to which it is narrow, and from which it is good.
NARROW, GOOD = 0.1, 0.5


def score_bands(df: DataFrame, score: str, by: str) -> DataFrame:
    """``by, least, most, width, band`` of the scores of each model: one that hardly varies tells nothing apart."""
    r = df.groupBy(by).agg(F.min(score).alias("least"), F.max(score).alias("most"))
    r = r.withColumn("width", F.round(F.col("most") - F.col("least"), 9))
    return r.withColumn("band", F.when(F.col("width") < NARROW, "NARROW").when(F.col("width") > GOOD, "GOOD").otherwise("MODERATE"))


def fit_verdict(train: DataFrame, held: DataFrame) -> DataFrame:
    """``verdict, gap`` of two metric rows."""
    gap = F.col("t.f1") - F.col("h.f1")
    verdict = F.when(gap > OVERFIT_GAP, "OVERFIT").when((F.col("t.f1") < UNDERFIT_F1) & (F.col("h.f1") < UNDERFIT_F1), "UNDERFIT").otherwise("OK")
    return train.alias("t").join(F.broadcast(held.alias("h"))).select(verdict.alias("verdict"), F.round(gap, 6).alias("gap"))


def stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """``gap, verdict`` of the F1 of two metric rows."""
    gap = F.abs(F.col("a.f1") - F.col("b.f1"))
    return a.alias("a").join(F.broadcast(b.alias("b"))).select(F.round(gap, 6).alias("gap"), F.when(gap < STABLE_GAP, "STABLE").otherwise("UNSTABLE").alias("verdict"))


def violated(metrics: DataFrame, has_held_out: bool) -> DataFrame:
    """The metric rows (f1, margin, overlap, fpr, overfit) with the limits that they break."""
    checks = [
        F.when(F.col("f1") < LEAST_F1, "f1"), F.when(F.col("margin") < LEAST_MARGIN, "margin"),
        F.when(F.col("overfit"), "overfit"), F.when(F.lit(not has_held_out) & (F.col("overlap") > MOST_OVERLAP), "overlap"),
        F.when(F.col("fpr") > MOST_FPR, "fpr"),
    ]
    return metrics.withColumn("violated", F.filter(F.array(*checks), lambda x: x.isNotNull()))
