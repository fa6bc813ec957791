"""Draws of the fingerprints: Ioffe's, from independent Gamma variates, in few rows."""

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import fingerprints


def _generated_rows(plan) -> list[int]:
    """Rows that each Generate step of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _generated_rows(plan.executedPlan())
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    return own + [n for p in below for n in _generated_rows(p)]


def test_few_rows_of_a_term_are_drawn(spark):
    texts = [(k, " ".join(f"w{k}_{i}" for i in range(500)) + " a b a b a b") for k in range(20)]
    df = fingerprints.fingerprints(spark.createDataFrame(texts, "k long, t string"), ["k"], "t")
    assert len(df.collect()) == 20
    terms = 20 * 504  # 499 and the one to the last words, "a b", "b a", the last word
    rows = _generated_rows(df._jdf.queryExecution().executedPlan())
    # A row for each term, and four of sixteen samples each.
    assert rows and sum(rows) <= 5 * terms


def test_draws_are_of_gamma_variates(spark):
    """The draw of a repeated term is Ioffe's, of variates that are independent Gamma(2, 1) and uniform ones."""
    n = 20_000
    rows = spark.range(n).select(
        F.xxhash64("id").alias("_again"), F.xxhash64("id").alias("_seed"), F.log(F.col("id") % 40 + 2.0).alias("_weight")
    )
    h, more, once, drawn, weight = (
        np.array(x)
        for x in zip(
            *rows.select(
                F.expr(fingerprints._hash("_again", 3)),
                F.expr(f"xxhash64({fingerprints._hash('_again', 3)})"),
                F.expr(fingerprints._once(3)),
                F.coalesce(F.expr(fingerprints._repeated(3)), F.lit(-1)),
                "_weight",
            ).collect(),
            strict=True,
        )
    )
    h, more = h.astype("i8").view("u8"), more.astype("i8").view("u8")
    uniform = ((h >> np.uint64(17)) + 0.5) * 2.0**-47
    a, b = -np.log1p(-uniform), -np.log(((more & np.uint64(2**32 - 1)) + 0.5) * 2.0**-32)
    y = -np.log(((more >> np.uint64(32)) + 0.5) * 2.0**-32)
    c, r = a + b, y - np.log(a / (a + b))
    shift = y / r
    for x in (c, r):
        # Mean 2, variance 2, as Gamma(2, 1).
        assert abs(x.mean() - 2) < 0.05 and abs(x.var() - 2) < 0.15
        assert abs(np.mean(x < 1) - (1 - 2 / np.e)) < 0.012
    assert np.abs(np.histogram(shift, 10, (0, 1))[0] / n - 0.1).max() < 0.01
    assert np.abs(np.corrcoef([c, r, shift, shift**2, c * r]) - np.eye(5))[:3, :3].max() < 0.03
    level = np.floor(weight / r + shift)
    want = -np.expm1(-c * np.exp(-r * (level - shift) - r))
    assert abs(np.mean(level == 0) - np.mean(np.exp(-weight))) < 0.01 and ((drawn == -1) == (level == 0)).mean() > 0.9999
    # The draw of the weight 1 is of the level 0.
    assert np.abs(-np.expm1(-c * np.exp(r * shift - r)) - (once >> 16) / 2.0**47).max() < 1e-9
    got = drawn[level > 0] >> 16
    assert np.abs(got / 2.0**47 - want[level > 0]).max() < 1e-9
    assert (got <= once[level > 0] >> 16).all()
