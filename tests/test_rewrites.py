"""Tables changed by key, chains of rule updates, and ranks under skew."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions import text as X
from riskspark.operators import decisions, evaluate
from riskspark.sources import sinks, snapshots

ROWS = "id long, category string, score double"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(k, "old", k / 10) for k in range(100)]
    df = spark.createDataFrame(rows, ROWS).repartitionByRange(5, "id").sortWithinPartitions("id")
    return snapshots.FileTable(spark, str(tmp_path / "t"), "id").created(df)


def held(t):
    return {tuple(r) for r in t.rows().collect()}


def test_only_files_with_a_changed_key_are_written_again(spark, table):
    before, rows = set(table.files()), held(table)
    assert len(before) == 5
    table.merged(spark.createDataFrame([(3, "new", 9.0, 1), (3, "newer", 8.0, 2), (4, "new", None, 1)], ROWS + ", seq int"), "seq")
    after = set(table.files())
    assert len(before - after) == 1 and len(before & after) == 4
    assert held(table) == {r for r in rows if r[0] not in (3, 4)} | {(3, "newer", 8.0), (4, "new", None)}


def test_updates_of_some_columns(spark, table):
    table.merged(spark.createDataFrame([(7, "seen"), (500, "seen")], "id long, category string"), insert=False)
    assert {r for r in held(table) if r[1] == "seen"} == {(7, "seen", 0.7)}
    table.merged(spark.createDataFrame([(500, "seen"), (None, "null")], "id long, category string"))
    assert {(500, "seen", None), (None, "null", None)} <= held(table) and len(held(table)) == 102
    table.merged(spark.createDataFrame([(None, "again")], "id long, category string"))
    assert (None, "again", None) in held(table) and len(held(table)) == 102
    table.merged(spark.createDataFrame([(7, 1)], "id long, flag int"))  # a column that is new
    assert {r.flag for r in table.rows().where("id = 7").collect()} == {1} and table.rows().where("flag IS NULL").count() == 101


def test_updates_by_condition_and_deletes(spark, table):
    files = set(table.files())
    table.updated(F.col("id") < 5, {"category": F.concat("category", F.lit("er")), "score": F.col("score") + 1})
    assert {r for r in held(table) if r[0] < 5} == {(k, "older", k / 10 + 1) for k in range(5)} and len(set(table.files()) & files) == 4
    table.without(spark.createDataFrame([(99,), (0,), (12345,)], "id long"))
    assert len(held(table)) == 98 and len(set(table.files()) & files) == 3
    now = set(table.files())
    table.without(spark.createDataFrame([(12345,)], "id long"))
    assert set(table.files()) == now
    table.cleaned()
    assert len(held(table)) == 98


def test_a_change_that_is_not_told_apart(spark, table):
    with pytest.raises(ValueError, match="newest"):
        table.merged(spark.createDataFrame([(3, "a"), (3, "b")], "id long, category string"))
    assert (3, "old", 0.3) in held(table)


def test_a_job_that_dies_changes_nothing(spark, table):
    before = held(table)
    with pytest.raises(Exception, match="stop"):
        table.merged(spark.createDataFrame([(3, "a")], "id long, category string").withColumn("category", F.expr("CAST(raise_error('stop') AS STRING)")))
    assert held(table) == before


def test_upserted(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 9), (2, "z", 1), (3, None, 1), (None, "m", 1)], "k int, v string, s int")
    got = {tuple(r) for r in sinks.upserted(old, new, "k", "s").select("k", "v", "w").collect()}
    assert got == {(1, "a", 1), (2, "y", None), (3, None, None), (None, "m", None)}
    assert {tuple(r) for r in sinks.upserted(old.select("k", "v"), new.where("k = 3").select("k", "v"), "k").collect()} == {(1, "a"), (2, "b"), (None, "n"), (3, None)}


@pytest.mark.parametrize(("a", "b", "order"), [("1.2", "1.10", -1), ("1.0", "1", 0), ("2.x", "2.0.0", 0), ("", "0", 0), ("1.0.1", "1", 1), ("x", "0.1", -1)])
def test_versions_compare_by_key(spark, a, b, order):
    x, y = X.version_key(F.lit(a)), X.version_key(F.lit(b))
    assert spark.range(1).select(F.when(x < y, -1).when(x > y, 1).otherwise(0)).first()[0] == order
    assert spark.range(1).select(X.version_order(F.lit(a), F.lit(b))).first()[0] == order


RULES = [("white.com", "WHITELIST", "s", 0, 1.0), ("black.com", "BLACKLIST", "s", 0, 1.0)]
RULE = "domain string, category string, source string, addedAt long, confidence float"


def chain(spark, diffs):
    """Updates and changes of (version, additions, removals, forged)."""
    updates, changes = [], []
    for seq, (version, adds, removes, forged) in enumerate(diffs, 1):
        sign = hashlib.sha256("\n".join(adds + removes).encode()).hexdigest().upper()
        updates.append((seq, version, "0" * 64 if forged else sign, 10 * seq))
        changes += [(seq, gone, k, d) for gone, part in ((False, adds), (True, removes)) for k, d in enumerate(part)]
    return spark.createDataFrame(updates, "seq int, version string, signature string, at long"), spark.createDataFrame(changes, "seq int, gone boolean, place int, domain string")


def plain_chain(diffs, local):
    """One update after another, one change after another."""
    rules = {r[0]: (r[1], r[3]) for r in RULES}
    key = lambda v: [int(p) for p in v.split(".")]
    for seq, (version, adds, removes, forged) in enumerate(diffs, 1):
        if key(version) <= key(local) or len(adds) + len(removes) > 10_000 or forged:
            continue
        local = version
        for d in adds:
            if rules.get(d, ("",))[0] != "WHITELIST":
                rules[d] = ("BLACKLIST", 10 * seq)
        for d in removes:
            rules[d] = ("WHITELIST", 10 * seq)
    return rules


def test_a_chain_of_updates(spark):
    many = [f"many{k}.com" for k in range(10_001)]
    diffs = [
        ("1.0", ["same.com"], [], False), ("1.2", ["one.com", "white.com", "two.com", "black.com"], ["two.com"], False), ("1.1", ["late.com"], [], False),
        ("1.3", ["forged.com"], ["one.com"], True), ("1.10", ["two.com", "three.com"], ["black.com"], False), ("2.0", many, [], False), ("2.1", many[:10_000], [], False),
        ("2.1", ["again.com"], [], False), ("3", ["one.com"], ["three.com", "white.com"], False),
    ]
    rules = spark.createDataFrame(RULES, RULE)
    got = {r.domain: (r.category, r.addedAt) for r in decisions.chained_rules(rules, *chain(spark, diffs), "1.0").collect()}
    assert got == plain_chain(diffs, "1.0") and len(got) > 10_000
    accepted = decisions.accepted_updates(*chain(spark, diffs), "1.0").where("accepted").orderBy("seq").collect()
    assert [r.seq for r in accepted] == [2, 5, 7, 9]


def test_random_chains(spark):
    for seed in range(4):
        r = random.Random(seed)
        names = [f"d{k}.com" for k in range(6)] + ["white.com", "black.com"]
        diffs = [(f"{r.randint(1, 3)}.{r.randint(0, 3)}", r.sample(names, r.randint(0, 4)), r.sample(names, r.randint(0, 2)), r.random() < 0.2) for _ in range(12)]
        got = {x.domain: (x.category, x.addedAt) for x in decisions.chained_rules(spark.createDataFrame(RULES, RULE), *chain(spark, diffs), "1.1").collect()}
        assert got == plain_chain(diffs, "1.1")


def test_updates_with_gates(spark):
    rules = spark.createDataFrame(RULES, RULE)
    sign = hashlib.sha256(b"new.com").hexdigest()
    diff = spark.createDataFrame([("1.5", ["new.com"], [], sign)], "version string, adds array<string>, removes array<string>, signature string")
    assert decisions.updated_rules(rules, diff, 5, "1.4").count() == 3 and decisions.updated_rules(rules, diff, 5, "1.5").count() == 2


def test_changes_of_bad_names(spark):
    diffs = [("1.1", [" Upper.COM ", "-bad.com", "no_dots", "x.c", "ok.org"], [], False)]
    got = {r.domain for r in decisions.chained_rules(spark.createDataFrame(RULES, RULE), *chain(spark, diffs), "1").where("source = 'remote'").collect()}
    assert got == {"upper.com", "ok.org"}


def plain_auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y != 1]
    return round(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)), 6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_of_scores_that_pile_up(spark, seed):
    r = random.Random(seed)
    rows = [(0.5 + 1e-9 * r.randrange(400) if r.random() < 0.9 else r.random(), r.randrange(2)) for _ in range(600)] + [(0.5, 1)] * 40
    df = spark.createDataFrame(rows, "s double, y int")
    got = evaluate.auc(df.unionByName(spark.createDataFrame([(None, 1)], "s double, y int")), "s", "y").first()
    assert got.auc == pytest.approx(plain_auc(rows), abs=1e-6) and got.n_pos + got.n_neg == len(rows)


def test_ranges_of_skewed_scores_are_even(spark, monkeypatch):
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, 0.5 + F.col("id") * 1e-10).otherwise(F.col("id") / 4000).alias("s"), (F.col("id") % 3).cast("int").alias("y"))
    kept, real = [], evaluate.stored
    monkeypatch.setattr(evaluate, "stored", lambda d: kept.append(real(d)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        evaluate.auc(df, "s", "y").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept[0].groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
