"""Operators on small tables: edge cases, brute force, invariants."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import corpus, decisions, editjoin, evaluate, retrieval, tables
from riskspark.sources import sinks
from riskspark.streaming import folds


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_join_is_exact(spark):
    r = random.Random(1)
    words = list({"".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    for most in (1, 3):
        got = {(x["query"], x["word"], x["distance"]) for x in editjoin.edit_join(df, df, "w", "w", most).collect()}
        assert got == {(a, b, plain_distance(a, b)) for a in words for b in words if plain_distance(a, b) <= most}


def test_closest_breaks_ties_by_word(spark):
    q, w = spark.createDataFrame([("google.com",)], "q string"), spark.createDataFrame([("gogle.com",), ("gooogle.com",)], "w string")
    assert editjoin.closest(q, w, "q", "w").first().word == "gogle.com"
    assert editjoin.has_near(spark.createDataFrame([("xyzxyz",)], "q string"), spark.createDataFrame([("abc",)], "w string"), "q", "w").count() == 0
    assert editjoin.edit_join(q, w.limit(0), "q", "w").count() == 0


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, s int")
    got = {tuple(x) for x in sinks.upserted(old, new, "k", "s").select("k", "v").collect()}
    assert got == {("a", 1), ("b", 3), ("c", 4)}


def test_metrics(spark):
    df = spark.createDataFrame([("x", 10), ("x", 20), ("x", 30), ("y", 0)], "name string, ms int")
    got = {x["name"]: tuple(x)[1:] for x in tables.metrics(df, "name", "ms").collect()}
    assert got == {"x": (3, 60, 30, 10), "y": (1, 0, 0, None)}


def test_conflicts_are_a_left_fold(spark):
    rows = [("t", 1, 1, 3), ("t", 2, 1, 0), ("t", 3, 0, 2), ("u", 1, 1, 3), ("u", 2, 1, 0), ("u", 3, 0, 2), ("u", 4, 1, 1), ("w", 1, 0, 0)]
    df = spark.createDataFrame(rows, "k string, s int, l int, p int")
    got = {x["k"]: (x["label"], x["changed"]) for x in corpus.resolve_conflicts(df, "k", "s", "l", "p").collect()}
    assert got == {"t": (0, 1), "u": (1, 2), "w": (0, 0)}


def test_balance_and_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = {x["label"]: x["n"] for x in corpus.label_counts(corpus.balanced(df, "label", F.col("id")), "label").collect()}
    assert n == {0: 100, 1: 100}
    held = corpus.split(df, F.col("id")).where("held_out").count()
    assert 60 < held < 150


def test_balance_picks_the_first_by_hash_and_keeps_null_labels(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("label"))
    df = df.where("label is null or label < 3 or id < 40")
    all_rows = df.withColumn("h", corpus.deal(F.col("id"))).collect()
    want = set()
    for label in {r.label for r in all_rows}:
        want |= {r.id for r in sorted((r for r in all_rows if r.label == label), key=lambda r: r.h)[:10]}
    assert {r.id for r in corpus.balanced(df, "label", F.col("id")).collect()} == want


def test_texts_with_placeholders_go(spark):
    df = spark.createDataFrame([("call PHONE",), ("Your name",), ("xxXx",), ("plain text",), ("",), (None,)], "text string")
    assert [r[0] for r in corpus.uncontaminated(df).collect()] == ["plain text", ""]


def test_labels_are_inverted_only_if_binary(spark):
    def turned(values):
        df = spark.createDataFrame([(v,) for v in values], "label int")
        return [r[0] for r in corpus.inverted_if_binary(df, "label").collect()]

    assert turned([0, 1, None, 1]) == [1, 0, None, 0]
    assert turned([0, 1, 2]) == [0, 1, 2] and turned([1, 1]) == [1, 1] and turned([]) == []


def test_nearest_against_all_pairs(spark):
    from riskspark.functions.features import cosine_of_common
    from riskspark.operators import knn

    rows = [(i, [float((i * 7 + d * d) % 11 - 5) for d in range(12 if i % 3 else 9)], i % 2) for i in range(40)]
    rows += [(40, [0.0] * 12, 1), (41, None, 0), (42, [], 0)]
    t = spark.createDataFrame(rows, "id int, vector array<double>, label int")
    q = t.select(F.col("id").alias("query_id"), "vector")
    found = knn.nearest(q, t, k=5, most=30)
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in found.collect()}
    stored = t.where("vector is not null").orderBy(F.col("id").desc()).limit(30).select("id", F.col("vector").alias("v"))
    pairs = q.where("vector is not null").crossJoin(stored).select("query_id", "id", F.round(cosine_of_common(F.col("vector"), F.col("v")), 6).alias("s"))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.query_id, -r.s, r.id)):
        want.setdefault(r.query_id, []).append((r.id, r.s))
    assert got == {(n, k + 1): x for n, found in want.items() for k, x in enumerate(found[:5])}


def test_length_stats_take_the_upper_median(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 2, 3, 10)], "t string")
    r = corpus.length_stats(df, "t").first()
    assert (r.mean_len, r.median_len, r.min_len, r.max_len) == (4.0, 3, 1, 10)


def test_placeholders_and_noise_are_stable(spark):
    df = spark.createDataFrame([("Dear NAME call CELLPHONEQQ  now",), (None,), ("",)], "t string")
    a = [x[0] for x in df.select(corpus.fill_placeholders(F.col("t"))).collect()]
    b = [x[0] for x in df.repartition(3).select(corpus.fill_placeholders(F.col("t"))).collect()]
    assert sorted(a, key=str) == sorted(b, key=str) and "NAME" not in a[0] and "  " not in a[0]
    assert df.select(corpus.with_noise(F.col("t"), 0.5)).count() == 3


def test_scorer_failures_are_null(spark):
    df = spark.createDataFrame([("good",), ("good",), ("bad",)], "text string").repartition(1)

    def scorer():
        def score(texts):
            return [len(t) for t in texts]

        return score

    got = {x.text: x.score for x in corpus.scored(df, scorer).collect()}
    assert got == {"good": 4.0, "bad": 3.0}
    broken = corpus.scored(df, lambda: lambda texts: 1 / 0).collect()
    assert {x.score for x in broken} == {None}


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, l int")
    assert evaluate.auc(df, "s", "l").first().auc == 0.875
    assert evaluate.auc(df.where("l = 1"), "s", "l").first().auc is None
    assert evaluate.sweep(df.limit(0), "s", "l", [0.5]).first().tp == 0


def test_index_vote(spark):
    index = spark.createDataFrame([("ab", 0, 10), ("ab", 1, 20), ("cd", 1, 5)], "token string, doc_id long, score int")
    q = spark.createDataFrame([(1, "ab ab cd"), (2, "zz"), (3, None)], "q int, t string")
    got = {(x.query_id, x.doc_id): x.score for x in retrieval.search(q, index, "q", "t").collect()}
    assert got == {(1, 0): 20, (1, 1): 45}
    v = retrieval.votes(retrieval.search(q, index, "q", "t"), spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, label int"))
    assert [(x.query_id, x.ratio, x.n) for x in v.collect()] == [(1, 0.5, 2)]


def test_fusion(spark):
    df = spark.createDataFrame([(0.9, 0.1), (None, 0.1), (None, None)], "m double, b double")
    got = [x[0] for x in df.select(decisions.fused({"model": F.col("m"), "bm25": F.col("b")})).collect()]
    assert abs(got[0] - (0.45 + 0.02) / 0.7) < 1e-6 and abs(got[1] - 0.1) < 1e-6 and got[2] is None
    levels = spark.createDataFrame([(0.29,), (0.3,), (0.59,)], "s double").select(decisions.level(F.col("s"))).collect()
    assert [x[0] for x in levels] == ["SAFE", "SUSPICIOUS", "DANGEROUS"]


def test_domain_order_of_reasons(spark):
    rules = spark.createDataFrame([("good.com", "WHITELIST"), ("evil.com", "BLACKLIST")], "domain string, category string")
    names = ["good.com", "evil.com", "gооd.com", "goodd.com", "a1ipay", "x.crypto", "unknown-name.org", None]
    v = decisions.domain_verdicts(spark.createDataFrame([(n,) for n in names], "domain string"), rules)
    got = {x.domain: (x.verdict, x.reason) for x in v.collect()}
    assert got == {
        "good.com": ("ALLOW", "WHITELIST"), "evil.com": ("BLOCK", "BLACKLIST"), "gооd.com": ("BLOCK", "SUSPICIOUS"),
        "goodd.com": ("BLOCK", "SIMILAR"), "a1ipay": ("BLOCK", "HOMOPHONE"), "x.crypto": ("BLOCK", "WEB3"), "unknown-name.org": ("UNKNOWN", "NONE"),
    }


def test_rule_update(spark):
    assert decisions.update_accepted("1.2", "1.1.9", 3, 0) and not decisions.update_accepted("1.1", "1.1", 1, 0)
    assert not decisions.update_accepted("2", "1", 10_000, 1)
    rules = spark.createDataFrame([("white.com", "WHITELIST", "s", 0, 1.0)], "domain string, category string, source string, addedAt bigint, confidence float")
    import hashlib

    adds, removes = ["White.com ", "new.com", "bad_name", "both.com"], ["both.com"]
    sign = hashlib.sha256("\n".join(adds + removes).encode()).hexdigest()
    diff = spark.createDataFrame([(adds, removes, sign)], "adds array<string>, removes array<string>, signature string")
    got = {x.domain: x.category for x in decisions.updated_rules(rules, diff, 5).collect()}
    assert got == {"white.com": "WHITELIST", "new.com": "BLACKLIST", "both.com": "WHITELIST"}
    unsigned = diff.withColumn("signature", F.lit("0"))
    assert decisions.updated_rules(rules, unsigned, 5).count() == 1


def test_cooldown():
    c = folds.Cooldown()
    assert c.launches("a", 0, 300, False) and not c.launches("a", 299_999, 300, False) and c.launches("a", 300_000, 300, False)
    assert c.launches("b", 1, 300, False) and c.launches("z", 1, 0, False) and c.launches("z", 2, -1, False)
    c = folds.Cooldown()
    assert c.launches("a", 0, 10, True) and not c.launches("b", 1000, 10, True)
    assert c.launches("b", 5000, 10, True)  # a refused event does not start its own clock


def test_thresholds_match_the_recurrence():
    assert folds.calibrated([], []) == (0.10000000149011612, 0.5)
    s, d = folds.calibrated([0.9] * 200, [False] * 200)
    assert 0.1 < s <= 0.4 and d == 0.5
    s, d = folds.calibrated([0.0] * 200, [True] * 200)
    assert 0.4 <= d < 0.5


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "t string").write.json(str(tmp_path / "in"))
    q = folds.counts_by_type(spark.readStream.schema("t string").json(str(tmp_path / "in")), "t")
    q = q.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(x) for x in spark.table("counted").collect()} == {("a", 2), ("b", 1)}


def test_pandas_is_not_needed_for_empty_tables(spark):
    e = spark.createDataFrame(pd.DataFrame({"user": pd.Series([], dtype="int64"), "k": pd.Series([], dtype=str), "ms": pd.Series([], dtype="int64"), "tie": pd.Series([], dtype="int64"), "c": pd.Series([], dtype="float64")}), "user long, k string, ms long, tie long, c double")
    assert folds.replay_cooldown(e, "user", "k", "ms", "tie", "c").count() == 0


def test_bloom_has_no_false_negatives(spark):
    held = spark.range(300).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("k"))
    asked = held.unionByName(spark.range(300).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k")))
    got = {r.k: r.maybe for r in tables.bloom_members(asked, held, "k", 0.001, 1000).collect()}
    assert all(got[k] for k in got if k[0] == "d") and sum(got[k] for k in got if k[0] == "x") < 10


def test_bloom_is_sized_from_the_members(spark):
    held = spark.range(300_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("k"))
    asked = spark.range(2000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k"))
    assert tables.bloom_members(asked, held, "k").where("maybe").count() < 20


def test_bloom_query_asks_all_customers(spark, monkeypatch):
    from riskspark.plans import logs

    asked, ask = [], tables.bloom_members

    def spied(left, *rest, **more):
        asked.append(left.count())
        return ask(left, *rest, **more)

    monkeypatch.setattr(tables, "bloom_members", spied)
    logs.b9_bloom_members(spark, "/root/testdata/sf0.001").count()
    assert asked == [spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()]
    # With a filter that lets much through, the semi-join leaves the members alone.
    left, held = spark.range(1000).selectExpr("cast(id as string) k"), spark.range(500).selectExpr("cast(id as string) k")
    got = {r.k for r in tables.confirmed_members(left, held, "k", 0.5).collect()}
    assert got == {str(k) for k in range(500)}


def test_crops_and_variations_are_stable(spark):
    df = spark.createDataFrame([("abcdefghij" * 10,), ("short",), ("",)], "t string")
    cut = [r[0] for r in df.select(corpus.cropped(F.col("t"))).collect()]
    assert 30 <= len(cut[0]) <= 60 and cut[0] in "abcdefghij" * 10 and cut[1:] == ["short", ""]
    got = df.select(corpus.variations(F.col("t"), [("abc", ["X", "Y"])])).first()[0]
    assert got[0] in "XY" and "abc" not in got


def test_noise_is_drawn_by_the_text_alone(spark):
    texts = [(f"some text number {k} with some words in it",) for k in range(200)] + [("",), (None,), ("x",)]
    df = spark.createDataFrame(texts, "t string")
    make = lambda d: {r.t: tuple(r)[1:] for r in d.select("t", corpus.with_noise(F.col("t"), 0.3), corpus.with_typos(F.col("t"), {"e": "3", "o": "0q"}, 300), corpus.with_spaces(F.col("t"), 500)).collect()}
    first, again = make(df), make(df.repartition(5))
    assert first == again and first[""] == ("", "", "") and first[None] == (None, None, None) and first["x"][1:] == ("x", "x")
    typed = [(t, x[1]) for t, x in first.items() if t]
    assert all(len(a) == len(b) and all(x == y or y in {"e": "3", "o": "0q"}.get(x, "") for x, y in zip(a, b, strict=True)) for a, b in typed)
    changes = sum(x != y for a, b in typed for x, y in zip(a, b, strict=True))
    letters = sum(a.count("e") + a.count("o") for a, _ in typed)
    assert 0.2 < changes / letters < 0.4
    spaced = [(t, x[2]) for t, x in first.items() if t]
    assert all(a.replace(" ", "") == b.replace(" ", "") and abs(len(a) - len(b)) <= 1 for a, b in spaced)
    assert {len(b) - len(a) for a, b in spaced} == {-1, 0, 1}
    assert sum(t != x[0] for t, x in first.items()) > 150


def test_reports_without_a_domain_are_none(spark):
    rows = [(1, "bad.com", "why"), (2, " ", "x"), (3, None, "y"), (4, "", "z"), (5, "worse.com", None)]
    got = tables.user_reports(spark.createDataFrame(rows, "id int, domain string, why string"), "id", "domain", "why", F.lit(7))
    assert [(r.id, r.domain, r.riskLevel, r.userAction, r.type, r.timestamp) for r in got.orderBy("id").collect()] == [
        (1, "bad.com", "USER_REPORT", "why", "SUSPICIOUS_DOMAIN", 7), (5, "worse.com", "USER_REPORT", None, "SUSPICIOUS_DOMAIN", 7),
    ]


def test_app_tables_and_lists_agree(spark):
    rows = [("u", "bank", "2024-01-01 00:00:01"), ("u", "share", "2024-01-01 00:00:02"), ("u", "bank", "2024-01-01 00:00:03"), ("v", None, "2024-01-01 00:00:03"), ("v", "bank", "2024-01-01 00:00:09")]
    e = spark.createDataFrame(rows, "who string, app string, at string").withColumn("at", F.col("at").cast("timestamp"))
    one = lambda apps: spark.createDataFrame([(a,) for a in apps], "name string")
    by_list = sorted(map(tuple, tables.screen_share_risk(e, ["bank"], ["share"], "who", "app", "at").collect()), key=str)
    by_table = sorted(map(tuple, tables.screen_share_risk(e, one(["bank", "bank", None]), one(["share"]), "who", "app", "at").collect()), key=str)
    assert [(a[0], a[1], a[2], bool(a[3])) for a in by_list] == [(b[0], b[1], b[2], bool(b[3])) for b in by_table] and any(b[3] for b in by_table)


def test_conflicts_of_many_priorities(spark):
    import random

    r = random.Random(11)
    rows = [(r.randrange(5), k, r.randrange(2), r.randrange(300)) for k in range(900)] + [(9, 1000 + k, k % 2, 300 - k) for k in range(100)]
    held = {}
    for key, seq, label, priority in rows:
        if key not in held:
            held[key] = (label, seq, priority, 0)
        elif label != held[key][0] and priority < held[key][2]:
            held[key] = (label, seq, priority, held[key][3] + 1)
    got = corpus.resolve_conflicts(spark.createDataFrame(rows, "k int, s int, l int, p int"), "k", "s", "l", "p").collect()
    assert {x.k: (x.label, x.seq, x.changed) for x in got} == {k: (v[0], v[1], v[3]) for k, v in held.items()} and held[9][3] == 99


def test_a_scorer_may_refuse_texts_but_not_fail(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("",), ("bb",)], "text string")

    def scorer():
        return lambda texts: [1 / len(t) for t in texts]

    assert {r.text: r.score for r in corpus.scored(df, scorer).collect()} == {"a": 1.0, "bb": 0.5, "": None}
    with pytest.raises(Exception, match="no such model"):
        corpus.scored(df, lambda: open("/no such model")).collect()
