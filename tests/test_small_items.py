"""Small readers, writers and fixed values."""

import json

import pytest
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions import text as X
from riskspark.functions import tokenizers
from riskspark.operators import decisions, retrieval
from riskspark.sources import readers, sinks
from riskspark.streaming import folds


def test_scores_of_levels_and_reports(spark):
    df = spark.createDataFrame([("SAFE",), ("SUSPICIOUS",), ("DANGEROUS",), ("?",)], "l string")
    got = {r.l: (r.a, r.b) for r in df.select("l", F.round(decisions.level_score(F.col("l")).cast("double"), 4).alias("a"), F.round(decisions.report_score(F.col("l")).cast("double"), 4).alias("b")).collect()}
    assert got == {"SAFE": (0.15, 0.1), "SUSPICIOUS": (0.445, 0.3), "DANGEROUS": (0.795, 0.8), "?": (None, None)}
    back = df.where("l <> '?'").select("l", decisions.level(decisions.level_score(F.col("l"))).alias("again")).collect()
    assert all(r.l == r.again for r in back)


def test_alert_tiers(spark):
    tiers = {r.level: tuple(r)[1:] for r in decisions.alert_config(spark).collect()}
    assert set(tiers) == set(schemas.LEVELS) and tiers["SAFE"] == (0, False, False, False, False)
    assert tiers["DANGEROUS"] == (300, True, True, True, True) and tiers["SUSPICIOUS"][0] == 300 and not tiers["SUSPICIOUS"][1]


@pytest.mark.parametrize(("name", "start"), [("DAY", "2024-03-09 12:30:00"), ("WEEK", "2024-03-03 12:30:00"), ("MONTH", "2024-02-09 12:30:00"), ("YEAR", "2023-03-11 12:30:00"), ("TODAY", "2024-03-10 00:00:00"), ("ALL", "1970-01-01 00:00:00")])
def test_starts_of_time_ranges(spark, name, start):
    at = F.lit("2024-03-10 12:30:00").cast("timestamp")
    assert spark.range(1).select(decisions.since_start(name, at).cast("string").alias("s")).first().s == start


def test_vocabulary_round_trip(spark, tmp_path):
    vocabulary = {"a": 4, "▁the": 5, "zé": 6}
    sinks.write_vocabulary(vocabulary, spark, str(tmp_path / "v"))
    assert tokenizers.load_vocabulary(spark, str(tmp_path / "v")) == vocabulary


def test_missing_files_and_seed_rules(spark, tmp_path):
    assert readers.or_empty(spark, str(tmp_path / "none.json"), readers.rule_file, schemas.RULE_FILE).count() == 0
    (tmp_path / "w.json").write_text(json.dumps([{"domain": "good.com", "reason": "r", "source": "s"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"domain": "bad.com", "reason": "r", "source": "s"}]))
    white, black = (readers.or_empty(spark, str(tmp_path / f"{k}.json"), readers.rule_file, schemas.RULE_FILE) for k in "wb")
    seeded = readers.seed_rules(spark.createDataFrame([], schemas.DOMAINS), white, black, 7)
    assert {(r.domain, r.category, r.addedAt) for r in seeded.collect()} == {("good.com", "WHITELIST", 7), ("bad.com", "BLACKLIST", 7)}
    assert readers.seed_rules(seeded.where("domain = 'bad.com'"), white, black, 9).count() == 1


def test_feeds(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps([{"url": "http://a", "domain": "a", "verified": True}, {"url": "http://b", "domain": "b", "verified": False}, {"url": "http://c", "domain": "c"}]))
    assert [r.domain for r in readers.phish_feed(spark, str(tmp_path / "feed.json")).collect()] == ["a"]
    (tmp_path / "diff.json").write_text(json.dumps({"adds": ["x.com"], "removes": [], "signature": None}))
    assert readers.rules_diff(spark, str(tmp_path / "diff.json")).first().adds == ["x.com"]


def test_folders_of_csv_and_three_field_lines(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text('text,label\n"one, ""two""",1\n')
    (tmp_path / "c/b.csv").write_text("text,label\nthree,0\n")
    got = readers.csv_with_header(spark, str(tmp_path / "c"))
    assert {tuple(r) for r in got.collect()} == {('one, "two"', "1"), ("three", "0")}
    (tmp_path / "t.tsv").write_bytes(b"ham\thello there\tx\nspam\tno third\nspam\twin\t1\textra\nother\ta\tb\n")
    rows = readers.labelled_lines(spark, str(tmp_path / "t.tsv"), 3, ["ham", "spam"]).collect()
    assert [tuple(r) for r in rows] == [("ham", "hello there"), ("spam", "win")]


def test_results_as_json(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, 0.5)], "n int, f1 double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().f1 == 0.5


def test_strip_www(one):
    assert [one(x, X.strip_www) for x in ("www.a.com", "a.www.com", "wwwa.com")] == ["a.com", "a.www.com", "wwwa.com"]


def test_feedback_joins_the_index(spark):
    rows = [(1, 10, "ab bc", "PHISHING"), (2, 5, "ab ab", "FALSE_POSITIVE")]
    feedback = spark.createDataFrame(rows, "id long, timestamp long, tokens string, label string")
    static = spark.createDataFrame([("ab", 0, 50), ("bc", 0, 5)], "token string, doc_id long, score int")
    added = retrieval.feedback_postings(feedback, first_doc=100)
    assert {(r.token, r.doc_id, r.score, r.label) for r in added.collect()} == {("ab", 100, 10, 0), ("ab", 101, 100, 1), ("bc", 101, 100, 1)}
    both = static.unionByName(added.select("token", F.col("doc_id").cast("long"), "score"))
    found = retrieval.search(spark.createDataFrame([(1, "abc")], "q int, t string"), both, "q", "t", 2)
    assert [(r.doc_id, r.score) for r in found.orderBy("rank").collect()] == [(101, 200), (0, 55)]


def test_first_verdicts_of_a_stream(spark, tmp_path):
    rows = [("a.com", "2024-01-01 00:00:00"), ("a.com", "2024-01-01 00:01:00"), ("b.com", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "d string, at string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("d string, at timestamp").json(str(tmp_path / "in"))
    q = folds.first_verdicts(stream, "d", "at").writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.d for r in spark.table("verdicts").collect()) == ["a.com", "b.com"]
