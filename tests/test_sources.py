"""Readers and writers on small files."""

import json

from riskspark.sources import readers, sinks


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Label_id\tText\n0\tfine\n4\tbad\textra\n7\n")
    got = [tuple(x) for x in readers.tsv(spark, str(tmp_path / "a.tsv"), ["Label_id", "Text"]).collect()]
    assert got == [("0", "fine"), ("4", "bad")]
    (tmp_path / "b.txt").write_bytes(b"ham\thello\tthere\nspam\twin \xff now\nno tab\n")
    got = [tuple(x) for x in readers.labelled_lines(spark, str(tmp_path / "b.txt")).collect()]
    assert got[0] == ("ham", "hello\tthere") and got[1][0] == "spam" and len(got) == 2
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/x.txt").write_text(" http://a \n\nhttp://b\n")
    assert {x.text for x in readers.text_lines(spark, str(tmp_path / "feed")).collect()} == {"http://a", "http://b"}


def test_json_files(spark, tmp_path):
    rules = [{"domain": "a.com", "reason": "r", "source": "s"}]
    (tmp_path / "r.json").write_text(json.dumps(rules))
    (tmp_path / "k.json").write_text(json.dumps(["x", "y"]))
    assert readers.rule_file(spark, str(tmp_path / "r.json")).first().domain == "a.com"
    assert readers.keyword_list(spark, str(tmp_path / "k.json")) == ["x", "y"]
    assert readers.keyword_list(spark, str(tmp_path / "none.json"), ["d"]) == ["d"]
    assert readers.first_existing(spark, [str(tmp_path / "v2"), str(tmp_path / "k.json")]) == str(tmp_path / "k.json")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi",\nthere', 1), (None, 0)], "text string, label int")
    sinks.write_csv(df, str(tmp_path / "c"), quote_all=True)
    back = readers.csv_with_header(spark, str(tmp_path / "c"), df.schema)
    assert {tuple(x) for x in back.collect()} >= {('say "hi",\nthere', 1)}


def test_rewrites(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "id long, timestamp long")
    assert [x.id for x in sinks.newest(df, 2).collect()] == [2, 3]
    assert sinks.emptied(df).count() == 0
    from pyspark.sql import functions as F

    assert sinks.migrated(df, {"extra": F.lit("x"), "id": F.lit(0)}).columns == ["id", "timestamp", "extra"]
    sinks.write_split(df, {"low": F.col("id") < 2, "high": F.col("id") >= 2}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/high")).count() == 2
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
