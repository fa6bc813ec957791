"""What queries spend on long texts and on full batches."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.functions import text as X
from riskspark.operators import corpus, index


@pytest.fixture(scope="module")
def seconds(spark):
    """Seconds of a column expression over one long text of a repeated piece."""

    def of(piece, times, f):
        spark.range(1).select(f(F.lit(piece))).collect()
        rows = spark.range(1).select(F.repeat(F.concat(F.lit(piece), F.col("id").cast("string")), F.lit(times)).alias("t"))
        start = time.time()
        rows.select(F.md5(f(F.col("t")).cast("string"))).collect()
        return time.time() - start

    return of


@pytest.mark.parametrize("changed", [lambda c: corpus.with_typos(c, {"e": "a3"}), corpus.with_noise, corpus.with_spaces])
def test_long_texts_are_hashed_once(seconds, changed):
    assert seconds("e ", 50_000, changed) < 8


def test_a_batch_of_token_counts_holds_one_text_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Abc ab"), (2, None), (3, ""), (4, "x"), (5, "...")], "doc_id long, text string")
    made, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *more: made.append(f) or real(self, f, *more))
    assert sorted(map(tuple, index.token_counts(docs).collect())) == [(1, 4, 3), (4, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["abcdefg hij " * 2000] * 200)], names=["doc_id", "text"])
    index.letters()
    tracemalloc.start()
    assert [b.num_rows for b in made[0](iter([batch]))] == [200]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_entropy_of_long_texts(seconds, one):
    assert seconds("abcdefgh", 1_000_000, X.entropy) < 10
    assert [one(t, X.entropy) for t in ("", None, "aabb", "ab" * 9 + "😀😀", "é")] == [0.0, None, 1.0, pytest.approx(1.368996, abs=1e-6), 0.0]


def test_a_segment_reads_its_documents_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    counted = F.udf(count, "string").asNondeterministic()
    docs = spark.createDataFrame([(k, f"word{k} abc") for k in range(50)], "doc_id long, text string")
    grown = index.Segments(spark, str(tmp_path / "grown"))
    grown.inserted(docs.select("doc_id", counted("text").alias("text")))
    assert read.value == 50 and grown.n_documents() == 50


def test_scores_next_to_whole_numbers(spark):
    scores = [w / 1000 + d for w in (0, 1, 7, 64_999, 65_535, 70_000) for d in (0.0, 4e-13, -4e-13, 6e-13, -6e-13, 1e-11, -1e-11, 5e-4)]
    df = spark.createDataFrame([(abs(s),) for s in scores], "s double")
    plain = F.least(F.floor(F.round(1000 * F.col("s"), 9)), F.lit(65_535)).cast("int")
    assert df.where(index.fixed_point(F.col("s")) != plain).count() == 0
