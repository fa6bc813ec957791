"""Retrieval and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions.text import ngram_bag
from riskspark.operators import index, knn, retrieval
from riskspark.plans.registry import query, table
from riskspark.plans.texts import SMALL_SQL
from riskspark.sources.scratch import new_folder, stored

TOKENS_SQL = f"""
runs AS (SELECT id, unnest({SMALL_SQL}) AS run FROM src),
toks AS (SELECT id, unnest(CASE WHEN length(run) <= 2 THEN [run] ELSE list_concat(list_transform(range(1, length(run)), lambda i: run[i:i+1]), list_transform(range(1, length(run) - 1), lambda i: run[i:i+2])) END) AS token FROM runs)"""
SCORES_SQL = f"""
src AS (SELECT doc_id AS id, text FROM documents), {TOKENS_SQL},
tf AS (SELECT id, token, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS m FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT token, id AS doc_id, least(floor(round(1000 * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m)), 9)), 65535)::INT AS score FROM tf JOIN dl USING (id) JOIN df USING (token), st)"""
POSTINGS_SQL = f"""{SCORES_SQL},
ix AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, doc_id) <= 100)"""
ASKED_SQL = f"""
qr AS (SELECT item_id, unnest({SMALL_SQL}) AS run FROM benchmark),
qt AS (SELECT item_id, unnest(CASE WHEN length(run) <= 2 THEN [run] ELSE list_concat(list_transform(range(1, length(run)), lambda i: run[i:i+1]), list_transform(range(1, length(run) - 1), lambda i: run[i:i+2])) END) AS token FROM qr)"""


def _top_sql(postings: str) -> str:
    return f"""
fs AS (SELECT item_id AS query_id, doc_id, sum(score)::BIGINT AS score FROM qt JOIN {postings} USING (token) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fs QUALIFY rank <= 10)"""


SEARCH_SQL = f"{POSTINGS_SQL},{ASKED_SQL},{_top_sql('ix')}"
WHOLE_SEARCH_SQL = f"{SCORES_SQL},{ASKED_SQL},{_top_sql('sc')}"


@query(f"WITH {POSTINGS_SQL} SELECT token, doc_id, score FROM ix")
def v13_bm25_postings(spark, sf):
    made = index.postings(stored(index.blocks(table(spark, sf, "documents"))))
    return made.select(index.token_text(F.col("token")).alias("token"), "doc_id", "score")


def _asked(spark, sf):
    return stored(index.asked_tokens(table(spark, sf, "benchmark"), "item_id", "text"))


def _ranked(found):
    return found.select("query_id", "doc_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _found(spark, sf, blocks):
    """The best documents of each benchmark item, from the blocks of all documents."""
    asked = _asked(spark, sf)
    found, _ = index.search(asked, stored(index.impact_blocks(index.postings(blocks, asked=asked))), retrieval.VOTERS)
    return _ranked(found)


@query(f"WITH {SEARCH_SQL} SELECT query_id, doc_id, score, rank FROM top")
def j7_bm25_search(spark, sf):
    return _found(spark, sf, stored(index.blocks(table(spark, sf, "documents"))))


@query(f"WITH {SEARCH_SQL} SELECT query_id, round(avg((quality = 1)::INT), 6) AS ratio, count(*) AS n FROM top JOIN labels USING (doc_id) GROUP BY 1")
def a6_bm25_vote(spark, sf):
    found = _found(spark, sf, stored(index.blocks(table(spark, sf, "documents"))))
    v = retrieval.votes(found, table(spark, sf, "labels").withColumnRenamed("quality", "label"))
    return v.withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {WHOLE_SEARCH_SQL} SELECT query_id, doc_id, score, rank FROM top")
def st10_segmented_search(spark, sf):
    """The index grows by one segment a language, is compacted after half of them, and is then asked: all postings count."""
    docs, grown = table(spark, sf, "documents"), index.Segments(spark, new_folder(spark))
    languages = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    for n, lang in enumerate(languages):
        grown.inserted(docs.where(F.col("lang").eqNullSafe(F.lit(lang))))
        if n == len(languages) // 2:
            grown.compacted().cleaned()
    return _ranked(index.search_all(_asked(spark, sf), grown.blocks(), retrieval.VOTERS))


@query(f"""WITH src AS (SELECT item_id AS id, text FROM benchmark), {TOKENS_SQL}, t AS (SELECT DISTINCT id, token FROM toks),
s AS (SELECT q.id AS query_id, f.id, f.id % 2 AS label, count(*) AS shared FROM t q JOIN t f USING (token) GROUP BY ALL),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) <= 10)
SELECT query_id, round(avg(label), 6) AS ratio, count(*) AS n FROM top GROUP BY 1""")
def j8_overlap_vote(spark, sf):
    """All benchmark items are feedback, with the n-grams of their whole texts."""
    b = table(spark, sf, "benchmark")
    f = b.select(
        F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 1, "PHISHING").otherwise("FALSE_POSITIVE").alias("label"),
        F.array_join(F.array_distinct(ngram_bag(F.col("text"))), " ").alias("tokens"),
    ).where("tokens <> ''")
    v = retrieval.overlap_vote(b, f, "item_id", "text")
    return v.withColumn("ratio", F.round("ratio", 6))


@query("""WITH s AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings ORDER BY vec_id DESC LIMIT 200),
p AS (SELECT q.vec_id AS query_id, s.id, s.label, round(list_cosine_similarity(q.embedding::DOUBLE[], s.v::DOUBLE[]), 6) AS similarity FROM embeddings q, s),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p QUALIFY rank <= 10)
SELECT query_id, round(avg((label = 1)::INT), 6) AS ratio, CASE WHEN avg((label = 1)::INT) >= 0.7 THEN 'DANGEROUS' WHEN avg((label = 1)::INT) >= 0.4 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM top GROUP BY 1""")
def j9_knn_vote(spark, sf):
    e = table(spark, sf, "embeddings")
    found = knn.nearest(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")),
    )
    return knn.vote(found).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {TOKENS_SQL} SELECT token, count(DISTINCT id) AS df FROM toks GROUP BY 1")
def a7_document_frequency(spark, sf):
    _, df = index.statistics(index.blocks(table(spark, sf, "documents")))
    return df.select(index.token_text(F.col("token")).alias("token"), "df")
