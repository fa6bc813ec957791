"""Votes of the best documents that a text retrieves, and postings of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.text import ngram_bag

# Fixed value: documents that vote.
VOTERS = 10
#: Scores that a token adds for a feedback document, and from which such a document votes phishing.
FEEDBACK_SCORE, FEEDBACK_VOTE, MOST_FEEDBACK = {"PHISHING": 100, "FALSE_POSITIVE": 10}, 50, 2000


def search(queries: DataFrame, index: DataFrame, query_id: str, text: str, k: int = VOTERS) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the best ``k`` documents. A token that a
    query repeats counts as often; ties go to the smaller id."""
    tokens = queries.select(F.col(query_id).alias("query_id"), F.explode(ngram_bag(F.col(text))).alias("token"))
    tokens = tokens.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    scores = tokens.join(index, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * F.col("score")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def votes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``query_id, ratio, n``: the share of label 1 among the documents found."""
    joined = found.join(labels.select("doc_id", "label"), "doc_id")
    return joined.groupBy("query_id").agg(F.avg((F.col("label") == 1).cast("double")).alias("ratio"), F.count(F.lit(1)).alias("n"))


def feedback_postings(feedback: DataFrame, first_doc: int = 0, parity: bool = False) -> DataFrame:
    """Feedback rows (oldest ``MOST_FEEDBACK``) as documents after the static ones.
    ``label`` is the true one; with ``parity`` a legitimate document also votes
    phishing once five tokens match, as summed scores would have it."""
    w = Window.orderBy("timestamp", "id")
    kept = feedback.orderBy("timestamp", "id").limit(MOST_FEEDBACK).withColumn("doc_id", F.row_number().over(w) + (first_doc - 1))
    score = F.when(F.col("label") == "PHISHING", FEEDBACK_SCORE["PHISHING"]).otherwise(FEEDBACK_SCORE["FALSE_POSITIVE"])
    label = F.lit(None).cast("int") if parity else (F.col("label") == "PHISHING").cast("int")
    return kept.select(F.explode(F.array_distinct(F.split("tokens", " "))).alias("token"), "doc_id", score.alias("score"), label.alias("label"))


def overlap_vote(queries: DataFrame, feedback: DataFrame, query_id: str, text: str, k: int = VOTERS) -> DataFrame:
    """``query_id, ratio, n`` of the ``k`` feedback rows that share most distinct tokens."""
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(ngram_bag(F.col(text)))).alias("token"))
    f = feedback.select("id", (F.col("label") == "PHISHING").cast("int").alias("label"), F.explode(F.array_distinct(F.split("tokens", " "))).alias("token"))
    shared = q.join(f, "token").groupBy("query_id", "id", "label").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "id")
    top = shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.avg(F.col("label").cast("double")).alias("ratio"), F.count(F.lit(1)).alias("n"))
