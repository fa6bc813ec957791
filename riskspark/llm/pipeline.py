"""Stages of the corpus pipeline. Each takes the documents that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import langid, lines, minhash, packing, pii
from riskspark.llm.common import delete_folder, shared_folder, small_batches, table

#: Key of the pseudonyms; whoever runs the job puts their own.
PII_KEY = "example key"
#: Chunks whose ids a worker keeps: stages that follow each other share the workers' memory.
STORED_CHUNKS = 200_000

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence, unchanged. Null texts and texts
    without a letter have no language and go; repeated rows are judged alike."""
    small_batches(spark)
    judged = langid.identify(docs, langid.fit(docs))
    return judged.where(~judged["rejected"]).select(docs.columns)


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of the changed text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats. A document of which no
    line is left goes: all of it is in others. Null and blank texts stay as they are."""
    small_batches(spark)
    kept = lines.dedup_lines(docs)
    nothing_left = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    return _with_length(kept.where(~nothing_left), docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class, unchanged. Texts
    without words (null ones too) are one class; of rows with equal ids one stays."""
    small_batches(spark)
    return minhash.distinct_documents(docs)


def hide_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced by pseudonyms. Null texts stay null."""
    return _with_length(pii.pseudonymize(docs, PII_KEY), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left. A null text is the end id alone."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), stored_chunks=STORED_CHUNKS)


STAGES: list[Stage] = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("PII", hide_private_values),
    ("packing", pack),
]


def run_stages(spark: SparkSession, sf_dir: str, stages: Sequence[Stage]) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the
    shared folder and read again. A result is deleted when the next one is written; the
    last one stays for the reader."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(stages):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{k}"
    return docs
