"""Inverted index of character n-grams: blocks of postings, top documents without scoring all, segments.

A block holds the postings of one token in one run of documents, with what bounds their
scores. Blocks are made where the documents are read: only a block's arrays are shuffled,
dealt by their tokens. A search adds up the bounds of its tokens in each run of documents,
scores the most promising runs, and then only those whose bound reaches the worst of the
best scores so far. Where every posting counts, such bounds skip next to nothing: then the
blocks of the queries' tokens meet in their runs, and each run scores all its documents.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.sources.scratch import delete, names, stored
from riskspark.sources.snapshots import Lists

# BM25 parameters, fixed-point scores, postings of a token.
K1, B, SCALE, MOST_SCORE, MOST_POSTINGS = 1.5, 0.75, 1000, 65_535, 100
#: Documents of a run, and characters of it after which it ends all the same.
RUN_DOCUMENTS, RUN_CHARACTERS = 256, 1 << 22
#: Runs that a search scores before it knows a bound.
FIRST_RUNS = 4
#: Tokens of queries that are sent to all workers; queries and tokens that are multiplied at once.
SENT_TOKENS, AT_ONCE = 1_000_000, (256, 1024)
#: The token of rows that say how long a run's documents are.
LENGTHS = 0
BITS = 21  # of a character in a token's number
BLOCK = "token long, run long, n int, most_tf int, least_length int, docs array<long>, tfs array<int>, lengths array<int>"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter or a decimal digit."""
    kinds = map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))
    return np.fromiter((k[0] == "L" or k == "Nd" for k in kinds), bool, sys.maxunicode + 1)


def token_numbers(text: str) -> np.ndarray:
    """The n-grams of a lower-cased text, as often as they occur: a run of one or two
    letters as it is, a longer one as all its pairs and triples. A number holds the
    characters, 21 bits each from the left."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    ok = np.zeros(len(code) + 4, bool)
    ok[1 : len(code) + 1] = letters()[code]
    c = np.zeros(len(code) + 3, "i8")
    c[: len(code)] = code
    here, before, second, third = ok[1:-3], ok[:-4], ok[2:-2], ok[3:-1]
    n = len(code)
    one, two, three = c[:n] << (2 * BITS), c[1 : n + 1] << BITS, c[2 : n + 2]
    pairs = here & second
    alone = here & ~second & ~before
    triples = pairs & third
    return np.concatenate([one[alone], (one + two)[pairs], (one + two + three)[triples]])


def token_text(numbers: Column) -> Column:
    """The characters of tokens' numbers."""

    @F.pandas_udf("string")
    def characters(numbers: pd.Series) -> pd.Series:
        n = numbers.to_numpy("i8")
        mask = (1 << BITS) - 1
        points = np.stack([n >> (2 * BITS), (n >> BITS) & mask, n & mask], axis=1).astype("<u4")
        return pd.Series(points.view("<U3").ravel().astype(object))

    return characters(numbers)


def _blocks_of(ids: list[int], texts: list[str], run: int) -> pa.RecordBatch | None:
    found = [np.unique(token_numbers(t), return_counts=True) for t in texts]
    length = np.array([int(tf.sum()) for _, tf in found], "i4")
    some = np.flatnonzero(length)
    if not len(some):
        return None
    size = np.array([len(found[k][0]) for k in some])
    token = np.concatenate([found[k][0] for k in some])
    tf = np.concatenate([found[k][1] for k in some]).astype("i4")
    doc, long = np.repeat(np.array(ids, "i8")[some], size), np.repeat(length[some], size)
    by = np.argsort(token, kind="stable")
    token, tf, doc, long = token[by], tf[by], doc[by], long[by]
    begin = np.flatnonzero(np.diff(token, prepend=-1))
    # First the row of the documents themselves.
    ends = np.concatenate([[0, len(some)], len(some) + np.append(begin[1:], len(token))]).astype("i4")
    all_docs = np.concatenate([np.array(ids, "i8")[some], doc])
    all_tf, all_length = np.concatenate([np.zeros(len(some), "i4"), tf]), np.concatenate([length[some], long])
    columns = [
        np.append(LENGTHS, token[begin]), np.full(len(begin) + 1, run), np.diff(ends).astype("i4"),
        np.maximum.reduceat(all_tf, ends[:-1]), np.minimum.reduceat(all_length, ends[:-1]),
    ]
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (all_docs, all_tf, all_length)]
    fields = [f.split()[0] for f in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], names=fields)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``token, run, n, most_tf, least_length, docs, tfs, lengths``: a row for each token of
    each run of documents. Rows of token ``LENGTHS`` hold the documents that have any
    token, with their lengths. Null texts and ids are left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.lower(F.col(text)).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, texts, size, run = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(t)
                size += len(t)
                if len(ids) >= RUN_DOCUMENTS or size > RUN_CHARACTERS:
                    if (made := _blocks_of(ids, texts, run)) is not None:
                        yield made
                    ids, texts, size, run = [], [], 0, run + 1
        if ids and (made := _blocks_of(ids, texts, run)) is not None:
            yield made

    return rows.mapInArrow(make, BLOCK)


def by_token(made: DataFrame) -> DataFrame:
    """Rows dealt by token and sorted in each part. Ranges of tokens would be sampled first, and what makes the rows run twice."""
    return made.repartition("token").sortWithinPartitions("token", "run")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, n_distinct`` of the tokens of each document that has any."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def sizes(text: str | None) -> tuple[int, int]:
        found = token_numbers(text) if text else ()
        return len(found), len(np.unique(found))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text's tokens are held at a time, not a batch's.
            n, distinct = np.array([sizes(t.as_py()) for t in batch.column(1)], "i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(distinct, pa.int64())], names=["doc_id", "n", "n_distinct"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n long, n_distinct long").where("n > 0")
    return counted.withColumnRenamed("doc_id", doc_id)


def asked_tokens(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id, token, times``: the tokens of each query."""
    kind = queries.schema[query_id].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if t:
                    token, times = np.unique(token_numbers(t), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(token)), pa.array(token), pa.array(times.astype("i8"))], names=["query_id", "token", "times"])

    return queries.select(F.col(query_id).alias("query_id"), F.lower(F.col(text)).alias("text")).mapInArrow(make, f"query_id {kind}, token long, times long")


def rarity(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, rarity: Column, length: Column, mean_length: Column) -> Column:
    """The score of a token in a document."""
    return rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def fixed_point(score: Column) -> Column:
    x = SCALE * score
    # Rounding, which is slow, can only change the whole part of what is next to a whole number.
    exact = F.when(F.abs(x - F.rint(x)) < 1e-6, F.round(x, 9)).otherwise(x)
    return F.least(F.floor(exact), F.lit(MOST_SCORE)).cast("int")


def fixed_points(score: np.ndarray) -> np.ndarray:
    """:func:`fixed_point` of an array: what rounds to a whole number at nine digits is that."""
    x = SCALE * score
    near = np.rint(x)
    return np.minimum(np.where(near - x <= 5e-10, near, near - 1), MOST_SCORE).astype("i8")


def statistics(index: DataFrame, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``n, mean_length`` of the whole index (one row; ``lengths`` are its rows of all
    tokens, if ``index`` holds some tokens only), and ``token, df``."""
    runs = (index if lengths is None else lengths).where(F.col("token") == LENGTHS)
    total = runs.agg(F.sum("n").alias("n_docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sum"))
    total = total.select(F.col("n_docs"), (F.col("sum") / F.col("n_docs")).alias("mean_length"))
    return total, index.where(F.col("token") != LENGTHS).groupBy("token").agg(F.sum("n").alias("df"))


def scored_blocks(index: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Blocks with ``top`` (a bound of their scores) and what scores need. Only tokens of
    ``asked`` (a column ``token``) if it is given; scores are those of the whole index."""
    from riskspark.operators.tables import small

    some = index
    if asked is not None:
        some = index.join(small(asked.select("token").distinct()), "token", "left_semi")
    total, df = statistics(some, index)
    known = some.where(F.col("token") != LENGTHS).join(small(df), "token").join(F.broadcast(total))  # one row
    known = known.withColumn("rarity", rarity(F.col("df"), F.col("n_docs")))
    top = fixed_point(bm25(F.col("most_tf"), F.col("rarity"), F.col("least_length"), F.col("mean_length")))
    return known.withColumn("top", top)


def _postings(known: DataFrame) -> DataFrame:
    rows = known.select("*", F.posexplode("docs").alias("_place", "doc_id"))
    tf, length = F.get("tfs", F.col("_place")), F.get("lengths", F.col("_place"))
    score = fixed_point(bm25(tf, F.col("rarity"), length, F.col("mean_length")))
    return rows.select(*[c for c in known.columns if c not in ("docs", "tfs", "lengths")], "doc_id", score.alias("score"))


def postings(index: DataFrame, most: int | None = MOST_POSTINGS, asked: DataFrame | None = None) -> DataFrame:
    """``token, run, doc_id, score`` of the best ``most`` documents of each token (None:
    all), ties by id. Each task ranks what it has before rows are shuffled."""
    rows = _postings(scored_blocks(index, asked)).select("token", "run", "doc_id", "score")
    if most is None:
        return rows
    w = Window.partitionBy("token").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def impact_blocks(rows: DataFrame) -> DataFrame:
    """``token, run, top, postings`` of postings: best first, so that ``top`` is the first."""
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "doc_id")))
    made = rows.groupBy("token", "run").agg(F.max("score").alias("top"), best_first.alias("postings"))
    return by_token(made)


def runs_to_score(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, run, bound, place``: the runs that hold a token of a query, the most promising first."""
    bounds = asked.join(index.select("token", "run", "top"), "token").groupBy("query_id", "run").agg(F.sum(F.col("times") * F.col("top")).alias("bound"))
    w = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "run")
    return bounds.withColumn("place", F.row_number().over(w))


def _scores(asked: DataFrame, index: DataFrame, runs: DataFrame) -> DataFrame:
    met = asked.join(runs.select("query_id", "run"), "query_id").join(index.select("token", "run", "postings"), ["token", "run"])
    rows = met.select("query_id", "times", F.explode("postings").alias("p"))
    return rows.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(-F.col("times") * F.col("p.less")).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(asked: DataFrame, index: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` documents of each query, ``query_id, doc_id, score, rank`` (ties by id),
    and the runs of documents that were scored for it, ``query_id, run``.

    ``asked`` is from :func:`asked_tokens`, ``index`` from :func:`impact_blocks` (stored, as
    it is read in two rounds). A document's tokens all lie in its run, so the sum of
    its tokens' tops there bounds its score. A run is skipped only if its bound is under
    the ``k``-th best score of the runs scored first."""
    runs = runs_to_score(asked, index)
    first = runs.where(F.col("place") <= FIRST_RUNS)
    found = _best(_scores(asked, index, first), k)
    floor = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    rest = runs.where(F.col("place") > FIRST_RUNS).join(floor, "query_id").where((F.col("n") < k) | (F.col("bound") >= F.col("floor")))
    both = found.drop("rank").unionByName(_scores(asked, index, rest))
    return _best(both, k), first.select("query_id", "run").unionByName(rest.select("query_id", "run"))


class _Sent:
    """The tokens of queries, for workers that score runs: parts of some queries each, by token."""

    def __init__(self, asked: pa.Table):
        ids = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        query, token, times = ids.indices.to_numpy(), asked.column("token").to_numpy(), asked.column("times").to_numpy()
        by = np.lexsort((token, query // AT_ONCE[0]))
        query, token, times = query[by], token[by], times[by]
        self.ids, self.tokens_at_once, self.parts = ids.dictionary, AT_ONCE[1], []
        for first in range(0, len(self.ids), AT_ONCE[0]):
            mine = slice(*np.searchsorted(query // AT_ONCE[0], [first // AT_ONCE[0], first // AT_ONCE[0] + 1]))
            known, begin = np.unique(token[mine], return_index=True)
            n = min(AT_ONCE[0], len(self.ids) - first)
            self.parts.append((first, n, known, np.append(begin, mine.stop - mine.start), query[mine] - first, times[mine]))

    def best(self, run: pa.Table, k: int) -> pa.Table:
        """``query_id, doc_id, score`` of the best ``k`` documents of a run for each query."""
        run = run.take(np.argsort(run.column("token").to_numpy()))
        token, value = run.column("token").to_numpy(), run.column("value").to_numpy()
        lists = [run.column(c).combine_chunks() for c in ("docs", "counts")]
        size = lists[0].value_lengths().to_numpy()
        docs, counts = (x.flatten().to_numpy() for x in lists)
        # The least token is LENGTHS: the run's documents with their lengths, and the mean length.
        by = np.argsort(docs[: size[0]])
        ids, length = docs[: size[0]][by], counts[: size[0]][by]
        begin, place, row = np.append(0, np.cumsum(size)), np.searchsorted(ids, docs), np.repeat(np.arange(len(size)), size)
        score = fixed_points(bm25(counts, value[row], length[place], value[0]))
        found = [(np.zeros(0, "i8"),) * 3]
        for first, n, known, asked_begin, query, times in self.parts:
            at = np.searchsorted(known, token)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == token)
            total, met = np.zeros((n, len(ids))), np.zeros((n, len(ids)), bool)
            for some in np.split(hits, range(self.tokens_at_once, len(hits), self.tokens_at_once)):
                if not len(some):
                    continue
                postings = slice(begin[some[0]], begin[some[-1] + 1])
                column = np.full(some[-1] + 1 - some[0], -1)
                column[some - some[0]] = np.arange(len(some))
                c = column[row[postings] - some[0]]
                p, s, c = place[postings][c >= 0], score[postings][c >= 0], c[c >= 0]
                cell, cells = c * len(ids) + p, len(some) * len(ids)
                scores = np.bincount(cell, s, cells).reshape(len(some), -1)
                low, high = at[some[0]], at[some[-1]] + 1
                asked = slice(asked_begin[low], asked_begin[high])
                column = np.full(high - low, -1)
                column[at[some] - low] = np.arange(len(some))
                a = np.repeat(column, np.diff(asked_begin[low : high + 1]))
                weights = np.bincount((query[asked] * len(some) + a)[a >= 0], times[asked][a >= 0], n * len(some)).reshape(n, -1)
                total += weights @ scores  # whole numbers under 2**53: exact
                if len(zero := np.unique(c[s == 0])):  # a document that scores nothing is found all the same
                    held = np.bincount(cell, minlength=cells).reshape(len(some), -1)
                    met |= weights[:, zero] @ held[zero] > 0
            total[(total == 0) & ~met] = -1
            best = np.argsort(-total, axis=1, kind="stable")[:, :k]
            q, rank = np.nonzero(np.take_along_axis(total, best, 1) >= 0)
            doc = best[q, rank]
            found.append((q + first, ids[doc], total[q, doc].astype("i8")))
        q, doc, total = map(np.concatenate, zip(*found, strict=True))
        return pa.Table.from_arrays([self.ids.take(pa.array(q)), pa.array(doc), pa.array(total)], names=["query_id", "doc_id", "score"])


def search_all(asked: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` documents of each query by all postings of its tokens, ``query_id,
    doc_id, score, rank`` (ties by id).

    ``asked`` is from :func:`asked_tokens` (stored), ``index`` from :func:`blocks` (stored),
    with unlike ids. Only blocks of the queries' tokens are shuffled, dealt by their runs;
    a run multiplies the times of tokens in queries with the scores of tokens in its
    documents, and gives its best ``k`` for each query. Queries with more than
    ``SENT_TOKENS`` tokens in all are joined with the postings instead (:func:`search`)."""
    from riskspark.operators.tables import small

    if asked.limit(SENT_TOKENS + 1).count() > SENT_TOKENS:
        return search(asked, stored(impact_blocks(postings(index, None, asked))), k)[0]
    sent = asked.sparkSession.sparkContext.broadcast(_Sent(asked.toArrow()))
    total, df = statistics(index.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi"), index)
    values = df.join(F.broadcast(total)).select("token", rarity(F.col("df"), F.col("n_docs")).alias("value"))
    values = values.unionByName(total.select(F.lit(LENGTHS).cast("long").alias("token"), F.col("mean_length").alias("value")))
    counts = F.when(F.col("token") == LENGTHS, F.col("lengths")).otherwise(F.col("tfs")).alias("counts")
    met = index.join(small(stored(values)), "token").select("run", "token", "value", "docs", counts)
    kind = asked.schema["query_id"].dataType.simpleString()

    def best(run: pa.Table) -> pa.Table:
        return sent.value.best(run, k)

    return _best(met.groupBy("run").applyInArrow(best, f"query_id {kind}, doc_id long, score long"), k)


class Segments:
    """An index that grows: immutable segments of blocks, merged when they are read.

    Each insert writes one segment, a run's blocks side by side (their documents are the
    same few ids, which Parquet numbers), and then a new list of segments, which takes
    effect as a whole; readers see the last complete list. Document frequencies and lengths are
    sums over the segments, so that scores are those of an index built at once.
    :meth:`compacted` writes all segments as one, :meth:`cleaned` deletes what no list
    names any more. There is one writer at a time. ``most_documents`` is how many
    documents the index takes (feedback keeps 2000); of an insert that
    would pass it, those with the smallest ids are taken."""

    def __init__(self, spark: SparkSession, path: str, most_documents: int | None = None):
        self.spark, self.path, self.most_documents, self.lists = spark, path.rstrip("/"), most_documents, Lists(spark, path)

    def segments(self) -> list[str]:
        return self.lists.held()

    def _written(self, made: DataFrame) -> str:
        name = f"s{self.lists.version() + 1:08}"
        made.write.mode("overwrite").parquet(f"{self.path}/segments/{name}")
        return name

    def blocks(self) -> DataFrame:
        """The blocks of all segments; runs of different segments are apart."""
        parts = [self.spark.read.schema(BLOCK).parquet(f"{self.path}/segments/{s}").withColumn("run", F.struct(F.lit(int(s[1:])).alias("s"), "run")) for s in self.segments()]
        if not parts:
            return self.spark.createDataFrame([], BLOCK)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("run", F.xxhash64("run.s", "run.run"))

    def n_documents(self) -> int:
        return self.blocks().where(F.col("token") == LENGTHS).agg(F.sum("n")).first()[0] or 0

    def inserted(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Segments:
        if self.most_documents is not None:
            room = max(0, self.most_documents - self.n_documents())
            docs = docs.where(F.col(doc_id).isNotNull()).orderBy(doc_id).limit(room)
        self.lists.publish([*self.segments(), self._written(blocks(docs, doc_id, text))])
        return self

    def compacted(self) -> Segments:
        if len(self.segments()) > 1:
            self.lists.publish([self._written(self.blocks())])
        return self

    def emptied(self) -> Segments:
        self.lists.publish([])
        return self

    def cleaned(self) -> Segments:
        """Delete segments and lists that are no longer used."""
        held = set(self.segments())
        for s in names(self.spark, f"{self.path}/segments"):
            if s not in held:
                delete(self.spark, f"{self.path}/segments/{s}")
        self.lists.forget_old()
        return self
