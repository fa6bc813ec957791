"""Joins by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.tables import small
from riskspark.sources.scratch import stored


#: Pairs of a block that are compared at most before it is split, and how often that is done.
HOT_PAIRS, DEEPEST = 1_000_000, 8
#: Stands where a part was cut out, so that what is left of it and what is right of it stay apart.
CUT = "\uffff"


def _blocks(key: Column, parent: Column, most: int, probe: bool) -> Column:
    """Blocks of a word, ``block, at, size``: a hash, and where its part lies. A word is cut
    in ``most + 1`` even parts; a word within ``most`` edits holds one of the parts
    unchanged, moved by at most ``most`` places. Indexed words give their parts with
    their length, probes the substrings that may match one of them, for each length that
    is near enough. Blocks of different parents are apart."""
    parts = F.sequence(F.lit(0), F.lit(most))

    def block(n: Column, i: Column, a: Column, b: Column, shift: Column | None = None) -> Column:
        at = (a if shift is None else a + shift).cast("int")
        size = (b - a).cast("int")
        part = F.substring(key, at + 1, size)
        return F.struct(F.xxhash64(parent, n.cast("int"), i.cast("int"), part).alias("block"), at.alias("at"), size.alias("size"))

    def cut(n: Column, i: Column) -> tuple[Column, Column]:
        return F.floor(i * n / (most + 1)), F.floor((i + 1) * n / (most + 1))

    if not probe:
        n = F.length(key)
        return F.transform(parts, lambda i: block(n, i, *cut(n, i)))

    def at(n: Column) -> Column:
        def of(i: Column) -> Column:
            a, b = cut(n, i)
            places = F.filter(F.sequence(F.lit(-most), F.lit(most)), lambda s: (a + s >= 0) & (b + s <= F.length(key)))
            return F.transform(places, lambda s: block(n, i, a, b, s))

        return F.flatten(F.transform(parts, of))

    lengths = F.sequence(F.greatest(F.length(key) - most, F.lit(0)), F.length(key) + most)
    return F.array_distinct(F.flatten(F.transform(lengths, at)))


def _shared_by_many(probes: DataFrame, held: DataFrame) -> DataFrame:
    """``block`` of more than ``HOT_PAIRS`` pairs, with parts of two letters or more."""
    q = probes.where("size > 1").groupBy("block").agg(F.count(F.lit(1)).cast("double").alias("q"))
    w = held.where("size > 1").groupBy("block").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return q.join(w, "block").where(F.col("q") * F.col("w") > HOT_PAIRS).select("block")


def edit_join(queries: DataFrame, words: DataFrame, query: str, word: str, most: int = 3) -> DataFrame:
    """``query, word, distance`` of every pair within ``most`` edits (exact).

    Distinct keys are met by their blocks, so only words that share a part are compared;
    the words are broadcast if there are few. A block that very many share is not
    paired out: what is left of its words beside the shared part must be within ``most``
    edits too, so it is cut into parts again, and so on. (Blocks of parts of one letter
    or none are paired out: next to nothing else is left of their words, so that most pairs are
    near.) Null keys match nothing."""
    near = F.expr(f"levenshtein(query, word, {most})").alias("distance")

    def blocked(df: DataFrame, probe: bool) -> DataFrame:
        rows = df.withColumn("b", F.explode(_blocks(F.col("rest"), F.col("parent"), most, probe)))
        return rows.select(df.columns[0], "rest", "b.block", "b.at", "b.size")

    def left(rows: DataFrame, hot: DataFrame) -> DataFrame:
        rest = F.concat(F.substring("rest", F.lit(1), F.col("at")), F.lit(CUT), F.substring("rest", F.col("at") + F.col("size") + 1, F.length("rest")))
        met = rows.join(small(hot), "block", "left_semi")
        return met.select(rows.columns[0], rest.alias("rest"), F.col("block").alias("parent")).distinct()

    q = queries.select(F.col(query).alias("query")).dropna().distinct().withColumns({"rest": F.col("query"), "parent": F.lit(0).cast("long")})
    w = words.select(F.col(word).alias("word")).dropna().distinct().withColumns({"rest": F.col("word"), "parent": F.lit(0).cast("long")})
    found: DataFrame | None = None
    deepest = DEEPEST if q.count() * w.count() > HOT_PAIRS else 0
    for depth in range(deepest + 1):
        qb, wb = blocked(q, True), blocked(w, False)
        if depth:
            qb, wb = stored(qb), stored(wb)
        hot = stored(_shared_by_many(qb, wb)) if depth < deepest else None
        more = hot is not None and not hot.isEmpty()
        cold = wb.join(small(hot), "block", "left_anti") if more else wb
        pairs = qb.select("query", "block").join(small(cold.select("word", "block").distinct()), "block").select("query", "word", near).where("distance >= 0")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            break
        q, w = left(qb, hot), left(wb, hot)
    return found.distinct()


def closest(queries: DataFrame, words: DataFrame, query: str, word: str, most: int = 3) -> DataFrame:
    """The nearest word of each query that has one within ``most`` edits; ties by word."""
    pairs = edit_join(queries, words, query, word, most)
    best = F.min(F.struct("distance", "word")).alias("b")
    return pairs.groupBy("query").agg(best).select("query", F.col("b.word").alias("word"), F.col("b.distance").alias("distance"))


def has_near(queries: DataFrame, words: DataFrame, query: str, word: str, most: int = 3) -> DataFrame:
    """The distinct queries with a word within ``most`` edits."""
    return edit_join(queries, words, query, word, most).select("query").distinct()


def similarity(distance: Column, query: Column, word: Column) -> Column:
    """``1 - distance / longer length`` in 32-bit arithmetic; no match is 0."""
    share = (distance.cast("float") / F.greatest(F.length(query), F.length(word)).cast("float")).cast("float")
    return F.coalesce((F.lit(1).cast("float") - share).cast("float"), F.lit(0).cast("float"))
