"""Votes of the nearest stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.features import COMMON

# Voters, newest stored vectors that are compared, and shares for a level.
VOTERS, STORED, DANGEROUS, SUSPICIOUS = 10, 200, 0.7, 0.4


def nearest(queries: DataFrame, stored: DataFrame, k: int = VOTERS, most: int = STORED) -> DataFrame:
    """``query_id, id, similarity, label, rank``: each ``(query_id, vector)`` with its
    ``k`` most similar of the newest ``most`` stored ``(id, vector, label)``.

    Similarities are cosines to six digits, ties go to the smaller id; vectors of unlike
    sizes are compared in their first dimensions, and a zero vector is 0 to all. Null
    vectors, of either side, find nothing. The stored side is a stated, bounded set
    (``most`` rows), which goes to every task; a batch of queries meets it in one product
    of matrices, and nothing is shuffled."""
    found = stored.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    newest = found.orderBy(F.col("id").desc()).limit(most).select("id", "label", "vector").collect()
    newest = sorted(((r[0], r[1], [float(x) for x in r[2]]) for r in newest), key=lambda r: r[0])
    types = {f.name: f.dataType for f in [*queries.schema, *stored.schema]}
    kinds = {"query_id": types["query_id"], "id": types["id"], "similarity": T.DoubleType(), "label": types["label"], "rank": T.IntegerType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[int, list[int]] = {}
        for j, (_, _, v) in enumerate(newest):
            sizes.setdefault(len(v), []).append(j)
        for batch in batches:
            for n, rows in batch.groupby(batch["vector"].map(len)):
                q = np.array(rows["vector"].tolist(), dtype=float).reshape(len(rows), n)
                likeness = np.empty((len(rows), len(newest)))
                for m, at in sizes.items():
                    both = n if n == m else min(n, m, COMMON)
                    a, b = q[:, :both], np.array([newest[j][2][:both] for j in at]).reshape(len(at), both)
                    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
                    likeness[:, at] = np.where(norms == 0, 0.0, a @ b.T / np.where(norms == 0, 1.0, norms))
                likeness = np.round(likeness, 6)
                best = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
                picked = [newest[j] for j in best.ravel()]
                yield pd.DataFrame({
                    "query_id": np.repeat(rows["query_id"].to_numpy(), best.shape[1]),
                    "id": [p[0] for p in picked],
                    "similarity": np.take_along_axis(likeness, best, 1).ravel(),
                    "label": [p[1] for p in picked],
                    "rank": np.tile(np.arange(1, best.shape[1] + 1), len(rows)),
                })

    return queries.where(F.col("vector").isNotNull()).select("query_id", "vector").mapInPandas(meet, schema)


def vote(found: DataFrame) -> DataFrame:
    """``query_id, ratio, level`` by the share of label 1."""
    r = found.groupBy("query_id").agg(F.avg((F.col("label") == 1).cast("double")).alias("ratio"))
    level = F.when(F.col("ratio") >= DANGEROUS, "DANGEROUS").when(F.col("ratio") >= SUSPICIOUS, "SUSPICIOUS").otherwise("SAFE")
    return r.withColumn("level", level)
