"""Language identification: averaged hashed subword embeddings with a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import own_worker, plain_text, whole_row

#: Hash buckets (a power of two) and numbers of an embedding.
BUCKETS, DIMENSIONS = 1 << 16, 16
#: Lengths of the subwords, word borders included.
SUBWORDS = (2, 3, 4)
#: Labelled documents of a language that are used in training, and in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 20_000
#: Letters and borders of a training example, at most.
EXAMPLE = 400
#: Code points that are turned into subwords at once.
BLOCK = 1 << 20
#: Share of calibration documents with a right answer that may be rejected.
REJECT_RIGHT = 0.001
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def coded(text: str) -> np.ndarray:
    """Lower-case letters as code points; runs of anything else are one 0, also at both ends."""
    c = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "replace"), "<u4")
    c = np.where(letters()[c], c, 0).astype("u4")
    return c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]


def subwords(c: np.ndarray) -> np.ndarray:
    """Bucket of the subwords that start at each place (a row for each length);
    ``BUCKETS`` where a subword would reach over a border."""
    out = np.full((len(SUBWORDS), len(c)), BUCKETS, "i4")
    inner = c != 0
    for row, n in enumerate(SUBWORDS):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 0x811C9DC5 + n, "u4")
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = inner[:m] | inner[n - 1 :]
        for k in range(1, n - 1):
            ok &= inner[k : k + m]
        out[row, :m] = np.where(ok, h & np.uint32(BUCKETS - 1), BUCKETS)
    return out


@dataclass
class Model:
    """``weights`` has a row for each bucket: the softmax's inputs that a subword adds
    (embedding times output layer). Means of these rows are a document's inputs."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Softmax inputs of each text, and whether it has a letter."""
        table = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), "f4")])
        out = np.zeros((len(texts), len(self.languages)))
        some = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            c = coded(text)
            total, n = np.zeros(len(self.languages)), 0
            for at in range(0, len(c), BLOCK):
                # Blocks overlap so that each subword starts in one block only.
                s = subwords(c[at : at + BLOCK + max(SUBWORDS) - 1])[:, :BLOCK].ravel()
                s = s[s < BUCKETS]
                total += np.array([np.add.reduce(w) for w in table[s].T]) if len(s) else 0
                n += len(s)
            some[i] = n > 0
            out[i] = total / max(n, 1) + self.bias
        return out, some

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        z, some = self.inputs(texts)
        return softmax(z / self.temperature), some


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 25.0, batch: int = 32, seed: int = 7) -> Model:
    """Fit on four fifths of the documents, cut into examples so that short texts are
    learnt too; fit the temperature and the rejection threshold on whole documents of
    the last fifth."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    held = rng.permutation(len(texts)) < len(texts) // 5
    parts, of = [], []
    for k in np.flatnonzero(~held):
        c = coded(texts[k])
        for at in range(0, len(c) - 1, EXAMPLE):
            s = subwords(c[at : at + EXAMPLE]).ravel()
            s = s[s < BUCKETS]
            if len(s):
                parts.append(s)
                of.append(y[k])
    of = np.array(of, int)
    share = np.bincount(of, minlength=len(languages)).clip(1)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    b = np.zeros(len(languages))
    steps = max(1, epochs * -(-len(parts) // batch))
    for step in range(steps if parts else 0):
        pick = rng.integers(0, len(parts), batch)
        ids, n = np.concatenate([parts[k] for k in pick]), np.array([len(parts[k]) for k in pick])
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        mean = np.add.reduceat(e[ids], start) / n[:, None]
        weight = (len(of) / len(languages) / share[of[pick]])[:, None]
        g = softmax(mean @ w + b)
        g[np.arange(batch), of[pick]] -= 1
        g *= weight / batch
        lr = rate * (1 - step / steps)
        back = np.repeat((g @ w.T) / n[:, None], n, 0)
        found, inverse = np.unique(ids, return_inverse=True)
        change = np.stack([np.bincount(inverse, back[:, d], len(found)) for d in range(DIMENSIONS)], 1)
        w -= 0.05 * lr * mean.T @ g
        b -= 0.05 * lr * g.sum(0)
        e[found] -= lr * change * 8
    model = Model(languages, (e @ w).astype("f4"), b)
    whole = [texts[k] for k in np.flatnonzero(held)]
    z, some = model.inputs(whole)
    z, truth = z[some], y[held][some]
    if len(z):
        rows = np.arange(len(z))
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(softmax(z / t)[rows, truth].clip(1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.argmax(1) == truth
        if right.any():
            model.reject_below = min(0.9, float(np.quantile(p.max(1)[right], REJECT_RIGHT)) * 0.9)
    return model


def fold(id_col: str | Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo the number of folds (a null id as empty text)."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(folds))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_fold: int = 2) -> Model:
    """Train on a sample of the labelled documents outside the held-out fold.

    About ``SAMPLE_PER_LANGUAGE`` documents of a language, or an equal part of ``SAMPLE``
    where there are very many, picked by a hash of the id. Nothing else of the table reaches the driver.
    """
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id") != held_fold))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(SAMPLE).collect()}
    if not counts:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), "f4"), np.zeros(1))
    # Every language has the same part of the sample, however many there are.
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, each / n)])
    dealt = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    rows = known.where(dealt < share[F.col("lang")]).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["lang"], r["text"]))  # tasks end in any order
    if not rows:
        rows = known.limit(SAMPLE_PER_LANGUAGE).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` besides ``lang_pred``, ``score`` and ``rejected``, which
    replace columns of these names.

    Every whole text is judged by the text alone. Null texts and texts without a
    letter are ``und`` with score 0 and rejected; others get the likeliest language
    and its calibrated probability, and are rejected where that is under the
    threshold fitted on held-back documents. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        own_worker("langid")
        m = sent.value
        p, some = m.probabilities(texts.tolist())
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        names = np.array(m.languages, object)[best]
        return pd.DataFrame(
            {"lang_pred": np.where(some, names, UNKNOWN), "score": score, "rejected": ~some | (score < m.reject_below)}
        )

    mine = ("lang_pred", "score", "rejected")
    whole = docs.select(whole_row(docs, mine), plain_text(f"`{text_col}`").alias("text"))
    return whole.select("_all", judged("text").alias("judged")).select(
        *[F.col(f"_all.`{c}`").alias(c) for c in docs.columns if c not in mine], *[F.col(f"judged.{c}") for c in mine]
    )
