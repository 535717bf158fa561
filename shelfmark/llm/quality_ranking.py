"""Quality classifier: a Bradley-Terry model learned from pairs of a better and a worse document.

The probability that one document is better than another is the logistic function of the difference of their scores, and a score
is linear in features of the text. Pairs join each sampled document of the lower label with documents of the higher one;
Newton's method fits the logistic loss on feature differences with an L2 penalty. The threshold is a quantile of the training scores,
the smallest of those that separate the training labels best; it is subtracted, so that the logistic of a score is 0.5 at the threshold.

The fit uses a bounded sample of labelled rows (``SAMPLE`` at most, by hash of the id, so it is the same in every run), which is all that reaches
the driver. Scoring is a projection: built-in functions over every whole text.

Defined cases: a null text is empty and is scored; labels of documents that are not there, null labels and conflicting repeated labels
beyond the first (smallest) are left out; of a labelled id with several texts the smallest is learned from; with one label only, or no labelled row, all weights are 0 and every score is 0.5; repeated documents stay repeated; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_fold, table
from .quality_rules import counted

SAMPLE, PAIRS_PER_DOC, PENALTY, SEED = 20_000, 8, 1.0, 17


def features(d: DataFrame) -> list[Column]:
    """Of a ``counted`` frame: shares of characters and words, and their logarithms, so that small and large shares both tell."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    rest = F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digit") - F.col("n_symbols")
    shares = [
        F.col("n_upper") / chars, F.col("n_digit") / chars, F.col("n_symbols") / chars, rest / chars, F.col("n_lower") / chars,
        F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_distinct") / words, F.size("few") / words,
    ]
    logs = [F.log(s + 0.003) for s in shares]
    size = F.log1p(F.col("n_words").cast("double"))
    return [*shares, *logs, size, size * size, chars / words, F.log(chars / words), F.log1p(F.col("n_lines").cast("double")) - size]


@dataclass
class Ranking:
    weights: list[float]
    threshold: float

    def score(self, d: DataFrame) -> Column:
        """Logistic of the score above the threshold."""
        raw = F.lit(-self.threshold)
        for w, x in zip(self.weights, features(d), strict=True):
            raw = raw + x * F.lit(float(w))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS_PER_DOC, penalty: float = PENALTY, seed: int = SEED) -> Ranking:
    """Weights and threshold from features and labels (0 or 1)."""
    worse, better = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    if not len(worse) or not len(better):
        return Ranking([0.0] * x.shape[1], 0.0)
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    scale[scale < 1e-9] = np.inf  # a constant tells nothing
    z = x / scale
    n = pairs * max(len(worse), len(better))
    diff = z[rng.choice(better, n)] - z[rng.choice(worse, n)]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) + penalty * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff + (penalty + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # Candidates are quantiles of the scores; the best one has the highest mean of both labels' hit rates.
    cuts = np.quantile(raw, np.linspace(0, 1, 1001))
    low, high = np.sort(raw[worse]), np.sort(raw[better])
    balance = np.searchsorted(low, cuts, "left") / len(low) + 1 - np.searchsorted(high, cuts, "left") / len(high)
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    return Ranking(list(w / scale), float(cuts[best[0]]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ranking:
    """Fit on the labelled documents, or on about ``sample`` of them where there are more."""
    y = labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("_y")).where("_key IS NOT NULL AND _y IN (0, 1)")
    y = y.groupBy("_key").agg(F.min("_y").alias("_y"))
    n = y.count()
    part = F.pmod(F.xxhash64(F.lit(SEED), "_key"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(n, 1))))
    some = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).join(y.where(part), "_key")
    # One text an id, the smallest, so that the sample's bound holds however often rows repeat.
    some = some.groupBy("_key", "_y").agg(F.min("_text").alias("_text"))
    d = counted(some, ["_y"], "_text")
    rows = d.select(F.col("doc._y").alias("y"), F.array(*features(d)).alias("x")).toPandas()
    if not len(rows):
        return Ranking([0.0] * len(features(d)), 0.0)
    return fit(np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy())


def rank(docs: DataFrame, model: Ranking, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document under ``doc``, with ``score`` and ``predicted``."""
    d = counted(docs, keep, text)
    d = d.select("doc", model.score(d).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learned_here(spark: SparkSession, sf_dir: str) -> Ranking:
    """From ``labels.quality`` of the rows whose crc32 of the id as text is not 1 modulo 3."""
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 3) != 1)
    return train(table(spark, sf_dir, "documents"), labels)


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = rank(docs, learned_here(spark, sf_dir), ["doc_id"])
    return out.select("doc.doc_id", (id_fold("doc.doc_id", 3) == 1).alias("held_out"), "score", "predicted")
