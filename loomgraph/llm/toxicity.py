"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of 32-bit hashes of words, pairs of neighbours and
pairs with one or two words between. FTRL-proximal gives each coordinate its own
rate, and its L1 term leaves exact zeros, so the model is a short sorted array
of hashes with weights. That array is broadcast (its size is bounded by the
sample); documents are scored where they lie, with no shuffle.

The model is fitted in one task on at most ``ROWS`` labelled rows outside
the held-out fold. Defined results: null and empty texts score the bias alone;
every input row gets a row, repeated ones too; without usable labels the score
is 0.5 for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.labelled import Words, held_out, labelled_sample, pair, release, sigmoid

ALPHA, BETA, L1, L2, EPOCHS, LEAST_DOCS = 3.0, 1.0, 14.0, 0.1, 8, 3
#: Errors on toxic rows count so many times.
TOXIC_WEIGHT = 4.0
#: At most so many labelled rows fit the model.
ROWS = 10_000


def features(text: str, words: Words) -> np.ndarray:
    """The distinct feature hashes of a text."""
    ids = words(text.split())
    parts = [ids, pair(ids[:-1], ids[1:], 1), pair(ids[:-2], ids[2:], 2), pair(ids[:-3], ids[3:], 3)]
    return np.unique(np.concatenate(parts).astype(np.uint32))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, dims: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights for coordinates below ``dims`` and a bias, which is not regularised."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    order = np.random.default_rng(7)
    l1 = np.full(dims + 1, L1)
    l1[dims] = 0.0

    def weight(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= l1[i], 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = weight(i)
            g = (sigmoid(w.sum()) - labels[k]) * (TOXIC_WEIGHT if labels[k] else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(dims + 1))
    return w[:dims], float(w[dims])


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    words = Words()
    sample = sample.sort_values(["_h", "_id"])
    hashed = [features(t, words) for t in sample["text"]]
    every, counts = np.unique(np.concatenate(hashed), return_counts=True)
    every = every[counts >= min(LEAST_DOCS, max(1, len(hashed) // 20))]
    rows = []
    for h in hashed:
        at = np.searchsorted(every, h)
        at = at[(at < len(every))]
        hit = np.isin(h, every, assume_unique=True)
        rows.append(np.append(np.searchsorted(every, h[hit]), len(every)))
    w, bias = ftrl(rows, sample["y"].to_numpy(float), len(every))
    keep = np.flatnonzero(w)
    return pd.DataFrame({"feature": np.append(every[keep].astype(np.int64), -1), "weight": np.append(w[keep], bias)})


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights, and the bias."""
    model = labelled_sample(docs, labels, "toxic", rows).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "feature long, weight double").toPandas()
    model = model.sort_values("feature")
    bias = model.loc[model["feature"] < 0, "weight"]
    model = model[model["feature"] >= 0]
    return model["feature"].to_numpy(np.uint32), model["weight"].to_numpy(float), float(bias.iloc[0]) if len(bias) else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        keys, weights, bias = shared.value
        words, near = Words(), np.zeros(1 << 16, bool)
        near[keys >> np.uint32(16)] = True
        for batch in batches:
            scores = []
            for text in batch:
                h = features(text, words)
                h = h[near[h >> np.uint32(16)]]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h if len(keys) else np.zeros(0, bool)
                scores.append(sigmoid(bias + weights[at[hit]].sum()))
            yield pd.Series(scores, dtype=float)

    rows = docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
