"""Quality classifier: a factorisation machine of hashed words, structure statistics and metadata.

The score of features x is ``b + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).x^2)``:
all pairwise interactions in time linear in the features. Words are hashed to
``2^16`` slots and enter with weight 1/sqrt(distinct words); statistics of
characters, words and lines, and the document's length, are cut into steps,
each a slot of its own.

The model is fitted in one task on at most ``SAMPLE_ROWS`` labelled rows outside
the held-out fold; its size is fixed, so it is broadcast. Scoring takes one scan
and no shuffle. Defined results: null and empty texts are scored by their
structure; every input row gets a row, repeated ones too; without usable labels
the score is 0.5 for all; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.labelled import SAMPLE_ROWS, Words, held_out, labelled_sample, sigmoid, tidy

WORD_SLOTS = 1 << 16
STEPS = 12
RANK, RATE, DECAY, EPOCHS, LEAST_STEPS = 4, 0.08, 1e-4, 6, 12_000
THRESHOLD = 0.3
STATS = (
    "letters", "upper", "digits", "space", "marks", "bars", "bangs", "word_length", "marked_words", "upper_words",
    "distinct_words", "commonest_word", "repeated_neighbours", "distinct_lines", "line_length", "length",
)
SLOTS = WORD_SLOTS + len(STATS) * STEPS


def structure(text: str, tokens: list[str]) -> list[float]:
    """Statistics between 0 and 1, in the order of ``STATS``."""
    n, t = max(1, len(text)), max(1, len(tokens))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letters = ((codes | 32) - 97 < 26).sum()
    letters = int(ascii_letters) + int((codes >= 192).sum())
    upper = int((codes - 65 < 26).sum())
    digits = int((codes - 48 < 10).sum())
    space = int(((codes == 32) | (codes - 9 < 5)).sum())
    bars, bangs = text.count("|"), text.count("!")
    counts = Counter(tokens)
    ends = sum(c for w, c in counts.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    lines = [x for x in text.split("\n") if x]
    return [
        letters / n, upper / n, digits / n, space / n, max(0, n - letters - digits - space) / n, min(1, bars / t), min(1, bangs / t), min(1, (n - space) / t / 20), ends / t, caps / t,
        min(1, len(counts) / t ** 0.75), max(counts.values(), default=0) / t, same / t, len(set(lines)) / max(1, len(lines)), min(1, n / max(1, len(lines)) / 1000), min(1, np.log1p(len(text)) / 14),
    ]


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their values."""
    tokens = text.split()
    slots = np.unique(words(tokens) & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
    values = np.full(len(slots), 1.0 / np.sqrt(max(1, len(slots))))
    stats = np.sqrt(np.array(structure(text, tokens)))
    steps = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1)
    return np.concatenate([slots, WORD_SLOTS + np.arange(len(STATS)) * STEPS + steps]), np.concatenate([values, np.ones(len(STATS)) * 0.5])


def machine(b: float, w: np.ndarray, v: np.ndarray, slots: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The score before the sigmoid, and V.x, by the sum-of-squares identity."""
    vx = v[slots] * x[:, None]
    s = vx.sum(axis=0)
    return b + float(w[slots] @ x) + 0.5 * float((s * s).sum() - (vx * vx).sum()), s


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss, classes weighed alike."""
    dice = np.random.default_rng(11)
    w, v = np.zeros(SLOTS), dice.normal(0, 0.02, (SLOTS, RANK))
    gw, gv = np.full(SLOTS, 1e-2), np.full((SLOTS, RANK), 1e-2)
    b, gb = 0.0, 1e-2
    share = min(max(labels.mean(), 0.02), 0.98)
    for _ in range(max(epochs, min(40, LEAST_STEPS // max(1, len(rows))))):
        for k in dice.permutation(len(rows)):
            slots, x = rows[k]
            out, s = machine(b, w, v, slots, x)
            g = (sigmoid(out) - labels[k]) * (0.5 / share if labels[k] else 0.5 / (1 - share))
            dw = g * x + DECAY * w[slots]
            dv = g * (x[:, None] * s - v[slots] * (x * x)[:, None]) + DECAY * v[slots]
            gb, gw[slots], gv[slots] = gb + g * g, gw[slots] + dw * dw, gv[slots] + dv * dv
            b -= RATE * g / np.sqrt(gb)
            w[slots] -= RATE * dw / np.sqrt(gw[slots])
            v[slots] -= RATE * dv / np.sqrt(gv[slots])
    return b, w, v


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    words = Words()
    sample = sample.sort_values(["_h", "_id"])
    b, w, v = train([features(t, words) for t in sample["text"]], sample["y"].to_numpy(float))
    packed = io.BytesIO()
    np.savez_compressed(packed, b=b, w=w.astype(np.float32), v=v.astype(np.float32))
    return pd.DataFrame({"model": [packed.getvalue()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> bytes | None:
    """The fitted model, or None without labels; of fixed size."""
    made = labelled_sample(docs, labels, "quality", rows).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "model binary").collect()
    return bytes(made[0][0]) if made else None


def with_score(docs: DataFrame, model: bytes | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a double ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    loaded: dict[str, tuple] = {}

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        if shared.value is not None and not loaded:
            m = np.load(io.BytesIO(shared.value))
            loaded["m"] = (float(m["b"]), m["w"].astype(float), m["v"].astype(float))
        for batch in batches:
            if not loaded:
                yield pd.Series([0.5] * len(batch))
            else:
                yield pd.Series([sigmoid(machine(*loaded["m"], *features(t, words))[0]) for t in batch], dtype=float)

    return docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, model: bytes | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
