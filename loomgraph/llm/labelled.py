"""What the two classifiers share: labelled samples, folds, and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows, those of smallest hash, fit a model; scoring reads all documents.
SAMPLE_ROWS = 6000
CACHE = 400_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…–—"


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Labels that are null or disagree for one doc_id are left out; of rows that
    share a doc_id the least text counts. The sample is at most ``rows`` ids, so
    that side of the join is broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y1")).filter("y = y1")
    chosen = known.select(F.col("doc_id").alias("_id"), "y", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # rows that repeat under one doc_id give one: the text that comes first, so that the sample is bounded by rows
    return found.groupBy("_h", "_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("_h", "_id", "text", "y")


class Words:
    """Whitespace tokens to 32-bit hashes of their lower-case form without punctuation at the ends; a bounded cache."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = [seen.get(t) for t in tokens]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    t = tokens[i]
                    word = t.lower().strip(_EDGE) or t
                    out[i] = seen[t] = zlib.crc32(word.encode("utf-8", "replace"))
        return np.array(out, dtype=np.uint64)


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 32-bit hash of two hashes in order."""
    return (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt * 0x165667B19E3779F9 % (1 << 64))) >> np.uint64(32)


def release() -> None:
    """Hand back what earlier stages left in this Python worker: the words the token encoder remembers, and freed memory that the allocators keep."""
    if "loomgraph.llm.token_ids" in sys.modules:
        sys.modules["loomgraph.llm.token_ids"].encoder_for.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work):
    """A function from batches to batches that leaves no freed memory in the Python worker before or after its task."""

    @functools.wraps(work)
    def tidied(batches):
        release()
        yield from work(batches)
        release()

    return tidied


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0))))
