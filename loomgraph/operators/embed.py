"""Chunks of nodes and their embeddings; the model is passed in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.functions import text as T

DIMENSION, MAX_LENGTH = 384, 512


def hashed_model(dimension: int = DIMENSION) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in without a model file: signed word hashes. Deterministic, for tests and dry runs."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dimension] += 1 if h >> 31 else -1
            return out

        return embed

    return load


def onnx_model(path: str, tokenizer: Callable[[str], list[int]], pooling: str = "mean", max_length: int = MAX_LENGTH, dimension: int = DIMENSION) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model file run by ONNX Runtime, one session per worker; ``pooling`` is ``mean`` (masked) or ``cls``."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = {x.name for x in session.get_inputs()}
        outputs = [o.name for o in session.get_outputs()]
        output = "last_hidden_state" if "last_hidden_state" in outputs else outputs[0]

        def embed(texts: list[str]) -> np.ndarray:
            ids = np.zeros((len(texts), max_length), np.int64)
            mask = np.zeros_like(ids)
            for i, t in enumerate(texts):
                x = tokenizer(t)[:max_length]
                ids[i, : len(x)], mask[i, : len(x)] = x, 1
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            state = session.run([output], {k: v for k, v in feed.items() if k in names})[0]
            if pooling == "cls":
                return state[:, 0, :dimension]
            return (state * mask[:, :, None]).sum(axis=1)[:, :dimension] / np.maximum(1, mask.sum(axis=1))[:, None]

        return embed

    return load


def chunk_nodes(nodes: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(node_id, chunk_index, start_word, end_word, content_hash, text)."""
    full = T.embed_text(F.col("label"), F.col("name"), F.col("content"))
    rows = nodes.select(F.col("id").alias("node_id"), F.explode(T.chunks(full, size, overlap)).alias("c")).select("node_id", "c.*")
    return rows.withColumn("content_hash", hashing.hash_content(F.col("text")))


def embed_chunks(chunks: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """Chunks with ``embedding``, of unit length; the model is loaded once per worker task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for texts in batches:
            made: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                x = np.asarray(embed(texts.iloc[i : i + batch].tolist()), np.float32)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                made += list(x / np.where(norm > 0, norm, 1))
            yield pd.Series(made)

    return chunks.withColumn("embedding", run("text"))
