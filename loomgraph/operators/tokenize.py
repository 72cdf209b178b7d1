"""Byte-pair encoding from a tokenizer file: plain and byte-level modes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_symbols() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Bpe:
    """Merges by rank, the leftmost first among equals; words are remembered."""

    def __init__(self, vocab: dict[str, int], merges: list, unk: int = 0, byte_level: bool = False, max_length: int = 512, special: dict[str, int | None] | None = None, pad: int = 0) -> None:
        self.vocab, self.unk, self.byte_level, self.max_length, self.pad = vocab, unk, byte_level, max_length, pad
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {p: i for i, p in enumerate(pairs) if len(p) == 2}
        self.special = special or {}
        self.symbols = byte_symbols() if byte_level else None
        self.known: dict[str, tuple[str, ...]] = {}

    @classmethod
    def load(cls, path: str, byte_level: bool = False) -> Bpe:
        """From a tokenizer file: vocabulary, merges, added tokens, truncation length, and the tokens that open and close a text."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, vocab = data["model"], dict(data["model"]["vocab"])
        vocab |= {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        special: dict[str, int | None] = {}
        post = data.get("post_processor")
        if byte_level and post is None:
            special = {"cls": next((vocab[t] for t in ("<s>", "[CLS]") if t in vocab), None), "sep": next((vocab[t] for t in ("</s>", "[SEP]") if t in vocab), None)}
        elif byte_level and post.get("type") in ("RobertaProcessing", "BertProcessing"):
            special = {k: post[k][1] for k in ("cls", "sep")}
        unk = vocab.get(model.get("unk_token") or "[UNK]", 3 if byte_level else 0)
        length = (data.get("truncation") or {}).get("max_length", 512)
        return cls(vocab, model.get("merges") or [], unk, byte_level, length, special, 1 if byte_level else 0)

    def word(self, word: str) -> tuple[str, ...]:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self._word(word)
        return self.known[word]

    def _word(self, word: str) -> tuple[str, ...]:
        parts = [self.symbols[b] for b in word.encode()] if self.byte_level else list(word)
        while len(parts) > 1:
            ranks = [self.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(parts)

    def tokens(self, text: str) -> list[str]:
        return [t for w in text.split() for t in self.word(w)]

    def encode(self, text: str, max_length: int | None = None) -> list[int]:
        """Ids cut to the length limit; an opening and a closing token, where there are such, survive the cut."""
        limit = self.max_length if max_length is None else max_length
        ids = [self.vocab.get(t, self.unk) for t in self.tokens(text)]
        cls, sep = self.special.get("cls"), self.special.get("sep")
        ids = ([cls] if cls is not None else []) + ids + ([sep] if sep is not None else [])
        if len(ids) > limit:
            ids = ids[: limit - 1] + [sep] if sep is not None else ids[:limit]
        return ids


def encoder(bpe: Bpe):
    """A column function: text to struct<input_ids, attention_mask, token_type_ids>. The tables of ``bpe`` travel once per worker."""

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = [bpe.encode(t or "") for t in texts]
            yield pd.DataFrame({"input_ids": ids, "attention_mask": [[1] * len(i) for i in ids], "token_type_ids": [[0] * len(i) for i in ids]})

    return run


def pad_batch(df: DataFrame, batch: Column, ids: str = "input_ids", pad: int = 0) -> DataFrame:
    """Ids and mask filled up to the longest of each batch."""
    width = F.max(F.size(ids)).over(Window.partitionBy(batch))
    gap = width - F.size(ids)
    out = df.withColumn("_gap", gap)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_gap")))
    return out.withColumn("attention_mask", mask).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("_gap")))).drop("_gap")
