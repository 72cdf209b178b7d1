"""Token ids as raw shards, with a minimal perfect hash index for keyed access.

Shards: documents in ascending doc_id order are cut into shards of about
``SHARD_IDS`` ids. A shard is one row of a Parquet file: its number, the ids of
all shards before it, the byte width of an id, the raw little-endian ids, and
the length of each document. Cutting needs one range shuffle of encoded ids; no
task holds more than one shard. The table is bucketed by the part that wrote a
shard, so that look-ups come to the shards and payloads are not shuffled again.

Index: a document key is (doc_id, copy), copy counting rows of one doc_id. Keys
are dealt to buckets by hash. Each bucket has a minimal perfect hash: levels of
bit arrays in which a key that is alone at its place gets that place's rank,
the others going on to the next level. At the rank lie a 16-bit fingerprint,
shard, position, and length. A look-up costs a few bit probes and one read of a
payload at the offset the index gives; a key that was never stored is refused by
its fingerprint but for one in 65,536. The index is built from the shards' lists
of ids and lengths; rows are delivered from the payloads alone.

Encoding: white space never joins a token, so words between spaces and newlines
are encoded once and remembered in a bounded table; the ids are those of encoding
the whole text.

Defined results: null text is empty and has the end id alone; a null doc_id
comes last; rows of one doc_id lie side by side, ordered by their ids; an empty
table gives no shards and no rows; columns beyond doc_id and text are not read. A
text however long is one row in a task and stands in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.labelled import release
from loomgraph.shared import drop, store, store_buckets

END_ID = 1
SHARD_IDS = 2_000_000
BUCKET_KEYS = 20_000
MEMORY = 1_250_000
SLICE_BYTES = 14 << 20
GAMMA = 1.5
_TAIL = ".,!?;:*#%&$"


class Encoder:
    """Ids of whole texts, word by word with a bounded memory.

    Letters followed by marks of ``_TAIL`` are two pieces to the tokenizer, and
    case is dropped, so ``The``, ``the`` and ``the,`` share what is remembered.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4"
        self.lowers = "Lowercase" in self.tokenizer.to_str()[:20_000]
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memory = memory
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Many words in one call. Words of letters are one piece, closed by one token; else a token belongs to the word in which it starts."""
        for letters in (True, False):
            some = [w for w in new if w.isalpha() == letters]
            for i in range(0, len(some), 4000):
                part = some[i : i + 4000]
                made = self.tokenizer.encode(" ".join(part), add_special_tokens=False) if not letters else self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
                ids = np.array(made.ids, np.int64)
                ends = np.flatnonzero(self.closes[ids]) + 1 if letters else ()
                if len(ends) != len(part):
                    offsets = self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets if letters else made.offsets
                    ends = np.searchsorted(np.fromiter((o[0] for o in offsets), np.int64, len(ids)), np.cumsum([len(w) + 1 for w in part]))
                raw, width = ids.astype(self.kind).tobytes(), int(self.kind[2])
                at = [0, *(ends * width).tolist()]
                self.words.update((w, raw[x:y]) for w, x, y in zip(part, at, at[1:]))

    def _recall(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct words, new ones learnt in a few calls."""
        if len(self.words) > self.memory // 2:  # words not met since the last turn are forgotten
            self.older, self.words = self.words, {"": b""}
        words, older = self.words, self.older
        found = list(map(words.get, distinct))
        missing = []
        for i, x in enumerate(found):
            if x is None:
                w = distinct[i]
                if (x := older.get(w)) is None:
                    missing.append(i)
                else:
                    found[i] = words[w] = x
        parts, pieces = [], {}
        for i in missing:
            w = distinct[i]
            base = w.rstrip(_TAIL)
            if not base.isalpha() or not (base.isascii() or normalize("NFC", base).lower().isalpha()):
                base, tail = w, ""  # case folding may leave a mark, which joins what follows
            else:
                tail = w[len(base) :]
                if self.lowers and base.isascii():
                    base = base.lower()
                pieces[tail] = None
            pieces[base] = None
            parts.append((i, base, tail))
        if parts:
            for x in pieces:
                if x not in words and x in older:
                    words[x] = older[x]
            self._learn([x for x in pieces if x not in words])
        for i, base, tail in parts:
            found[i] = words[distinct[i]] = words[base] + words[tail]
        return found

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; words are split and made distinct by Arrow, ids gathered by numpy."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        found = self._recall(coded.dictionary.to_pylist())
        width = int(self.kind[2])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // width
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(found), self.kind)
        each = lengths[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])]
        docs = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[x:y] for x, y in zip(docs, docs[1:])]


@lru_cache(maxsize=2)
def encoder_for(path: str, memory: int = MEMORY) -> Encoder:
    """One encoder for each Python worker; what it remembers serves all tasks that the worker runs."""
    release()
    return Encoder(path, memory)


def encode(docs: DataFrame, path: str, memory: int = MEMORY) -> DataFrame:
    """doc_id, n (with the end id), ids (raw bytes, 2 or 4 a piece as the vocabulary needs), wide; ``memory`` words are remembered, which changes the work alone."""

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, memory)
        end = np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), len(texts)]
            for x, y in zip(cuts, cuts[1:]):
                ids = encoder(texts[x:y])
                made = [pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array([i.tobytes() + end for i in ids], pa.binary()), pa.array([encoder.kind == "<u4"] * len(ids), pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[x:y], *made], ["doc_id", "n", "ids", "wide"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids binary, wide boolean")


def _cut(shard_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder_for.cache_clear()  # encoding is over; a shard needs the room
        part, cut, held, docs, lengths, wide = TaskContext.get().partitionId(), 0, 0, [], [], False
        payload: list[bytes] = []

        def made() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "cut": [cut], "n_ids": [held], "wide": [wide], "payload": [b"".join(payload)], "doc_ids": [docs], "lengths": [lengths]})

        for batch in batches:
            for doc, n, ids, w in zip(batch["doc_id"], batch["n"], batch["ids"], batch["wide"]):
                docs.append(None if doc is None else int(doc))
                lengths.append(int(n))
                payload.append(ids)
                held, wide = held + int(n), bool(w)
                if held >= shard_ids:
                    yield made()
                    cut, held, docs, lengths, payload = cut + 1, 0, [], [], []
        if docs:
            yield made()

    return run


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, batch_rows: int | None = None, memory: int = MEMORY) -> DataFrame:
    """Encode, order and write; returns a scan of the shard files."""
    encoded = store(encode(docs, path, memory), "encoded", batch_rows)
    total = encoded.agg(F.sum("n")).first()[0] or 0
    key = F.col("doc_id").cast("long").asc_nulls_last()
    parts = max(1, -(-total // (2 * shard_ids)))
    ordered = encoded.repartitionByRange(max(2, parts), key, F.substring("ids", 1, 16)).sortWithinPartitions(key, "ids")
    ordered = ordered.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "part int, cut int, n_ids long, wide boolean, payload binary, doc_ids array<long>, lengths array<long>"
    raw = store_buckets(ordered.mapInPandas(_cut(shard_ids), schema), "shards", max(2, parts), "part")
    raw._parts = max(2, parts)
    drop(encoded)
    return raw


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, cut, shard, first: the number of each shard and the ids before it.

    Sums run within blocks of 1024 parts; one row a block enters the window over all.
    """
    rows = shards.select("part", "cut", "n_ids", F.shiftright("part", 10).alias("block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("shards"))
    blocks = blocks.select("block", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids"), F.coalesce(F.sum("shards").over(earlier), F.lit(0)).alias("shards"))
    order = Window.partitionBy("block").orderBy("part", "cut")
    within = rows.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids")).withColumn("row", F.row_number().over(order) - 1)
    return within.join(blocks, "block").select("part", "cut", (F.col("shards") + F.col("row")).alias("shard"), (F.col("ids") + F.col("before")).alias("first"))


def stored_documents(shards: DataFrame) -> DataFrame:
    """One row per stored document, from the shards' lists alone: doc_id, part, cut, position, length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder_for.cache_clear()
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"doc_id": pd.array(row.doc_ids, dtype="Int64"), "part": row.part, "cut": row.cut, "position": np.cumsum(row.lengths) - row.lengths, "length": row.lengths})

    return shards.select("part", "cut", "doc_ids", "lengths").mapInPandas(run, "doc_id long, part int, cut int, position long, length long")


def read_payloads(found: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows with part, cut, position and length to doc_id, part, cut, position, n_tokens, ids_crc32, cut from the payloads there."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in held.itertuples(index=False):
            mine = asked[asked["cut"] == row.cut]
            width = 4 if row.wide else 2
            at, n = mine["position"].to_numpy(np.int64) * width, mine["length"].to_numpy(np.int64) * width
            ids = [np.frombuffer(row.payload[a : a + k], "<u4" if row.wide else "<u2") for a, k in zip(at.tolist(), n.tolist())]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            out.append(pd.DataFrame({"doc_id": mine["doc_id"], "part": row.part, "cut": row.cut, "position": mine["position"], "n_tokens": [len(x) for x in ids], "ids_crc32": np.array(crc, np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "part", "cut", "position", "n_tokens", "ids_crc32")})

    asked = found.select(F.col("doc_id").cast("string").alias("doc_id"), "part", "cut", "position", "length").repartition(shards._parts, "part")
    read = asked.groupBy("part").cogroup(shards.select("part", "cut", "wide", "payload").groupBy("part"))
    read = read.applyInPandas(run, "doc_id string, part int, cut int, position long, n_tokens long, ids_crc32 long")
    return read.withColumn("doc_id", F.col("doc_id").cast(found.schema["doc_id"].dataType))


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: pd.Series, copies: pd.Series) -> np.ndarray:
    return mix64(ids.to_numpy(np.int64).view(np.uint64) ^ mix64(copies.to_numpy(np.int64).view(np.uint64), 3), 5)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bits and their running counts."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = [np.unpackbits(x).astype(bool) for x in levels]
        self.ranks, base = [], 0
        for bits in self.levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())

    @staticmethod
    def build(keys: np.ndarray) -> list[np.ndarray]:
        levels, left = [], keys
        while len(left):
            size = -(-max(8, int(GAMMA * len(left))) // 8) * 8
            place = (mix64(left, len(levels) + 11) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[place]]
            if len(levels) > 200:
                raise ValueError("keys of one bucket are not distinct")
        return levels

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, below the number of keys; -1 where no level takes it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            place = (mix64(keys[open_], level + 11) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[open_[hit]] = ranks[place[hit]]
            open_ = open_[~hit]
        return out


def _bucket(batches: Iterator[pd.DataFrame], buckets: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = key_hash(batch["k"], batch["copy"])
        out = batch[columns].copy()
        out["bucket"] = (keys % np.uint64(buckets)).astype(np.int64)
        out["key"] = keys.view(np.int64)
        yield out


def _index(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["key"].to_numpy().view(np.uint64)
    levels = PerfectHash.build(keys)
    place = PerfectHash(levels)(keys)
    order = np.empty(len(keys), np.int64)
    order[place] = np.arange(len(keys))
    prints = (mix64(keys, 1) & np.uint64(0xFFFF)).astype("<u2")
    col = lambda c: group[c].to_numpy("<i8")[order].tobytes()
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "levels": [[x.tobytes() for x in levels]], "prints": [prints[order].tobytes()], "parts": [col("part")], "cuts": [col("cut")], "positions": [col("position")], "lengths": [col("length")]})


def with_copy(rows: DataFrame, *order: str, repeated: bool = True) -> DataFrame:
    """The rows of one doc_id numbered (0 where none is ``repeated``), and ``k``, the key's number, in which null has a place of its own."""
    rows = rows.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62) - 7)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1 if repeated else F.lit(0)
    return rows.withColumn("copy", number.cast("long"))


def build_index(stored: DataFrame, rows: int, bucket_keys: int = BUCKET_KEYS, repeated: bool = True) -> tuple[DataFrame, int]:
    """The index table, one row per bucket, and the number of buckets."""
    buckets = max(1, -(-rows // bucket_keys))
    columns = ["part", "cut", "position", "length"]
    keyed = with_copy(stored.select("doc_id", *columns), "part", "cut", "position", repeated=repeated)
    keyed = keyed.mapInPandas(lambda it: _bucket(it, buckets, columns), "part int, cut int, position long, length long, bucket long, key long")
    made = keyed.groupBy("bucket").applyInPandas(_index, "bucket long, levels array<binary>, prints binary, parts binary, cuts binary, positions binary, lengths binary")
    return store(made, "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, copy) to doc_id, part, cut, position, length; keys that the index refuses give no row."""
    kind = keys.schema["doc_id"].dataType
    asked = keys.select("copy", "k", F.col("doc_id").cast("string").alias("doc_id"))
    keyed = asked.mapInPandas(lambda it: _bucket(it, buckets, ["doc_id"]), "doc_id string, bucket long, key long")

    def probe(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"doc_id": asked["doc_id"][:0], "part": [], "cut": [], "position": [], "length": []})
        row = held.iloc[0]
        keys = asked["key"].to_numpy().view(np.uint64)
        place = PerfectHash([np.frombuffer(x, np.uint8) for x in row["levels"]])(keys)
        prints = np.frombuffer(row["prints"], "<u2")
        good = (place >= 0) & (prints[place] == (mix64(keys, 1) & np.uint64(0xFFFF)))
        take = lambda c: np.frombuffer(row[c], "<i8")[place[good]]
        return pd.DataFrame({"doc_id": asked["doc_id"].to_numpy()[good], "part": take("parts"), "cut": take("cuts"), "position": take("positions"), "length": take("lengths")})

    found = keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, "doc_id string, part int, cut int, position long, length long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def token_table(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, bucket_keys: int = BUCKET_KEYS, batch_rows: int | None = None, memory: int = MEMORY) -> DataFrame:
    """Write shards and index, then read every document back by key: doc_id, start, n_tokens, ids_crc32.

    ``batch_rows`` texts at once and ``memory`` words bound what an encoding worker holds; any numbers give the same ids.
    """
    shards = write_shards(docs, path, shard_ids, batch_rows, memory)
    stored = store(stored_documents(shards), "stored")
    rows, keys, known = stored.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    repeated = not rows == keys == known
    index, buckets = build_index(stored, rows, bucket_keys, repeated)
    found = look_up(with_copy(docs.select("doc_id"), "doc_id", repeated=repeated), index, buckets)
    out = read_payloads(found, shards).join(shard_starts(shards), ["part", "cut"])
    return out.select("doc_id", (F.col("first") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
