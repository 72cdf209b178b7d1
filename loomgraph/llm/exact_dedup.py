"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One scan gives each row a 64-bit fingerprint and a SHA-256 of its normalised
   text, both JVM-side. The slim table of these is written; texts are not.
2. Each sender (up to ``SENDER_ROWS`` rows of one input partition) cuts the
   fingerprints to ``b`` bits, sorts the distinct ones within each owner's range
   and sends them Golomb-Rice coded: about 1.5 + log2(mean gap) bits a row. There
   are at most ``OWNERS`` owners, so a full sender's messages hold some hundred
   rows or more and their number grows with the rows, not with their square.
3. An owner decodes its messages, finds what two rows share, and returns one
   bitmap for each message, in the message's order.
4. Rows whose bit is set are suspects. A second scan makes the fingerprint again
   and tests it where the row is read, against bitmaps sized by the count of
   suspects; only the texts that pass are shuffled, combined on the map side by
   whole text, and compared byte by byte.

Cutting to ``b = log2(rows) + 8`` bits makes about one row in 256 a false
suspect whatever the size; step 4 clears those.

Defined results: null text counts as empty; rows that repeat (even with one
doc_id) each get a row, and exactly one of a group is kept; a null doc_id sorts
last; an empty table gives no rows; columns other than doc_id and text are not
read. A text however long is one row in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.shared import sieve, store

SPACE = " \t\n\x0b\f\r"
SENDER_ROWS = 1 << 20
OWNER_ROWS = 1 << 19
OWNERS = 1 << 13


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def rice_encode(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """Sorted distinct integers below ``universe`` as (k, payload): unary quotients of the gaps, then k-bit remainders."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1.0, universe / len(values))
    k = max(0, int(np.log2(mean * 0.6931)) if mean > 2 else 0)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)).astype(np.uint8) & 1
    return k, np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def rice_decode(n: int, k: int, payload: bytes) -> np.ndarray:
    """The inverse of ``rice_encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    high = np.diff(ends, prepend=-1) - 1
    low = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    rest = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def _senders(bits: int, owners: int):
    width = -(-(1 << bits) // owners)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            held.append((batch["fp"].to_numpy(np.int64), batch["uid"].to_numpy(np.int64)))
            n += len(batch)
            if n >= SENDER_ROWS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for prints, uids in blocks(batches):
            prints = prints.view(np.uint64) >> np.uint64(64 - bits)
            order = np.argsort(prints, kind="stable")
            prints, uids = prints[order], uids[order]
            cuts = np.searchsorted(prints, np.arange(owners + 1, dtype=np.uint64) * np.uint64(width))
            rows = []
            for owner in range(owners):
                part, ids = prints[cuts[owner] : cuts[owner + 1]], uids[cuts[owner] : cuts[owner + 1]]
                if not len(part):
                    continue
                distinct, first, counts = np.unique(part, return_index=True, return_counts=True)
                k, payload = rice_encode(distinct - np.uint64(owner * width), width)
                rows.append((int(ids[0]), owner, len(distinct), k, payload, np.packbits(counts > 1).tobytes(), ids.tobytes(), counts.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["msg", "owner", "n", "k", "payload", "twice", "uids", "counts"])

    return send


def _owner(group: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(n, k, p) for n, k, p in zip(group["n"], group["k"], group["payload"])]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(x)].astype(bool) for t, x in zip(group["twice"], lists)]
    every = np.concatenate(lists)
    values, counts = np.unique(every, return_counts=True)
    shared = np.union1d(values[counts > 1], np.concatenate([x[t] for x, t in zip(lists, twice)]))
    maps = [np.packbits(np.isin(x, shared)).tobytes() for x in lists]
    return pd.DataFrame({"msg": group["msg"], "owner": group["owner"], "bitmap": maps})


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for n, bitmap, uids, counts in zip(batch["n"], batch["bitmap"], batch["uids"], batch["counts"]):
            marks = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
            rows = np.repeat(marks, np.frombuffer(counts, np.int32))
            yield pd.DataFrame({"uid": np.frombuffer(uids, np.int64)[rows]})


def exchange(prints: DataFrame, bits: int | None = None) -> DataFrame:
    """(uid long, fp long) to the uids of the rows whose fingerprint, cut to ``bits``, another row has too.

    The messages with their senders' row lists are written once, so bitmaps
    always meet the very rows they were made from, also after a lost executor.
    """
    n = prints.count()
    bits = bits or min(62, max(16, int(n).bit_length() + 8))
    owners = min(OWNERS, max(8, -(-n // OWNER_ROWS)))
    schema = "msg long, owner int, n int, k int, payload binary, twice binary, uids binary, counts binary"
    messages = store(prints.select("uid", "fp").mapInPandas(_senders(bits, owners), schema), "messages")
    sent = messages.select("msg", "owner", "n", "k", "payload", "twice")
    bitmaps = sent.groupBy("owner").applyInPandas(_owner, "msg long, owner int, bitmap binary")
    back = messages.select("msg", "owner", "n", "uids", "counts").join(bitmaps, ["msg", "owner"])
    return back.select("n", "bitmap", "uids", "counts").mapInPandas(_suspects, "uid long")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the most code points in its original text
    stays, then the smallest doc_id. ``digest_bytes`` below 32 and ``bits``
    exist for tests: they force collisions, which byte comparison must resolve.
    """
    rows = store(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cp"),
            normalised(F.col("text")).alias("norm"),
        ).select("uid", "doc_id", "cp", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "fingerprints",
    )
    suspects = store(exchange(rows, bits), "suspects")
    marked = rows.join(suspects.withColumn("suspect", F.lit(True)), "uid", "left").withColumn("digest", F.substring("sha", 1, digest_bytes))

    # Byte comparison: the suspects' whole texts, one row for each text and map task.
    held = rows.join(suspects, "uid", "left_semi").select("fp").distinct()
    bodies = sieve(docs.select(normalised(F.col("text")).alias("norm")), F.xxhash64("norm"), held).filter("maybe")
    bodies = bodies.groupBy("norm").agg(F.count("*").alias("n"))
    texts = store(
        bodies.select(F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes).alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"))
        .groupBy("digest")
        .agg(F.count("*").alias("texts")),
        "texts",
    )
    clashes = store(texts.filter("texts > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        marked = marked.withColumn("body", F.lit(None).cast("string"))
    else:  # different texts under one digest: these rows are told apart by their text
        again = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("body")).withColumn("digest", F.substring(F.unhex(F.sha2("body", 256)), 1, digest_bytes))
        again = again.join(clashes, "digest", "left_semi").select(F.col("doc_id").alias("cid"), F.col("digest").alias("cdig"), "body", F.unhex(F.sha2("body", 256)).alias("csha")).distinct()
        marked = marked.join(again, F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("sha") == F.col("csha")), "left").drop("cid", "cdig", "csha")

    one = marked.filter("suspect IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    many = marked.filter("suspect")
    best = F.struct(-F.col("cp"), F.col("doc_id").isNull(), "doc_id", "uid")
    group = many.groupBy("digest", "body").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    group = group.select(F.col("digest").alias("gd"), F.col("body").alias("gb"), "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    on = (F.col("digest") == F.col("gd")) & F.col("body").eqNullSafe(F.col("gb"))
    many = many.join(group, on).select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")
    return one.unionByName(many).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
