"""Repeated-passage removal by column-wise construction of a multi-document BWT.

A byte is removed if a string of ``LENGTH`` bytes covering it also starts earlier.

1. Windows of ``LENGTH`` bytes are dealt by minimiser, the least hash of the
   ``K``-byte strings inside, so equal windows share a key. A run of windows with
   one minimiser is a piece. One shuffle carries (minimiser, hash of the piece,
   document, start, windows); texts stay. Copies inside a batch are settled
   before it.
2. In order of (minimiser, piece, document, start) all but the first of equal
   pieces are repeats. A minimiser with one distinct piece, in which no window
   can recur, is settled. The other pieces are suspects.
3. A second scan fetches the bytes of all pieces of these minimisers, found
   through a bitmap of fixed size, as blocks of windows keyed by the bytes that a
   block's windows share. Of equal blocks all but the first are repeats, and a
   block alone under its key is settled.
4. The rest is sorted bucket by bucket with one symbol of every block inserted
   per round: the collection's BWT and its longest common prefixes are read from
   the last round's files and written to new ones, sequentially. Neighbours that
   share ``LENGTH`` bytes are equal windows; all but the first are repeats.

Blocks of a crowded key enter step 4 as single windows, dealt by the hash of the
window itself, so no bucket holds one hot key. Equality in step 2 is of a 64-bit
piece hash under a 64-bit minimiser; in steps 3 and 4 it is of bytes.

Defined results: null text is empty; texts below ``LENGTH`` bytes lose nothing;
rows that share a doc_id, or have none, are documents of their own, in order of
input, null last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.shared import store

LENGTH = 100
K = 24
LONGEST = 96
#: Added to a piece's number of windows where one of them may recur inside it.
INNER = 1000
BITS = 26
BUCKET_BYTES = 8_000_000
SORT_BYTES = 500_000
CROWDED = 4000
HALF = (LENGTH - K + 2) // 2
_P = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64)


def minimisers(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-byte hash at each window's start, and the least one inside the window of ``length`` bytes."""
    parts, size, h = {}, 1, _BYTES[data]
    while True:
        parts[size] = h
        if size * 2 > k:
            break
        h = h[:-size] * np.uint64(pow(_P, size, 1 << 64)) + h[size:]
        size *= 2
    out, done = None, 0
    for size in sorted(parts, reverse=True):
        while k - done >= size:
            piece = parts[size][done:]
            out = piece if out is None else out[: len(piece)] * np.uint64(pow(_P, size, 1 << 64)) + piece[: len(out)]
            done += size
    h = out[: len(data) - k + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, size, least = length - k + 1, 1, h
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return h, least


def cut(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Pieces of a text: minimiser, first window, number of windows, whether a window may recur inside the piece; and all hashes.

    Equal windows have their leftmost minimum at one offset, so a piece holds
    two of them only if a window before its last begins with the minimum.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
    here, least = minimisers(data, length, k)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    runs = np.diff(np.append(first, len(least)))
    if runs.max() > LONGEST:
        parts = -(-runs // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + inner * LONGEST
        runs = np.minimum(LONGEST, np.repeat(runs, parts) - inner * LONGEST)
    begins = np.concatenate([[0], np.cumsum(here[: len(least)] == least)])
    return least[first], first, runs, begins[first + runs - 1] > begins[first], here


def merge(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows joined where one ends as the next of its document begins."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(count, at)


def _batch_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for doc, text in zip(batch.column("doc").to_numpy(), batch.column("text")):
        yield int(doc), np.frombuffer(text.as_buffer(), np.uint8)


_PIECES = "mini long, piece long, doc long, start long, n int"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        minis, hashes, docs, starts, counts, held = [], [], [], [], [], 0
        for i, (doc, data) in enumerate(_batch_texts(batch)):
            mini, first, n, inner, _ = cut(data)
            if len(mini):
                raw = memoryview(data)
                hashes.append(np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + (LENGTH - 1)).tolist())], np.uint64))
                minis.append(mini)
                starts.append(first)
                counts.append(n + INNER * inner)
                docs.append(np.full(len(mini), doc, np.int64))
                held += len(mini)
            if held and (held > 500_000 or i == batch.num_rows - 1):
                mini, piece, doc_, start, n_ = (np.concatenate(x) for x in (minis, hashes, docs, starts, counts))
                order = np.lexsort((start, doc_, piece, mini))
                mini, piece, doc_, start, n_ = (x[order] for x in (mini, piece, doc_, start, n_))
                new = np.concatenate([[True], (mini[1:] != mini[:-1]) | (piece[1:] != piece[:-1])])
                gone = merge(doc_[~new], start[~new], n_[~new] % INNER)  # repeats of this batch, marked by n < 0
                spread = (gone[0].astype(np.uint64) + gone[1].astype(np.uint64)) * np.uint64(_P)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ((mini[new].view(np.int64), spread.view(np.int64)), (piece[new].view(np.int64), np.zeros(len(spread), np.int64)), (doc_[new], gone[0]), (start[new], gone[1]), (n_[new].astype(np.int32), -gone[2].astype(np.int32)))],
                    ["mini", "piece", "doc", "start", "n"],
                )
                minis, hashes, docs, starts, counts, held = [], [], [], [], [], 0


_SETTLED = "suspect boolean, mini long, doc long, start long, n int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to repeats and suspects; what crosses a batch is one row and one flag."""

    def out(suspect: bool, mini: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), suspect)), pa.array(mini), pa.array(doc), pa.array(start), pa.array(n.astype(np.int32))], ["suspect", "mini", "doc", "start", "n"])

    last: tuple | None = None  # the last distinct piece: mini, piece, doc, start, n, told
    for batch in batches:
        mini, piece, doc, start, n = (batch.column(c).to_numpy() for c in ("mini", "piece", "doc", "start", "n"))
        done = n < 0
        if done.any():
            yield out(False, np.zeros(int(done.sum()), np.int64), doc[done], start[done], -n[done])
            mini, piece, doc, start, n = (x[~done] for x in (mini, piece, doc, start, n))
        if not len(mini):
            continue
        new = np.concatenate([[last is None or (mini[0], piece[0]) != last[:2]], (mini[1:] != mini[:-1]) | (piece[1:] != piece[:-1])])
        if (~new).any():
            yield out(False, np.zeros(int((~new).sum()), np.int64), doc[~new], start[~new], n[~new] % INNER)
        mini, piece, doc, start, n = (x[new] for x in (mini, piece, doc, start, n))
        if not len(mini):
            continue
        before = np.concatenate([[last is not None and last[0] == mini[0]], mini[1:] == mini[:-1]])
        if before[0] and not last[5]:
            yield out(True, *(np.array([x]) for x in (last[0], *last[2:5])))
        many = before | np.append(before[1:], False) | (n >= INNER)
        n = n % INNER
        if many.any():
            yield out(True, mini[many], doc[many], start[many], n[many])
        last = (mini[-1], piece[-1], doc[-1], start[-1], n[-1], bool(many[-1]))


_BLOCKS = "key long, doc long, start long, body binary"


def _fetch(bits):
    """The suspects' bytes as blocks of windows.

    All windows of a block have their minimum in one half of their offsets, so
    they share ``LENGTH - HALF + 1`` bytes, whose hash is the block's key: equal
    windows are in blocks of one key. Blocks met again in a batch are repeats
    (key null, the number of windows as text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, digest = bits.value, xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            seen: set[tuple[int, bytes]] = set()
            for doc, data in sorted(_batch_texts(batch), key=lambda x: x[0]):
                mini, first, n, inner, here = cut(data)
                low = (mini & np.uint64((1 << BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero(near[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1))
                if not len(hit):
                    continue
                raw = data.tobytes()
                for a, c, recurs, least in zip(first[hit].tolist(), n[hit].tolist(), inner[hit].tolist(), mini[hit]):
                    here_ = here[a : a + c + LENGTH - K] == least
                    ends = (a + np.flatnonzero(here_)).tolist() if recurs else [a + int(here_.argmax())]
                    blocks, x = [], a
                    for p in ends:  # windows from x up to y have their leftmost minimum at p
                        y = min(p + 1, a + c)
                        turn = min(y, max(x, p - HALF + 1))  # from here on in the first half of their offsets
                        blocks += [(x_, y_, raw[e : e - HALF + 1 + LENGTH], half) for x_, y_, e, half in ((turn, y, p, 0), (x, turn, p - HALF, 1)) if x_ < y_]
                        x = y
                        if x == a + c:
                            break
                    for x, y, core, half in blocks:
                        body, key = raw[x : y + LENGTH - 1], digest(core, half) - (1 << 63)
                        if (key, body) in seen:
                            rows.append((None, doc, x, b"%d" % (y - x)))
                        else:
                            seen.add((key, body))
                            rows.append((key, doc, x, body))
            key, doc, start, body = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(body, pa.binary())], ["key", "doc", "start", "body"])

    return run


class Columns:
    """The files of one round: the BWT and the common prefixes, read and written front to back."""

    def __init__(self, folder: str) -> None:
        self.folder, self.round = Path(folder), 0

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromfile(self.folder / f"{name}{self.round}", np.uint8) for name in ("bwt", "lcp"))

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        bwt.tofile(self.folder / f"bwt{self.round + 1}")
        lcp.tofile(self.folder / f"lcp{self.round + 1}")
        for name in ("bwt", "lcp"):
            (self.folder / f"{name}{self.round}").unlink(missing_ok=True)
        self.round += 1


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high] for each pair, by doubling."""
    out = np.full(len(low), 255, np.uint8)
    size = high - low + 1
    level = np.frexp(size.astype(float))[1] - 1
    table, step = values, 0
    for want in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == want)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << want) + 1])
        step = 1 << want
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def build_bwt(pieces: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """BWT (0 for the front of a piece) and common prefixes of all suffixes; pieces are below 255 bytes and sort by their number where equal.

    Round j inserts the suffix of length j of every piece. The symbols in the
    BWT so far tell its place: after all suffixes of lower first symbol, and
    after as many of its own as stand before the place of its tail.
    """
    m = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(size)
    symbols = np.unique(flat)  # codes 1.. keep 0 for the front
    code = np.zeros(256, np.uint8)
    if len(symbols) > 255:
        raise ValueError("all 256 byte values occur; one code is needed for the front")
    code[symbols] = np.arange(1, len(symbols) + 1)
    flat = code[flat]
    files = Columns(folder)
    files.write(np.where(size > 0, flat[np.maximum(ends - 1, 0)], 0).astype(np.uint8), np.zeros(m, np.uint8))
    who, place = np.flatnonzero(size > 0), np.flatnonzero(size > 0)
    for length in range(1, int(size.max(initial=0)) + 1):
        bwt, lcp = files.read()
        order = np.argsort(bwt, kind="stable")
        fronts = int(np.searchsorted(bwt[order], 1))
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        at = rank[place]
        spot = m + at - fronts
        following = np.minimum(at + 1, len(bwt) - 1)
        has_left = (at > fronts) & (bwt[order[at - 1]] == bwt[place])
        has_right = (at + 1 < len(bwt)) & (bwt[order[following]] == bwt[place])
        left, right = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        left[has_left] = 1 + _range_least(lcp, order[at[has_left] - 1] + 1, place[has_left])
        right[has_right] = 1 + _range_least(lcp, place[has_right] + 1, order[at[has_right] + 1])
        total = len(bwt) + len(at)
        old = np.ones(total, bool)
        old[spot] = False
        new_bwt, new_lcp = np.empty(total, np.uint8), np.empty(total, np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        back = ends[who] - length - 1
        new_bwt[spot] = np.where(length < size[who], flat[np.maximum(back, 0)], 0)
        inside = spot + 1 < total
        new_lcp[spot[inside] + 1] = right[inside]
        new_lcp[spot] = left
        files.write(new_bwt, new_lcp)
        going = length < size[who]
        who, place = who[going], spot[going]
    return files.read()


def repeats(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (doc, first, count) in the pieces that occur earlier in them."""
    if len({*b"".join(pieces)}) > 255:
        raise ValueError("all 256 byte values occur")
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = build_bwt(pieces, folder)
    m, size = len(pieces), np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(bwt, kind="stable")
    fronts = int(np.searchsorted(bwt[order], 1))
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    who, place = np.arange(m), np.arange(m)
    owner, reach = np.full(len(bwt), -1, np.int64), np.zeros(len(bwt), np.int64)
    for n in range(1, int(size.max(initial=0)) + 1):  # from each end forward through the BWT
        going = size[who] >= n
        who, place = who[going], m + rank[place[going]] - fronts
        owner[place], reach[place] = who, n
    group = np.cumsum(lcp < length)
    rows = np.flatnonzero(reach >= length)
    group, owner, reach = group[rows], owner[rows], reach[rows]
    d, s = doc[owner], start[owner] + size[owner] - reach
    order = np.lexsort((s, d, group))
    group, d, s = group[order], d[order], s[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    at = np.flatnonzero(first)
    same = np.repeat(at, np.diff(np.append(at, len(group))))
    later = (d != d[same]) | (s != s[same])
    return merge(d[later], s[later], np.ones(int(later.sum()), np.int64))


def _bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks that share a key and differ go through the BWT; of equal blocks all but the first are repeats."""
    group = group.sort_values(["key", "doc", "start"], kind="stable")
    again = group.duplicated(["key", "body"]).to_numpy()
    count = group["body"].str.len().to_numpy(np.int64) - (LENGTH - 1)
    doc, start, key = (group[c].to_numpy(np.int64) for c in ("doc", "start", "key"))
    out = [merge(doc[again], start[again], count[again])]
    left = np.flatnonzero(~again)
    several = pd.Series(key[left]).duplicated(keep=False).to_numpy()
    left = left[several]
    body = group["body"].to_numpy()
    ends = np.cumsum(count[left] + LENGTH - 1)
    cuts = np.flatnonzero(np.diff(key[left]) != 0) + 1  # keys stay whole
    part = 0
    while part < len(left):
        stop = np.searchsorted(ends, (ends[part - 1] if part else 0) + SORT_BYTES, side="right")
        later = cuts[cuts >= max(stop, part + 1)]
        stop = int(later[0]) if len(later) and stop < len(left) else len(left)
        rows = left[part:stop]
        out.append(repeats([bytes(x) for x in body[rows]], doc[rows], start[rows]))
        part = stop
    doc, start, count = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"doc": doc, "start": start, "n": count.astype(np.int32)})


def _deal(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hot = batch["hot"].to_numpy(bool)
            cool = batch[~hot]
            yield pd.DataFrame({"bucket": (cool["key"].to_numpy(np.int64).view(np.uint64) % np.uint64(buckets)).astype(np.int64), "key": cool["key"], "doc": cool["doc"], "start": cool["start"], "body": cool["body"]})
            rows = []
            for doc, start, body in zip(batch["doc"][hot], batch["start"][hot], batch["body"][hot]):
                for i in range(len(body) - LENGTH + 1):
                    key = xxhash.xxh3_64_intdigest(body[i : i + LENGTH], 3) - (1 << 63)
                    rows.append((key % buckets, key, doc, start + i, body[i : i + LENGTH]))
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", "key", "doc", "start", "body"])

    return run


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc long, text) with distinct docs to (doc, start, n): runs of windows of bytes that start earlier too."""
    spark = texts.sparkSession
    raw = texts.select("doc", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    pieces = raw.mapInArrow(_extract, _PIECES).repartition("mini").sortWithinPartitions("mini", "piece", "doc", "start")
    settled = store(pieces.mapInArrow(_settle, _SETTLED), "settled")
    suspects = settled.filter("suspect").select("mini")

    low = F.col("mini").bitwiseAND(F.lit((1 << BITS) - 1))
    words = suspects.select(F.shiftright(low, 5).alias("word"), F.expr("shiftleft(1L, cast(mini & 31L as int))").alias("bit"))
    bits = np.zeros(1 << (BITS - 5), np.uint32)  # a fixed size, whatever the input
    table = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    bits[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bits)

    blocks = store(raw.mapInArrow(_fetch(shared), _BLOCKS), "blocks")
    several = blocks.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("c"))
    hot = several.filter(F.col("c") > CROWDED).select("key", F.lit(True).alias("hot"))
    wanted = blocks.filter("key IS NOT NULL").join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    total = blocks.agg(F.sum(F.length("body"))).first()[0] or 0
    dealt = wanted.mapInPandas(_deal(max(1, -(-total // BUCKET_BYTES))), "bucket long, key long, doc long, start long, body binary")
    sorted_ = dealt.groupBy("bucket").applyInPandas(_bucket, "doc long, start long, n int")
    again = blocks.filter("key IS NULL").select("doc", "start", F.col("body").cast("string").cast("int").alias("n"))
    return settled.filter("NOT suspect").select("doc", "start", "n").unionByName(again).unionByName(sorted_)


def strip(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``texts`` the bytes that stay, as ``kept``."""
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if len(set(ids)) == 1:
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    else:  # doc_ids that repeat or are null: number the rows in order
        kept = store(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")), "rows")
        order = kept.select("doc_id", "uid").orderBy(F.col("doc_id").asc_nulls_last(), "uid")
        numbers = order.rdd.zipWithIndex().map(lambda x: (x[0]["uid"], x[1])).toDF("uid long, doc long")
        keyed = store(kept.join(numbers, "uid").select("doc", "doc_id", "text"), "numbered")
    gone = repeated_windows(keyed.select("doc", "text"))
    spans = gone.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")).withColumnRenamed("doc", "d")
    joined = keyed.join(spans, F.col("doc") == F.col("d"), "left")
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))}
            starts, counts = batch.column("starts"), batch.column("counts")
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if starts[i].is_valid:
                    s, n = starts[i].values.to_numpy(), counts[i].values.to_numpy()
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + (LENGTH - 1), -1)
                    out = np.cumsum(edge[:-1]) > 0
                    spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    kept = data[~out].tobytes()
                else:
                    spans, kept = 0, data.tobytes()
                for c, v in zip(cols, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    cols[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64() if c.startswith("n_") else pa.binary() if c == "kept" else pa.string()) for c, v in cols.items())], ["doc_id", *cols])

    shape = f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return joined.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "starts", "counts").mapInArrow(run, shape)
