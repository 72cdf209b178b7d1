"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints come from one scan. Distinct fingerprints are ordered by Gray rank,
in which neighbours tend to differ in few bits. The index is a tree over that
order: a node holds the bits on which all fingerprints below it agree, less those
its parent holds already. A search adds up differences from node to node and
drops a whole group as soon as they exceed the limit.

Two fingerprints within ``LIMIT`` bits agree on one of ``LIMIT + 1`` blocks of
bits. So each is ranked once for every block, rotated to bring that block to
the front, and pairs need only meet where their fronts agree: a fingerprint makes
three rows, however large the input. The upper nodes are Gray ranges of about
equal counts, cut from exact counts of ``2^16`` prefixes, and where one prefix is
crowded, of ``2^32``; they are few (``UPPER_NODES`` a block) and broadcast. Inside a
crowded front a fingerprint also visits the later nodes whose shared bits leave
it within the limit. A task holds one upper node and builds the levels below.

A task reports the links that join its fingerprints as a forest, so output
stays linear; components are then closed by alternating star joins over written
tables.

Defined results: null counts as empty; texts without words have fingerprint zero
and link like any other; rows that repeat each get a row; a null doc_id takes
part but never names a component unless all are null; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.labelled import tidy
from loomgraph.shared import drop, sieve, store

SEED = 42
LIMIT = 2
PREFIX = 16
UPPER_NODES = 1 << 12
GROUP_ROWS = 8192
FAN = 16
BLOCK = 1 << 18
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {c: " " for c in "\t\n\x0b\x0c\r"})


def fingerprint(text: str, width: int = 3) -> int:
    """Majority bits over XXH64 of the word shingles, repeats included; an unsigned 64-bit number."""
    words = [w for w in text.translate(_LOWER).split(" ") if w]
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, for every row."""

    @F.pandas_udf("long")
    @tidy
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in batch], np.uint64).view(np.int64))

    return docs.select("doc_id", prints(F.coalesce("text", F.lit(""))).alias("fp"))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray code."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def upper_nodes(counts: np.ndarray, rows: int) -> np.ndarray:
    """First Gray ranks of ranges of about ``rows`` fingerprints, from counts by prefix; the first is 0."""
    running = np.concatenate([[0], np.cumsum(counts)[:-1]])
    cuts = np.flatnonzero(np.diff(running // max(1, rows)) > 0) + 1
    return np.concatenate([[0], cuts]).astype(np.uint64) << np.uint64(64 - PREFIX)


def shared_bits(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) on which all Gray codes of ranks first..last agree: the bits above the first rank bit that changes.

    Between two ranks that agree on their top bits, the code bits made of those
    alone are fixed; where just one lower bit flips, the code bit there varies.
    """
    diff = first ^ last
    for shift in (1, 2, 4, 8, 16, 32):
        diff |= diff >> np.uint64(shift)
    mask = ~diff
    return mask, gray_code(first) & mask


class GrayTree:
    """The lower levels of the index over sorted distinct fingerprints."""

    def __init__(self, prints: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(prints), kind="stable")
        self.prints = prints[self.order]
        both, none = self.prints, ~self.prints  # bits that are one, zero in all below
        self.levels = []
        while len(both) > 1:
            starts = np.arange(0, len(both), FAN)
            both, none = np.bitwise_and.reduceat(both, starts), np.bitwise_and.reduceat(none, starts)
            self.levels.append([both | none, both])
        parent = None
        for level in reversed(self.levels):  # what a parent holds already is factored out
            mask = level[0].copy()
            if parent is not None:
                mask &= ~np.repeat(parent, FAN)[: len(mask)]
            parent, level[0] = level[0], mask

    def search(self, queries: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """All (query, fingerprint) positions at ``limit`` or fewer differing bits."""
        found = []
        step = max(1, BLOCK // 64)
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            top = len(self.levels[-1][0]) if self.levels else len(self.prints)
            queue = [(len(self.levels), np.repeat(q, top), np.tile(np.arange(top), len(q)), np.zeros(len(q) * top, np.uint8))]
            while queue:
                depth, query, node, sofar = queue.pop()
                if len(query) > BLOCK:  # in parts, so that memory stays bounded
                    for i in range(0, len(query), BLOCK):
                        queue.append((depth, query[i : i + BLOCK], node[i : i + BLOCK], sofar[i : i + BLOCK]))
                    continue
                if not depth:
                    near = np.bitwise_count(queries[query] ^ self.prints[node]) <= limit
                    found.append((query[near], node[near]))
                    continue
                mask, ones = self.levels[depth - 1]
                sofar = sofar + np.bitwise_count((queries[query] ^ ones[node]) & mask[node])
                keep = sofar <= limit
                query, node, sofar = query[keep], node[keep], sofar[keep]
                below = len(self.prints) if depth == 1 else len(self.levels[depth - 2][0])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = child < below
                queue.append((depth - 1, np.repeat(query, FAN)[real], child[real], np.repeat(sofar, FAN)[real]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) to links (value, smallest value joined to it), with the same components."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]


def _group(limit: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fp, code, own = group["fp"].to_numpy(), group["code"].to_numpy().view(np.uint64), group["own"].to_numpy(bool)
        tree = GrayTree(code[own])
        ids = fp[own][tree.order]
        q, p = tree.search(code, limit)
        a, b = fp[q], ids[p]
        x, y = forest(a[a != b], b[a != b])
        return pd.DataFrame({"u": x, "v": y})

    return run


def rotate(prints: np.ndarray, by: int) -> np.ndarray:
    return prints << np.uint64(by) | prints >> np.uint64(64 - by) if by else prints.copy()


def links(prints: DataFrame, limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Distinct ``fp`` to links (u, v), a forest within each upper node, whose components are those of all pairs within ``limit``."""
    spark, width = prints.sparkSession, 64 // (limit + 1)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for block in range(limit + 1):
                rank = gray_rank(rotate(fp.view(np.uint64), block * width))
                yield pd.DataFrame({"block": np.full(len(fp), block, np.int32), "rank": rank.view(np.int64), "fp": fp})

    ranked = store(prints.mapInPandas(turn, "block int, rank long, fp long"), "ranks")
    top = F.shiftrightunsigned("rank", 64 - PREFIX)
    counts = np.zeros((limit + 1, 1 << PREFIX), np.int64)  # a fixed number of rows, whatever the input
    for block, value, n in ranked.groupBy("block", top.alias("top")).agg(F.count("*")).collect():
        counts[block, value] = n
    rows = max(group_rows, int(counts[0].sum()) // UPPER_NODES)
    firsts = [upper_nodes(c, rows) for c in counts]
    crowded = [(int(b), int(t)) for b, t in zip(*np.nonzero(counts > 2 * rows))]
    if crowded:  # at most (limit + 1) * UPPER_NODES of them: cut these by twice the prefix
        some = F.broadcast(spark.createDataFrame(crowded, "block int, top long"))
        inner = ranked.withColumn("top", top.cast("long")).join(some, ["block", "top"])
        inner = inner.groupBy("block", "top", F.shiftrightunsigned("rank", 64 - 2 * PREFIX).alias("sub")).agg(F.count("*").alias("n"))
        order = Window.partitionBy("block", "top").orderBy("sub")
        part = F.floor((F.sum("n").over(order) - F.col("n")) / rows)
        cuts = inner.withColumn("part", part).withColumn("last", F.lag("part").over(order)).filter("part > last").select("block", "sub").collect()
        for block in range(limit + 1):
            extra = np.array([s for b, s in cuts if b == block], np.uint64) << np.uint64(64 - 2 * PREFIX)
            firsts[block] = np.union1d(firsts[block], extra)
    lasts = [np.append(f[1:] - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)) for f in firsts]
    upper = spark.sparkContext.broadcast([(f, *shared_bits(f, x)) for f, x in zip(firsts, lasts)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                first, mask, pattern = upper.value[block]
                rank, fp = part["rank"].to_numpy().view(np.uint64), part["fp"].to_numpy()
                home = np.searchsorted(first, rank, side="right") - 1
                tail = rank | np.uint64((1 << (64 - width)) - 1)  # the last rank with the same leading block
                end = np.searchsorted(first, tail, side="right") - 1
                code, node, row, ahead = gray_code(rank), home, np.arange(len(rank)), 0
                while len(row):
                    near = np.bitwise_count((code[row] ^ pattern[node]) & mask[node]) <= limit
                    yield pd.DataFrame({"block": np.int32(block), "node": node[near].astype(np.int32), "code": code[row[near]].view(np.int64), "fp": fp[row[near]], "own": np.full(int(near.sum()), not ahead)})
                    ahead += 1
                    row = row[home[row] + ahead <= end[row]]
                    node = home[row] + ahead

    routed = ranked.mapInPandas(route, "block int, node int, code long, fp long, own boolean")
    return routed.groupBy("block", "node").applyInPandas(_group(limit), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) to (id, root), root the smallest id joined to id; ids that no link names are absent.

    Alternating large-star and small-star joins; a round with no change ends it.
    """
    edges = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = store(small, "links")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def near_dedup(docs: DataFrame, width: int = 3, limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    prints = store(fingerprints(docs, width), "prints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = store(components(links(distinct.select("fp"), limit, group_rows)), "roots")
    named = distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    out = prints.join(labels, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by content: the same index over fingerprints of five-word shingles, and an exact join for what it leaves.

SHINGLE = 5
SIMILAR = 0.8
#: A pair must share so many shingles of its prefixes.
SHARED = 4
#: What so many rows of a sample say is common stands last in the prefixes, and at most so many shingles of it are broadcast.
SAMPLE = 10_000
COMMON = 1 << 17
BINS = 256
#: Turns in which components are compared with a few members of the largest one at each prefix shingle before all pairs are: one, then ``PIVOTS``.
TURNS = 2
PIVOTS = 4
#: Shingles before one in a prefix that a pair is told by to have met already; more of them mean fewer repeats of a pair, not other pairs.
BEFORE = 4
CACHE = 150_000
#: Whole texts that lie in a Python worker at once; the work and the result are the same for any number.
BATCH_ROWS = 500


def shingle_set(text: str, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of fewer words, of the whole; none without words."""
    words = [w for w in text.translate(_LOWER).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    if len(seen) > CACHE:
        seen.clear()
    hashes = np.array([seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)) for w in words], np.uint64)
    width = min(SHINGLE, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes; an unsigned number, 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def prefix(shingles: np.ndarray, common: np.ndarray, place: np.ndarray, similar: float = SIMILAR, least: int = SHARED) -> np.ndarray:
    """The shingles of a set, rarest first, that a set as similar as ``similar`` must share ``least`` of with its own.

    The order (place among the common ones, then hash) is the same for all sets;
    whether ``common`` is well chosen changes the work, not the result. A set of
    fewer than ``least`` shingles is similar only to its equals.
    """
    n = len(shingles)
    if n < least:
        return np.zeros(0, np.uint64)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, place[at] + 1, 0)
    return shingles[np.lexsort((shingles, rank))[: n - int(np.ceil(similar * n - 1e-9)) + least]]


def bin_counts(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of ``BINS``, up to 255."""
    return np.minimum(np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes()


def odd_bins(hashes: np.ndarray) -> np.ndarray:
    """256 bits in four numbers: in which of ``BINS`` an odd number of hashes lies. Two sets differ in as many members at least as in bits."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (BINS - 1), minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shared_at_most(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows of bin counts to what the sets can have in common: in each bin the lesser count; no more than ``least``, the smaller size."""
    full = ((a == 255) & (b == 255)).any(axis=1)
    return np.where(full, least, np.minimum(least, np.minimum(a, b).sum(axis=1, dtype=np.int64)))


def _features(docs: DataFrame, key: str, similar: float) -> DataFrame:
    """``key``, doc_id, digest of the shingle set, fp, size, bins, odd bins, prefix of every row."""
    spark = docs.sparkSession
    every = max(1, docs.count() // SAMPLE)
    text = F.coalesce("text", F.lit("")).alias("text")

    @tidy
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingle_set(t, {}) for t in batch["text"]]
            yield pd.DataFrame({"token": np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)})

    sample = docs.filter(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(text).mapInPandas(shingles, "token long")
    often = store(sample.groupBy("token").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "token").limit(COMMON), "common", BATCH_ROWS)
    found = np.array([tuple(r) for r in often.collect()], np.int64).reshape(-1, 2)
    drop(often)
    found = found[np.argsort(found[:, 0].copy().view(np.uint64))]
    common = spark.sparkContext.broadcast((found[:, 0].copy().view(np.uint64), found[:, 1].copy()))

    @F.pandas_udf("digest binary, fp long, size int, bins binary, odd array<long>, prefix array<long>")
    @tidy
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            rows = []
            for t in batch:  # no more than one whole set at a time
                x = shingle_set(t, seen)
                rows.append((xxhash.xxh128_digest(x.astype("<u8").tobytes(), SEED), majority(x), len(x), bin_counts(x), odd_bins(x), prefix(x, *common.value, similar).view(np.int64)))
            digest, fp, size, bins, odd, head = zip(*rows) if rows else ((),) * 6
            yield pd.DataFrame({"digest": digest, "fp": np.array(fp, np.uint64).view(np.int64), "size": np.array(size, np.int32), "bins": bins, "odd": odd, "prefix": head})

    return store(docs.select(key, "doc_id", features(text).alias("f")).select(key, "doc_id", "f.*"), "features", BATCH_ROWS)


def _whole_sets(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(id, shingles) for ``wanted`` (id, at), from the text of the row whose key is ``at``; only texts that a sieve lets through are shuffled."""

    @F.pandas_udf("array<long>")
    @tidy
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, int] = {}
        for batch in batches:
            yield pd.Series([shingle_set(t, seen).view(np.int64) for t in batch])

    some = sieve(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), F.xxhash64(key), wanted.select(F.xxhash64("at").alias("h")))
    rows = some.filter("maybe").join(wanted, F.col(key) == F.col("at"))
    return store(rows.select("id", whole("text").alias("shingles")), "sets", BATCH_ROWS)


def near_rows(docs: DataFrame, key: str, similar: float = SIMILAR, limit: int = LIMIT, group_rows: int = GROUP_ROWS, turns: int = TURNS) -> DataFrame:
    """``key``, doc_id, component_id and ``keep`` for every row: the smallest doc_id joined to the row, and the key of the row that has it.

    Two rows are joined where the sets of their five-word shingles have a Jaccard
    similarity of ``similar`` or more, and through others. All such pairs count,
    whatever their fingerprints; none counts on an estimate.

    1. Rows of one shingle set are a class. The Gray index joins classes whose
       fingerprints lie within ``limit`` bits, each link checked on the sets, after
       a bound on what they can share by the counts of their hashes in ``BINS``.
    2. Sets of similarity ``similar`` share ``SHARED`` shingles of their prefixes (a
       fifth of a set, rarest first). Shingles that stand in one prefix only
       are left out by a count over all. In ``turns`` turns every component is
       compared with a few members of the largest component at its shingles, those
       that share most with it, so that a large group of copies becomes one component
       in linear work.
    3. All pairs of different components that can be similar are compared, first the
       one that can share most for each two components, then the rest. A pair is
       found at the first prefix shingle that both have, where all that they have in
       common must lie behind it, unless the parities of their ``BINS`` differ in
       more bits than similar sets can; it is left out at later ones.

    ``key`` identifies a row, in any type, the same whenever it is read. A null
    doc_id comes after all others; among equal ones the row of smallest key is
    kept. Null and empty texts are one class; texts of fewer than five words are
    joined to their equals alone; an empty table gives no rows; columns beyond
    key, doc_id and text are not read. A text however long is one row in a task.
    """
    rows = _features(docs.select(key, "doc_id", "text"), key, similar)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("at"))).alias("low")
    classes = rows.groupBy("digest").agg(low, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bins").alias("bins"), F.first("odd").alias("odd"), F.first("prefix").alias("prefix"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # shingles that stand in several prefixes
    tokens = classes.select("id", "size", F.size("prefix").alias("head"), F.posexplode("prefix").alias("pos", "token"))
    often = store(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "often")
    some = sieve(tokens, F.xxhash64("token"), often.select(F.xxhash64("token").alias("h"))).filter("maybe").drop("maybe")
    tokens = store(some.join(often, "token"), "tokens")

    # the index: links between the first classes of each fingerprint, and from those to the others
    prints = classes.filter(F.col("size") >= SHARED).select("id", "fp")
    firsts = store(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    near = store(links(firsts.select("fp"), limit, group_rows), "near")
    side = lambda at, name: firsts.select(F.col("fp").alias(at), F.col("first").alias(name))
    asked = prints.join(firsts, "fp").filter("id != first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    asked = asked.unionByName(near.join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))

    roots = None
    counts = store(classes.select("id", "size", "bins", "odd", F.col("low.at").alias("at")), "counts")

    @F.pandas_udf("long")
    def at_most(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int64")
        table = lambda c: np.frombuffer(b"".join(c), np.uint8).reshape(len(c), BINS)
        return pd.Series(shared_at_most(table(a), table(b), np.minimum(x.to_numpy(np.int64), y.to_numpy(np.int64))))

    at_most = at_most.asNondeterministic()  # else it would run once for the filter and once for the column

    def fits(pairs: DataFrame, name: str) -> DataFrame:
        """(u, v, n) for the pairs that sizes and bin counts leave open, n what they can have in common."""
        of = lambda at, x: counts.select(F.col("id").alias(at), F.col("size").alias(f"s{x}"), F.col("bins").alias(f"b{x}"))
        both = pairs.join(of("u", "u"), "u").join(of("v", "v"), "v").filter(F.least("su", "sv") >= similar * F.greatest("su", "sv") - 1e-9)
        return store(both.withColumn("n", at_most("bu", "bv", "su", "sv")).filter(enough(F.col("n"), F.col("su"), F.col("sv"))).select("u", "v", "n"), name)

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of (u, v) that are similar, on the whole sets."""
        wanted = store(counts.select("id", "at").join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id"), "wanted")
        sets = _whole_sets(docs, key, wanted)
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        out = store(both.filter(shared >= F.lit(similar) * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v"), name)
        drop(sets, wanted)
        return out

    def join_up(new: DataFrame) -> DataFrame:
        """The roots after these links."""
        if roots is not None:
            if new.isEmpty():
                return roots
            new = new.unionByName(roots.select(F.col("rid").alias("u"), F.col("root").alias("v")))
        return store(components(new), "roots").select(F.col("id").alias("rid"), "root")

    def rooted(df: DataFrame, at: str, name: str) -> DataFrame:
        if roots is None:
            return df.withColumn(name, F.col(at))
        return df.join(roots.select(F.col("rid").alias(at), F.col("root").alias(name)), at, "left").withColumn(name, F.coalesce(name, at))

    def enough(shared: Column, a: Column, b: Column) -> Column:
        """Whether sets of sizes a and b can be similar with at most so many in common."""
        return shared >= F.lit(similar / (1 + similar)) * (a + b) - 1e-9

    def closest(turn: int) -> DataFrame:
        """Pairs (u, v) of a member of the largest component at a shingle with the member of another that shares most with it."""
        mine = rooted(tokens, "id", "root")
        members = mine.select("root", "id").distinct().groupBy("root").agg(F.count("*").alias("members"))
        mine = mine.join(members, "root") if turn else mine.withColumn("members", F.lit(1))
        first = lambda j: F.min(F.struct(-F.col("members"), F.xxhash64("root", F.lit(turn)).alias("o"), "root", F.xxhash64("id", F.lit(j)).alias("i"), "id", "size", "head"))
        several = range(PIVOTS if turn else 1)
        pivots = mine.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), *(first(j + PIVOTS * turn).alias(f"p{j}") for j in several)).filter("x != y")
        pivots = pivots.select("token", F.posexplode(F.array(*(f"p{j}" for j in several))).alias("j", "p"))
        pairs = mine.join(pivots, "token").filter("root != p.root").groupBy("root", "j", "id", F.col("p.id").alias("u")).agg(F.count("*").alias("n"), *(F.first(F.col(f"p.{c}")).alias(f"u{c}") for c in ("size", "head")), *(F.first(c).alias(c) for c in ("size", "head")))
        rest = F.greatest(F.col("size") - F.col("head"), F.col("usize") - F.col("uhead"))
        best = pairs.filter(enough(F.col("n") + rest, F.col("size"), F.col("usize"))).groupBy("root", "j").agg(F.max(F.struct("n", "u", "id")).alias("b"))
        return best.select("b.u", F.col("b.id").alias("v")).distinct()

    for turn in range(max(1, turns)):
        asked = asked.unionByName(closest(turn)) if turn == 0 and turns else closest(turn) if turn else asked
        roots = join_up(check(fits(asked, "open"), f"turn{turn}"))
    mine = store(rooted(tokens, "id", "root"), "mine")
    mixed = mine.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("token")
    some = mine.join(mixed, "token").join(counts.select("id", "odd"), "id")
    # a pair counts at the first shingle that both have: no shingle before it is common, so all that is common lies behind it in both
    behind = lambda part: F.col("pos") <= F.col("size") - F.ceil(F.lit(part) * F.col("size") - 1e-9)
    by_place = Window.partitionBy("id").orderBy("pos")
    some = some.withColumn("before", F.array_compact(F.array(*(F.lag("token", j).over(by_place) for j in range(1, BEFORE + 1)))))
    side = lambda x, at: (F.col("pos").alias(f"x{x}"), F.col("id").alias(at), F.col("size").alias(f"s{x}"), F.col("root").alias(f"r{x}"), F.col("before").alias(f"e{x}"), F.col("odd").alias(f"o{x}"))
    small = some.filter(behind(2 * similar / (1 + similar))).select("token", *side("u", "u"))
    large = some.filter(behind(similar)).select("token", *side("v", "v"))
    order = (F.col("su") < F.col("sv")) | ((F.col("su") == F.col("sv")) & (F.col("u") < F.col("v")))
    most = F.least(F.col("su") - F.col("xu"), F.col("sv") - F.col("xv"))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col("ou")[i].bitwiseXOR(F.col("ov")[i])) for i in range(BINS // 64)))
    alike = apart <= F.lit((1 - similar) / (1 + similar)) * (F.col("su") + F.col("sv")) + 1e-9
    met = small.join(large, "token").filter(order & (F.col("ru") != F.col("rv")) & (F.col("su") >= similar * F.col("sv") - 1e-9) & enough(most, F.col("su"), F.col("sv")) & alike & ~F.arrays_overlap("eu", "ev"))
    met = met.select("u", "v").distinct()
    left = fits(met, "left")
    apart = rooted(rooted(left, "u", "ru"), "v", "rv")
    first = apart.groupBy(F.least("ru", "rv").alias("x"), F.greatest("ru", "rv").alias("y")).agg(F.max(F.struct("n", "u", "v")).alias("p")).select("p.u", "p.v")
    roots = join_up(check(first, "first"))
    apart = rooted(rooted(left, "u", "ru"), "v", "rv").filter("ru != rv")
    roots = join_up(check(apart.select("u", "v"), "last"))

    labels = rooted(classes.select("id", "digest", "low"), "id", "root")
    lowest = labels.groupBy("root").agg(F.min("low").alias("best"))
    labels = labels.join(lowest, "root").select("digest", F.col("best.doc_id").alias("component_id"), F.col("best.at").alias("keep"))
    out = store(rows.select(key, "doc_id", "digest").join(labels, "digest").select(key, "doc_id", "component_id", "keep"), "groups")
    drop(rows, classes, counts, often, tokens, mine, firsts, near, left)
    return out


def near_groups(docs: DataFrame, similar: float = SIMILAR, limit: int = LIMIT, group_rows: int = GROUP_ROWS, turns: int = TURNS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id joined to it, for every row; see ``near_rows``."""
    rows = store(docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "rows")
    return near_rows(rows, "uid", similar, limit, group_rows, turns).select("doc_id", "component_id")
