"""Communities: weighted degrees, modularity, Louvain, statistics and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.shared import drop, store


def symmetrise(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Directed edges to (u, v, w) with both directions summed; a loop stands once."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), F.coalesce(F.col(weight), F.lit(0.5)).cast("double").alias("w"))
    return e.unionByName(e.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def weighted_degree(pairs: DataFrame) -> DataFrame:
    """Sum of weights at each node; a loop counts twice."""
    return pairs.groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("degree"))


def sigma_tot(degrees: DataFrame, membership: DataFrame) -> DataFrame:
    """Total degree of each community."""
    return degrees.join(membership, degrees["u"] == membership["node"]).groupBy("community").agg(F.sum("degree").alias("sigma_tot"))


def neighbour_weights(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Weight from each node into each community next to it, without loops."""
    side = membership.select(F.col("node").alias("v"), "community")
    return pairs.filter("u <> v").join(side, "v").groupBy("u", "community").agg(F.sum("w").alias("weight"))


def super_edges(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Pairs summed by community, in the same two-way form; weight inside a community becomes its loop."""
    a, b = (membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("u", "v"))
    inner = F.when((F.col("cu") == F.col("cv")) & (F.col("u") != F.col("v")), F.col("w") / 2).otherwise(F.col("w"))
    return pairs.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum(inner).alias("w"))


def modularity(pairs: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: ``q``, the standard sum over communities, and ``q_adjacent``, over adjacent pairs alone."""
    degrees = weighted_degree(pairs)
    total = degrees.agg(F.sum("degree").alias("m2"))
    a = degrees.join(membership, degrees["u"] == membership["node"]).select("u", F.col("degree").alias("ku"), F.col("community").alias("cu"))
    b = a.select(F.col("u").alias("v"), F.col("ku").alias("kv"), F.col("cu").alias("cv"))
    inside = pairs.join(a, "u").join(b, "v").filter("cu = cv")
    loop = F.when(F.col("u") == F.col("v"), 2.0).otherwise(1.0)
    adjacent = inside.join(F.broadcast(total)).agg(F.sum(F.col("w") * loop).alias("inner"), F.sum((F.col("w") - gamma * F.col("ku") * F.col("kv") / F.col("m2")) / F.col("m2")).alias("q_adjacent"))
    expected = a.groupBy("cu").agg(F.sum("ku").alias("s")).join(F.broadcast(total)).agg(F.sum(gamma * F.col("s") * F.col("s") / (F.col("m2") * F.col("m2"))).alias("expected"))
    joined = adjacent.join(expected).join(total)
    return joined.select((F.coalesce("inner", F.lit(0.0)) / F.col("m2") - F.col("expected")).alias("q"), F.coalesce("q_adjacent", F.lit(0.0)).alias("q_adjacent"))


def _level(pairs: DataFrame, gamma: float, rounds: int, tolerance: float) -> tuple[DataFrame, bool]:
    """Local moves: in each round the nodes of one hash class move to their best neighbouring community; a round stands only if modularity rises."""
    degrees = store(weighted_degree(pairs), "degrees")
    m2 = degrees.agg(F.sum("degree")).first()[0]
    membership = store(degrees.select(F.col("u").alias("node"), F.col("u").alias("community")), "membership")
    q, moved, idle = modularity(pairs, membership, gamma).first()["q"], False, 0
    for turn in range(rounds):
        tot = sigma_tot(degrees, membership)
        mine = membership.select(F.col("node").alias("u"), F.col("community").alias("old")).join(degrees, "u")
        near = neighbour_weights(pairs, membership).join(mine, "u").join(tot, "community")
        others = F.col("sigma_tot") - F.when(F.col("community") == F.col("old"), F.col("degree")).otherwise(0.0)
        gain = F.col("weight") - gamma * others * F.col("degree") / m2
        scored = near.select("u", "community", "old", "degree", gain.alias("gain"))
        stay = mine.join(tot, mine["old"] == tot["community"]).select("u", F.col("old").alias("community"), "old", "degree", (-gamma * (F.col("sigma_tot") - F.col("degree")) * F.col("degree") / m2).alias("gain"))
        both = scored.unionByName(stay).groupBy("u", "community", "old").agg(F.max("gain").alias("gain"))
        best = both.groupBy("u").agg(F.max_by("gain", F.col("community") == F.col("old")).alias("here"), F.min(F.struct(-F.col("gain"), "community")).alias("best"))
        going = best.filter((-F.col("best.col1") > F.col("here") + tolerance) & (F.pmod(F.xxhash64("u"), F.lit(2)) == turn % 2)).select(F.col("u").alias("node"), F.col("best.community").alias("target"))
        new = store(membership.join(going, "node", "left").select("node", F.coalesce("target", "community").alias("community")), "membership")
        new_q = modularity(pairs, new, gamma).first()["q"]
        if new_q > q + tolerance:
            drop(membership)
            membership, q, moved, idle = new, new_q, True, 0
        else:
            drop(new)
            idle += 1
            if idle == 2:
                break
    return membership, moved


def louvain(edges: DataFrame, gamma: float = 1.0, max_levels: int = 10, rounds: int = 12, tolerance: float = 1e-6, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(node, community): levels of local moves and aggregation, composed; a community is named by a node of it."""
    pairs = store(symmetrise(edges, src, dst, weight), "pairs")
    if pairs.isEmpty():
        raise ValueError("no edges")
    whole = None
    for _ in range(max_levels):
        membership, moved = _level(pairs, gamma, rounds, tolerance)
        step = membership.select(F.col("node").alias("community"), F.col("community").alias("up"))
        whole = membership if whole is None else store(whole.join(step, "community").select("node", F.col("up").alias("community")), "whole")
        if not moved:
            break
        pairs = store(super_edges(pairs, membership), "pairs")
    least = whole.groupBy("community").agg(F.min("node").alias("name"))
    return whole.join(least, "community").select("node", F.col("name").alias("community"))


def community_stats(membership: DataFrame, pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """(community, size, cohesion, label), largest first; cohesion is the share of a community's edge weight that stays inside."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    a, b = (membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("u", "v"))
    same = F.col("cu") == F.col("cv")
    ties = pairs.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("community")).agg(F.sum(F.when(same & (F.col("u") != F.col("v")), F.col("w") / 2).when(same, F.col("w")).otherwise(0.0)).alias("inner"), F.sum(F.when(~same, F.col("w")).otherwise(0.0)).alias("outer"))
    labels = dominant_labels(membership)
    whole = F.col("inner") + F.col("outer")
    cohesion = F.when(whole > 0, F.col("inner") / whole).otherwise(0.0)
    joined = sizes.join(ties, "community", "left").join(labels, "community", "left")
    return joined.select("community", "size", F.coalesce(cohesion, F.lit(0.0)).alias("cohesion"), F.coalesce("dominant_label", F.lit("Misc")).alias("dominant_label")).orderBy(F.desc("size"), "community")


def dominant_labels(membership: DataFrame) -> DataFrame:
    """The two commonest identifier tokens of a community's members, capitalised and joined; ties in order of the token."""
    tokens = membership.select("community", F.explode(T.identifier_tokens(T.strip_prefix(F.col("node")))).alias("token"))
    counts = tokens.groupBy("community", "token").agg(F.count("*").alias("n"))
    place = Window.partitionBy("community").orderBy(F.desc("n"), "token")
    top = counts.withColumn("r", F.row_number().over(place)).filter("r <= 2")
    pair = F.array_sort(F.collect_list(F.struct("r", T.capitalize(F.col("token")).alias("t"))))
    return top.groupBy("community").agg(F.array_join(F.transform(pair, lambda x: x["t"]), "").alias("dominant_label"))


def community_graph(stats: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Community nodes, and MemberOf edges of the communities that have a node."""
    cid = F.concat(F.lit("Community:"), "community")
    nodes = stats.select(cid.alias("id"), F.lit("Community").alias("label"), F.col("dominant_label").alias("name"), "cohesion", F.col("size").cast("int").alias("symbol_count"))
    kept = membership.join(stats.select("community"), "community", "left_semi")
    return nodes, kept.select(F.col("node").alias("src"), cid.alias("dst"), F.lit("MemberOf").alias("rel_table"), F.lit(1.0).alias("confidence"))


def renumber(membership: DataFrame) -> DataFrame:
    """(node, community, number): communities numbered from 0 by their least node.

    One row a community enters the window without partitions.
    """
    first = membership.groupBy("community").agg(F.min("node").alias("least"))
    number = (F.row_number().over(Window.orderBy("least")) - 1).cast("long").alias("number")
    return membership.join(first.select("community", number), "community").select("node", "community", "number")
