"""Level-synchronous traversal: execution flows and change impact.

Each level is one join of the frontier with the edges. What has been seen is
written once a level, which cuts lineage; only a count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.shared import drop, store


def impact(edges: DataFrame, targets: DataFrame, direction: str = "upstream", max_depth: int = 3) -> DataFrame:
    """(start, node, depth) of all that is reached within ``max_depth``, each at its least depth; the starts themselves are left out."""
    if direction not in ("upstream", "downstream"):
        raise ValueError("direction is upstream or downstream")
    here, there = ("dst", "src") if direction == "upstream" else ("src", "dst")
    step = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    seen = store(targets.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1)
        new = front.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        new = store(new.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if new.isEmpty():
            break
        grown = store(seen.unionByName(new), "reached")
        drop(seen, new)
        seen = grown
    return seen.filter("depth > 0")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge whose label or name makes them entry points."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi").filter(T.is_entry_point(F.col("label"), F.col("name")))


def processes(edges: DataFrame, entries: DataFrame, max_depth: int = 10, min_confidence: float = 0.5, max_steps: int = 50, min_steps: int = 2) -> DataFrame:
    """Execution flows from each entry, as steps (entry, node, step, depth, parent, confidence, terminal).

    Breadth first, in the order of a queue: a node is seen where it is first
    queued, by the earliest parent and that parent's first edge (by dst, type).
    Nodes without any outgoing edge are terminals. All entries advance together.
    """
    usable = edges.filter(F.coalesce("confidence", F.lit(0.5)) >= min_confidence)
    order = Window.partitionBy("src").orderBy("dst", F.col("type").asc_nulls_first())
    step = store(usable.select("src", "dst", F.row_number().over(order).alias("edge_ord")), "steps")
    start = entries.select(F.col("id").alias("entry")).distinct()
    seen = store(start.select("entry", F.col("entry").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ord"), F.lit(None).cast("string").alias("parent")), "flow")
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1).select("entry", F.col("node").alias("src"), F.col("ord").alias("parent_ord"))
        found = front.join(step, "src").groupBy("entry", F.col("dst").alias("node")).agg(F.min(F.struct("parent_ord", "edge_ord", F.col("src").alias("parent"))).alias("by"))
        found = found.join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        upto = seen.groupBy("entry").agg(F.max("ord").alias("base"))
        place = Window.partitionBy("entry").orderBy("by.parent_ord", "by.edge_ord")
        new = found.join(upto, "entry").withColumn("ord", F.col("base") + F.row_number().over(place)).filter(F.col("ord") <= max_steps)
        new = store(new.select("entry", "node", F.lit(depth).alias("depth"), "ord", F.col("by.parent").alias("parent")), "level")
        if new.isEmpty():
            break
        grown = store(seen.unionByName(new), "flow")
        drop(seen, new)
        seen = grown
    leaving = edges.select(F.col("src").alias("node")).distinct().withColumn("leaves", F.lit(True))
    long = seen.groupBy("entry").agg(F.count("*").alias("step_count")).filter(F.col("step_count") >= min_steps)
    return seen.join(leaving, "node", "left").join(long, "entry").select(
        "entry", T.process_id(F.col("entry")).alias("process_id"), "node", F.col("ord").alias("step"), "depth", "parent", (F.lit(1.0) - F.col("depth") * 0.05).alias("confidence"), F.col("leaves").isNull().alias("terminal"), "step_count"
    )


def process_nodes(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """One Process row per flow: name, type, entry, first terminal (or ''), and number of steps."""
    flows = steps.groupBy("entry", "process_id").agg(F.max("step_count").alias("step_count"), F.coalesce(F.min_by("node", F.when(F.col("terminal"), F.col("step"))), F.lit("")).alias("terminal_id"))
    named = flows.join(nodes.select(F.col("id").alias("entry"), "name", F.col("label").alias("kind")), "entry", "left")
    name, kind = F.coalesce("name", "entry"), F.coalesce("kind", F.lit("Unknown"))
    return named.select(F.col("process_id").alias("id"), F.lit("Process").alias("label"), name.alias("name"), T.process_type(kind, name).alias("process_type"), "step_count", F.col("entry").alias("entry_point_id"), "terminal_id")


def first_meta(rows: DataFrame) -> DataFrame:
    """(id, name, type, seq) to the name and type each id was first seen with."""
    return rows.groupBy("id").agg(F.min_by(F.struct("name", "type"), "seq").alias("m")).select("id", "m.name", "m.type")


def step_meta(steps: DataFrame, meta: DataFrame) -> DataFrame:
    """Steps with the name and type of their node; "unknown" and "CodeElement" where it has none."""
    known = meta.select(F.col("id").alias("node"), F.col("name").alias("node_name"), F.col("type").alias("node_type"))
    joined = steps.join(known, "node", "left")
    return joined.withColumn("node_name", F.coalesce("node_name", F.lit("unknown"))).withColumn("node_type", F.coalesce("node_type", F.lit("CodeElement")))


def process_edges(steps: DataFrame) -> DataFrame:
    into = steps.filter("step = 1").select(F.col("entry").alias("src"), F.col("process_id").alias("dst"), F.lit("EntryPointOf").alias("rel_table"), F.lit(None).cast("int").alias("step"), F.lit(1.0).alias("confidence"))
    return into.unionByName(steps.select(F.col("node").alias("src"), F.col("process_id").alias("dst"), F.lit("StepInProcess").alias("rel_table"), F.col("step").cast("int"), "confidence"))
