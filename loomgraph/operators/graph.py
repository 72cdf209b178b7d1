"""Property-graph tables: building, upserts, name resolution, export and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.functions import text as T

#: Fixed values of a picture of the graph.
SIZES = {"File": 3, "Folder": 4, "Function": 2, "Class": 5, "Interface": 4, "Method": 2, "Community": 8, "Process": 6}
COLORS = {
    "File": "#60a5fa", "Folder": "#94a3b8", "Function": "#34d399", "Class": "#f472b6", "Interface": "#a78bfa", "Method": "#2dd4bf",
    "Struct": "#fbbf24", "Enum": "#fb923c", "Community": "#ef4444", "Process": "#8b5cf6",
}


def upsert_nodes(raw: DataFrame, seq: str = "seq", keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """One row per key: for each property the last value that was supplied, in order of ``seq``.

    ``max_by`` over non-null values is combined on the map side, so a hot key
    reaches its reducer as one row per task.
    """
    props = [c for c in raw.columns if c not in (*keys, seq)]
    return raw.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in props])


def upsert_edges(raw: DataFrame, nodes: DataFrame | None = None, seq: str = "seq", keys: tuple[str, ...] = ("src", "rel_table", "dst")) -> DataFrame:
    """At most one edge for each (src, table, dst), its properties the last supplied; edges without both ends go."""
    out = upsert_nodes(raw, seq, keys)
    if nodes is not None:
        ids = nodes.select("id").distinct()
        out = out.join(ids, out["src"] == ids["id"], "left_semi").join(ids, out["dst"] == ids["id"], "left_semi")
    return out


def merge_into(current: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """A stored node table with changes applied: properties that a change does not supply survive."""
    old = current.withColumn("seq", F.lit(-1).cast("long"))
    return upsert_nodes(old.unionByName(changes, allowMissingColumns=True), "seq", keys)


def symbol_index(symbols: DataFrame) -> DataFrame:
    """name to the id of the last symbol of that name."""
    return symbols.groupBy("name").agg(F.max_by("id", "seq").alias("id"))


def resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (src, target) to (src, dst) by exact name."""
    index = symbol_index(symbols).withColumnRenamed("name", "target").withColumnRenamed("id", "dst")
    return calls.join(index, "target").select("src", "dst")


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with the innermost symbol of its file whose lines hold it (null at top level): an equi-join on file, bounds as a filter, no cross product."""
    spans = symbols.select(F.col("file_path").alias("f"), F.col("id").alias("caller"), "start_line", "end_line")
    inside = (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    joined = calls.withColumn("call_ord", F.monotonically_increasing_id()).join(spans, inside, "left")
    by = [c for c in (*calls.columns, "call_ord")]
    best = joined.groupBy(*by).agg(F.max_by("caller", F.struct("start_line", -F.col("end_line"), "caller")).alias("caller"))
    return best.drop("call_ord")


def build(parsed: DataFrame, caller_scope: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Parsed files to (nodes, edges): files, symbols and modules; Defines 1.0, IMPORTS 0.9, CALLS 0.8."""
    files = parsed.filter("error IS NULL").withColumn("ford", F.col("file_path"))
    seq = F.struct("ford", F.col("pos").cast("long"))  # files in order of path, then symbols in order of place
    symbols = files.select("file_path", "ford", F.posexplode("symbols").alias("pos", "s")).select("file_path", seq.alias("seq"), "s.id", "s.name", T.kind_label(F.col("s.kind")).alias("label"), "s.start_line", "s.end_line", "s.content", "s.is_exported", "s.parameter_count", "s.return_type")
    imports = files.select("file_path", "ford", F.posexplode("imports").alias("pos", "i")).select("file_path", seq.alias("seq"), F.replace("i.source", F.lit("'"), F.lit("")).alias("name"))
    calls = files.select("file_path", F.explode("calls").alias("c")).select("file_path", "c.target", "c.line")
    blank = lambda **k: [v.alias(n) for n, v in k.items()]
    zero = F.struct(F.col("ford"), F.lit(-1).cast("long").alias("pos"))
    file_nodes = files.select(F.lit("File").alias("label"), F.concat(F.lit("File:"), "file_path").alias("id"), zero.alias("seq"), *blank(name=T.basename(F.col("file_path")), file_path=F.col("file_path")))
    module_nodes = imports.select(F.lit("Module").alias("label"), F.concat(F.lit("Module:"), "name").alias("id"), "seq", "name", F.lit("").alias("file_path"))
    raw = file_nodes.unionByName(symbols, allowMissingColumns=True).unionByName(module_nodes, allowMissingColumns=True)
    nodes = upsert_nodes(raw)

    def edge(df: DataFrame, src: Column, dst: Column, table: str, kind: str | None, confidence: float, order: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(table).alias("rel_table"), F.lit(kind).cast("string").alias("type"), F.lit(confidence).alias("confidence"), order.alias("seq"))

    file_id = F.concat(F.lit("File:"), "file_path")
    step = lambda n: F.lit(n).cast("int")  # noqa: E731  later kinds overwrite earlier ones
    defines = edge(symbols, file_id, F.col("id"), "Defines", None, 1.0, step(0))
    imported = edge(imports, file_id, F.concat(F.lit("Module:"), "name"), "CodeRelation", "IMPORTS", 0.9, step(1))
    placed = enclosing(calls, symbols) if caller_scope == "symbol" else calls.withColumn("caller", F.lit(None).cast("string"))
    resolved = resolve(placed.select(F.coalesce("caller", file_id).alias("src"), "target"), symbols)
    called = edge(resolved, F.col("src"), F.col("dst"), "CodeRelation", "CALLS", 0.8, step(2))
    return nodes, upsert_edges(defines.unionByName(imported).unionByName(called), nodes)


def build_counts(parsed: DataFrame) -> DataFrame:
    """files, nodes and edges as merges: files and symbols, Defines and IMPORTS."""
    good = parsed.filter("error IS NULL")
    s, i = F.sum(F.size("symbols")), F.sum(F.size("imports"))
    return good.agg(F.count("*").alias("files"), (F.count("*") + F.coalesce(s, F.lit(0))).alias("nodes"), (F.coalesce(s, F.lit(0)) + F.coalesce(i, F.lit(0))).alias("edges"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with name and label of both ends; type defaults to CALLS, confidence to 0.5."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("source_name"), F.col("label").alias("source_type"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("target_name"), F.col("label").alias("target_type"))
    return edges.withColumn("type", F.coalesce("type", F.lit("CALLS"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).join(a, "src").join(b, "dst")


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and CodeRelation edges as one table of (kind, id, body), the body as JSON: ready for a distributed JSON write."""
    picked = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", "label", F.struct(*[c for c in ("name", "file_path", "start_line", "end_line") if c in nodes.columns]).alias("properties"))).alias("body"))
    rel = edges.filter("rel_table = 'CodeRelation'").withColumn("id", F.concat_ws("_", "src", "dst"))
    rel = rel.select(F.lit("edge").alias("kind"), "id", F.to_json(F.struct("id", F.col("src").alias("sourceId"), F.col("dst").alias("targetId"), F.coalesce("type", F.lit("CALLS")).alias("type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))).alias("body"))
    return picked.unionByName(rel)


def picture(nodes: DataFrame) -> DataFrame:
    """Nodes with the size and colour of their label."""
    pick = lambda d, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("label")), F.lit(other))
    return nodes.select("id", "label", F.coalesce("name", "id").alias("name"), pick(SIZES, 2).alias("val"), pick(COLORS, "#94a3b8").alias("color"))


def folders(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder nodes and Contains edges from file paths."""
    parts = F.split("path", "/")
    up = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).filter("n >= 1 AND n < size(split(path, '/'))")
    names = up.select(F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("n")), "/").alias("file_path")).distinct()
    nodes = names.select(F.concat(F.lit("Folder:"), "file_path").alias("id"), F.lit("Folder").alias("label"), T.basename(F.col("file_path")).alias("name"), "file_path")
    inside = files.filter(F.contains("path", F.lit("/"))).select(F.concat(F.lit("Folder:"), F.regexp_replace("path", "/[^/]*$", "")).alias("src"), F.concat(F.lit("File:"), "path").alias("dst"), F.lit("Contains").alias("rel_table"))
    return nodes, inside


def context(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 10, processes: DataFrame | None = None) -> DataFrame:
    """What points at a node and what it points at, the first ``limit`` of each, and the flows it is a step of."""
    ends = nodes.select(F.col("id").alias("other"), "name", "label")
    out = []
    for direction, here, there in (("incoming", "dst", "src"), ("outgoing", "src", "dst")):
        near = edges.filter(F.col(here) == node_id).select(F.lit(direction).alias("direction"), F.col(there).alias("other"), F.coalesce("type", F.lit("CALLS")).alias("type"))
        out.append(near.join(ends, "other"))
    if processes is not None:
        mine = processes.filter(F.col("node") == node_id)
        out.append(mine.select(F.col("process_id").alias("other"), F.lit("process").alias("direction"), F.concat(F.lit("Step "), "step", F.lit(" of "), "step_count").alias("type"), F.col("process_id").alias("name"), F.lit("Process").alias("label")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    place = Window.partitionBy("direction").orderBy("other", "type")
    return every.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def index_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda label: F.count(F.when(F.col("label") == label, 1))
    n = nodes.agg(count("File").alias("files"), F.count("*").alias("nodes"), count("Community").alias("communities"), count("Process").alias("processes"))
    return n.join(edges.agg(F.count("*").alias("edges")))


def file_hashes(files: DataFrame) -> DataFrame:
    return files.filter("content IS NOT NULL AND NOT is_directory").select("path", hashing.hash_file(F.col("path"), F.col("content")).alias("hash"))
