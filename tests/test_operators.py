import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph import shared
from loomgraph.functions import vector as V
from loomgraph.operators import community, graph, incremental, parse, search, traverse
from loomgraph.plans import cypher, registry
from loomgraph.sources import files
from loomgraph.streaming import watch


def test_knn(spark):
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", [-1.0, 0.0]), ("D", [1.0, 1.0]), ("E", [0.0, 0.0]), ("F", [])], "node_id string, embedding array<float>")
    got = [(r["node_id"], round(r["distance"], 6)) for r in search.knn(v, [1.0, 0.0], 9).collect()]
    assert got == [("A", 0.0), ("D", 0.292893), ("B", 1.0), ("E", 1.0), ("C", 2.0)]
    assert search.knn(v, [0.0, 0.0], 9).count() == 0


def test_knn_batch_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5), 1.0]) for i in range(60)], "node_id long, embedding array<double>").repartition(3)
    queries = v.filter("node_id % 5 < 2").select((F.col("node_id") % 20).alias("query_id"), "embedding").repartition(3)  # ids that repeat
    whole = search.knn_batch(v, queries, 4)
    for size in (1, 5, 24):
        assert sorted(map(tuple, search.knn_batch(v, queries, 4, max_queries=size).collect())) == sorted(map(tuple, whole.collect()))


def test_knn_batch_against_all_pairs(spark, tmp_path):
    dice = random.Random(3)
    point = lambda: [dice.gauss(0, 1) for _ in range(9)]
    near, far = point(), [1e200] * 9
    rows = [(i, point()) for i in range(900)] + [(i, [x * (1 + i / 7) for x in near]) for i in range(900, 1300)]  # one direction, other lengths
    rows += [(1300, [0.0] * 9), (1301, []), (1302, None), (1303, near[:4]), (1304, [*near, 2.0]), (1305, [None, *near[1:]]), (1306, [float("nan")] * 9), (1307, far), (1350, [1e-200] * 9)]
    dice.shuffle(rows)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = v.filter("size(embedding) > 0").join(queries.filter(V.l2_norm(F.col("embedding")) > 0).withColumnRenamed("embedding", "q"))
    pairs = pairs.select("query_id", "vec_id", V.cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))
    for digits in (None, 9):
        order = F.col("distance") if digits is None else F.round("distance", digits)
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))).filter("rank <= 6")
        got = search.knn_batch(v, queries, 6, "vec_id", digits=digits)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().toString()  # a row for each pair took 1 GB over its time
    v.filter("vec_id < 1300").write.parquet(str(tmp_path / "embeddings.parquet"))  # distances that agree to nine digits are ties in SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(registry.ORACLE_SQL["vector_topk_batch"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["vector_topk_batch"](spark, str(tmp_path)).collect())) == sorted(want)


def test_rrf(spark):
    ranks = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "node_id string, rank int")
    got = [(r["node_id"], round(r["score"], 9), r["sources"]) for r in search.rrf(ranks("abc"), ranks("bd"), 10).collect()]
    assert got == [("b", 0.032522475, "bm25,semantic"), ("a", 0.016393443, "bm25"), ("d", 0.016129032, "semantic"), ("c", 0.015873016, "bm25")]
    assert search.rrf(ranks(""), ranks("aa"), 10).first()["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_upserts(spark):
    raw = spark.createDataFrame([("Function", "Function:x", "a.ts", 1, "A", 0), ("Function", "Function:x", "b.ts", 5, None, 1)], "label string, id string, file_path string, start_line int, content string, seq long")
    assert graph.upsert_nodes(raw).drop("label", "id").first() == ("b.ts", 5, "A")
    e = spark.createDataFrame([("f", "CodeRelation", "m", "IMPORTS", 0.9, 0), ("f", "CodeRelation", "m", "CALLS", 0.8, 1), ("f", "CodeRelation", "gone", "CALLS", 0.8, 2)], "src string, rel_table string, dst string, type string, confidence double, seq int")
    nodes = spark.createDataFrame([("f",), ("m",)], "id string")
    assert [tuple(r) for r in graph.upsert_edges(e, nodes).select("src", "dst", "type", "confidence").collect()] == [("f", "m", "CALLS", 0.8)]


def test_diff(spark):
    h = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    got = {r["path"]: r["status"] for r in incremental.diff(h({"a": "1", "b": "2", "d": "4"}), h({"a": "1", "b": "9", "c": "3"})).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "CALLS", c) for a, b, c in rows], "src string, dst string, type string, confidence double")


def test_flow_order(spark):
    e = edges(spark, [("main", "a", 0.9), ("main", "b", 0.8), ("a", "c", 0.4), ("b", "c", 0.7), ("b", "d", 0.6), ("c", "main", 1.0)])
    steps = traverse.processes(e, spark.createDataFrame([("main",)], "id string"))
    got = [(r["node"], r["depth"], round(r["confidence"], 2), r["parent"], r["terminal"]) for r in steps.orderBy("step").collect()]
    assert got == [("main", 0, 1.0, None, False), ("a", 1, 0.95, "main", False), ("b", 1, 0.95, "main", False), ("c", 2, 0.9, "b", False), ("d", 2, 0.9, "b", True)]
    assert traverse.processes(e, spark.createDataFrame([("nowhere",)], "id string")).count() == 0
    nodes = spark.createDataFrame([("main", "main", "Function")], "id string, name string, label string")
    flow = traverse.process_nodes(steps, nodes).first()
    assert (flow["terminal_id"], flow["step_count"]) == ("d", 5)


def queue_model(rows, entry, depth, least, most):
    out, seen, queue = [], {entry}, [(entry, 0)]
    while queue and len(out) < most:
        node, d = queue.pop(0)
        if d > depth:
            continue
        out.append(node)
        for b in sorted(b for a, b, c in rows if a == node and c >= least):
            if b not in seen:
                seen.add(b)
                queue.append((b, d + 1))
    return out


def test_flow_against_a_queue(spark):
    dice = random.Random(5)
    rows = sorted({(f"n{dice.randrange(12)}", f"n{dice.randrange(12)}"): dice.random() for _ in range(40)}.items())
    rows = [(a, b, c) for (a, b), c in rows]
    entries = spark.createDataFrame([("n0",), ("n3",)], "id string")
    got = traverse.processes(edges(spark, rows), entries, 3, 0.3, 7, 1).orderBy("entry", "step").collect()
    for entry in ("n0", "n3"):
        assert [r["node"] for r in got if r["entry"] == entry] == queue_model(rows, entry, 3, 0.3, 7)


def test_impact(spark):
    e = edges(spark, [("s1", "s2", 1.0), ("s2", "s3", 1.0), ("s3", "s4", 1.0), ("s4", "s5", 1.0), ("s5", "s4", 1.0)])
    got = {r["node"]: r["depth"] for r in traverse.impact(e, spark.createDataFrame([("s5",)], "id string")).collect()}
    assert got == {"s4": 1, "s3": 2, "s2": 3}
    with pytest.raises(ValueError):
        traverse.impact(e, e, "sideways")


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def test_louvain_and_modularity(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], "src string, dst string, weight double")
    found = community.louvain(e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]]
    q = community.modularity(community.symmetrise(e), found).first()
    assert (round(q["q"], 6), round(q["q_adjacent"], 6)) == (0.357143, 0.530612)


def test_dominant_label(spark):
    members = spark.createDataFrame([(1, "Function:doLogin"), (1, "Function:loginUser"), (1, "Function:login_check")], "community int, node string")
    assert community.dominant_labels(members).first()["dominant_label"] == "LoginCheck"


def test_parse_build_and_files(spark, tmp_path):
    (tmp_path / "pkg" / "dist").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_text("import os\nclass A:\n    def m(self):\n        return helper(1)\ndef helper(x):\n    return x\n")
    (tmp_path / "pkg" / "dist" / "b.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "c.py").write_text("def (\n")
    tree = files.read_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in tree.select("path").collect()) == ["pkg/a.py", "pkg/c.py"]
    parsed = parse.parse(files.for_parsing(tree))
    assert parsed.filter("error IS NOT NULL").count() == 1
    nodes, made = graph.build(parsed)
    assert sorted(r["id"] for r in nodes.collect()) == ["Class:A", "File:pkg/a.py", "Function:helper", "Method:m", "Module:import os"]
    assert {(r["src"], r["dst"]) for r in made.filter("type = 'CALLS'").collect()} == {("Method:m", "Function:helper")}
    by_file = graph.build(parsed, "file")[1]
    assert {(r["src"], r["dst"]) for r in by_file.filter("type = 'CALLS'").collect()} == {("File:pkg/a.py", "Function:helper")}
    files.save_snapshot({"nodes": nodes}, str(tmp_path / "snap"), "one")
    files.save_snapshot({"nodes": nodes.limit(1)}, str(tmp_path / "snap"), "two")
    assert files.load_snapshot(spark, str(tmp_path / "snap"), "one", "nodes").count() == 5
    files.delete_snapshot(spark, str(tmp_path / "snap"), "two", ["nodes"])
    assert [r["repo"] for r in files.list_repos(spark, str(tmp_path / "snap")).collect()] == ["one"]


def test_cypher_parameters(spark):
    sql, values = cypher.translate("MATCH (n {name: 'it''s'}) RETURN n.id AS id LIMIT 3")
    assert values == {"p0": "it's"} and sql.endswith("LIMIT 3")
    with pytest.raises(ValueError):
        cypher.translate("DELETE everything")


def test_watch(spark, tmp_path):
    spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("dist/c.py", "3")], "path string, content string").write.parquet(str(tmp_path / "in"))
    stored = files.from_pairs(spark, [("a.py", "1")])
    hashes = graph.file_hashes(stored)
    seen = []
    query = watch.watch_files(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda: hashes, lambda df, n: seen.extend(r["path"] for r in df.collect()))
    query.awaitTermination(120)
    assert seen == ["b.py"]


def test_sessions(spark):
    ev = spark.createDataFrame([(1, "2026-01-01 00:00:00", "x", 1.0), (1, "2026-01-01 00:10:00", "x", 1.0), (1, "2026-01-01 02:00:00", "x", 1.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in watch.event_sessions(ev).collect()) == [1, 2]


def test_parser_is_quick_on_hostile_lines_and_gives_up_in_time():
    import time

    from loomgraph.operators import parse

    for hard in ("*" * 10_000, "a " * 10_000, "int " + "*&" * 5_000, "{" * 10_000):
        for language in ("c", "cpp", "csharp", "java"):
            began = time.perf_counter()
            assert len(parse.parse_file("x", language, hard)) == 6 and time.perf_counter() - began < 3
    found = parse.parse_file("x.c", "c", "static int *const f(int a)\n{\n  if (a) { g(a); }\n  return 1;\n}\n")
    assert [(x[1], x[2]) for x in found[2]] == [("f", "Function")] and found[4] == [("g", 3)]
    slow = parse.parse_file("x.c", "c", "int f(a)\n" * 20_000, seconds=0.001)
    assert slow[-1].startswith("TimeoutError")


def test_equal_calls_on_one_line_stay_apart(spark):
    calls = spark.createDataFrame([("a.py", "g", 3)] * 2 + [("a.py", "g", 9)], "file_path string, target string, line int")
    symbols = spark.createDataFrame([("a.py", "F:f", 1, 5)], "file_path string, id string, start_line int, end_line int")
    assert sorted(str(r["caller"]) for r in graph.enclosing(calls, symbols).collect()) == ["F:f", "F:f", "None"]


def test_state_and_key_values(spark, tmp_path):
    from loomgraph.sources import files

    root = f"file://{tmp_path}"
    assert files.load_state(spark, root, "r").count() == 0
    files.save_state(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string"), root, "r")
    files.save_state(spark.createDataFrame([("a", "9")], "path string, hash string"), root, "s")
    assert sorted(map(tuple, files.load_state(spark, root, "r").collect())) == [("a", "1"), ("b", "2")]
    kv = files.KeyValues(spark, f"{root}/kv")
    assert kv.get("n", "x") is None
    kv.put("n", spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string"))
    kv.put("n", spark.createDataFrame([("x", "3")], "key string, value string"))
    assert (kv.get("n", "x"), kv.get("n", "y"), kv.get("m", "x")) == ("3", "2", None)
    kv.delete("n", "x")
    kv.delete("n", "y")
    assert kv.get_all("n").count() == 0


def test_store_hands_back_the_drivers_memory(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    monkeypatch.setattr(shared, "_relieved", float("-inf"))
    assert shared.store(spark.range(3), "few").count() == 3
    assert shared._relieved > 0
