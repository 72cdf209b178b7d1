"""All registered queries of the engine over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.functions import text as T
from loomgraph.functions import vector as V
from loomgraph.operators import community, embed, graph, incremental, parse, search, tokenize, traverse
from loomgraph.plans import cypher
from loomgraph.sources import files as source_files
from loomgraph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORD = "the"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# Search


@query("SELECT page_id, url FROM pages WHERE contains(url, 'ref=x') OR contains(html, 'ref=x') ORDER BY page_id LIMIT 10")
def search_name_path(spark, sf):
    return search.contains_search(t(spark, sf, "pages"), "ref=x", ["url", "html"], "page_id", 10).select("page_id", "url")


@query("SELECT doc_id FROM documents WHERE contains(text, 'edthe') OR contains(source, 'edthe') ORDER BY doc_id LIMIT 20")
def search_content(spark, sf):
    return search.contains_search(t(spark, sf, "documents"), "edthe", ["text", "source"], "doc_id", 20).select("doc_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation) ORDER BY n_nationkey LIMIT 1")
def symbol_lookup(spark, sf):
    nation = t(spark, sf, "nation")
    return search.lookup(nation, nation.agg(F.max("n_name")).first()[0], "n_name", "n_nationkey").select("n_nationkey", "n_name")


def _first_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.orderBy("vec_id").first()["embedding"])


_COS = "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT vec_id, round({_COS}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_COS}, vec_id LIMIT 10")
def vector_topk(spark, sf):
    v = t(spark, sf, "embeddings")
    return search.knn(v, _first_vector(v), 10, "vec_id").select("vec_id", rounded(F.col("distance")).alias("distance"))


@query(f"""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9), e.vec_id)::INT AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def vector_topk_batch(spark, sf):
    v = t(spark, sf, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn_batch(v, queries, 5, "vec_id", digits=9).select("query_id", "vec_id", "rank")


@query("SELECT vec_id, len(embedding)::INT AS dims FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_remove_node(spark, sf):
    gone = t(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return search.remove_nodes(t(spark, sf, "embeddings"), gone, "vec_id").select("vec_id", F.size("embedding").alias("dims"))


@query("SELECT count(*)::BIGINT AS entries, count(*) FILTER (len(embedding) > 0)::BIGINT AS live FROM embeddings")
def vector_len(spark, sf):
    return t(spark, sf, "embeddings").agg(F.count("*").alias("entries"), F.count(F.when(F.size("embedding") > 0, 1)).alias("live"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_norm(spark, sf):
    e = F.col("embedding")
    return t(spark, sf, "embeddings").select("vec_id", rounded(V.l2_norm(e)).alias("norm"), rounded(V.l2_norm(V.l2_normalize(e))).alias("unit"))


_RRF = """
WITH kw AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT doc_id FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 20)),
near AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS r FROM (
  SELECT e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY d, e.vec_id LIMIT 20)),
every AS (SELECT id, r, true AS k FROM kw UNION ALL SELECT id, r, false FROM near)
SELECT id AS node_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, concat_ws(',', CASE WHEN bool_or(k) THEN 'bm25' END, CASE WHEN bool_or(NOT k) THEN 'semantic' END) AS sources
FROM every GROUP BY id"""


def _lists(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    v = t(spark, sf, "embeddings").withColumnRenamed("vec_id", "node_id")
    return docs, v, list(v.orderBy("node_id").first()["embedding"])


@query(_RRF)
def rrf_fusion(spark, sf):
    docs, v, q = _lists(spark, sf)
    kw = search.ranked(search.contains_search(docs, WORD, ["text"], "node_id", 20).select("node_id"), ["node_id"])
    near = search.ranked(search.knn(v, q, 20, "node_id").select("node_id", "distance"), ["distance", "node_id"])
    return search.rrf(kw, near).withColumn("score", F.round("score", 9))


@query(_RRF + " ORDER BY score DESC, node_id LIMIT 10")
def hybrid_search(spark, sf):
    docs, v, q = _lists(spark, sf)
    return search.hybrid(docs, v, WORD, q, 10, ["text"]).withColumn("score", F.round("score", 9))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'edthe')) AS b FROM w),
s AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (d - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(spark, sf):
    return search.bm25(t(spark, sf, "documents"), "the edthe", 10).select("doc_id", F.round("score", 6).alias("score"))


# Hashing, change detection, texts


@query("""
WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark)
SELECT item_id, printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::HUGEINT)),
  lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS hash FROM b""")
def content_hash(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", hashing.hash_content(F.col("text")).alias("hash"))


@query(ORACLE_SQL["content_hash"])
def content_hash_native(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", hashing.hash_content_native(F.col("text")).alias("hash"))


@query("""
WITH stored AS (SELECT 'd/' || d.doc_id AS path, md5(text) AS hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'b/' || item_id, md5(text) FROM benchmark),
incoming AS (SELECT 'd/' || doc_id AS path, md5(rtrim(text, '.')) AS hash FROM documents)
SELECT coalesce(s.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'new' WHEN s.hash = i.hash THEN 'unchanged' ELSE 'changed' END AS status, s.hash AS old_hash, i.hash AS new_hash
FROM stored s FULL OUTER JOIN incoming i ON s.path = i.path""")
def incremental_diff(spark, sf):
    docs, labels, bench = (t(spark, sf, x) for x in ("documents", "labels", "benchmark"))
    path = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("path")
    stored = docs.join(labels, "doc_id").select(path("d/", "doc_id"), F.md5("text").alias("hash")).unionByName(bench.select(path("b/", "item_id"), F.md5("text").alias("hash")))
    incoming = docs.select(path("d/", "doc_id"), F.md5(F.rtrim("text", F.lit("."))).alias("hash"))
    return incremental.diff(stored, incoming)


@query("SELECT path FROM (" + ORACLE_SQL["incremental_diff"] + ") WHERE status IN ('new', 'changed')")
def needs_parse(spark, sf):
    return incremental.needs_parse(incremental_diff(spark, sf))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, (greatest(0, ceil((len(w) - 512) / 448.0)))::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS chunk_index, (i * 448)::INT AS start_word, least(i * 448 + 512, n)::INT AS end_word, md5(array_to_string(w[i * 448 + 1 : i * 448 + 512], ' ')) AS digest FROM i""")
def chunk_text(spark, sf):
    chunks = t(spark, sf, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c"))
    return chunks.select("doc_id", *[F.col(f"c.{x}").cast("int").alias(x) for x in ("chunk_index", "start_word", "end_word")], F.md5("c.text").alias("digest"))


@query("SELECT doc_id, md5(coalesce(lang, 'CodeElement') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')) AS digest FROM documents")
def embed_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(T.embed_text(F.col("lang"), F.col("source"), F.col("text"))).alias("digest"))


@query(r"""SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(p_type || '_' || p_name, '(\p{Lu})', '_\1', 'g')), '[_-]'), lambda x: x <> '')) AS token FROM part) GROUP BY token""")
def identifier_tokens(spark, sf):
    return t(spark, sf, "part").select(F.explode(T.identifier_tokens(F.concat_ws("_", "p_type", "p_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(r"""
WITH k AS (SELECT p_brand AS community, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(p_type, '(\p{Lu})', '_\1', 'g')), '[_-]'), lambda x: x <> '')) AS token FROM part),
c AS (SELECT community, token, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, token) AS r FROM c)
SELECT community, string_agg(upper(token[1]) || token[2:], '' ORDER BY r) AS dominant_label FROM r WHERE r <= 2 GROUP BY community""")
def dominant_label(spark, sf):
    return community.dominant_labels(t(spark, sf, "part").select(F.col("p_brand").alias("community"), F.concat(F.lit("Part:"), "p_type").alias("node")))


_PATHS = ["src/a.ts", "src/A.TSX", "x/dist/a.js", "target", "distx/a.js", "lib/x.d.ts", "a/b/c.h", "Makefile", "py", "q.pyi", "w.unknown", "node_modules/m.js", "z/.git/config", "k.rb", "m.swift"]
_VALUES = ", ".join(f"('{p}')" for p in _PATHS)


def _language_case(path: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    return f"CASE lower(list_last(string_split({path}, '.'))) {cases} END"


@query(f"SELECT path, {_language_case('path')} AS language FROM (VALUES {_VALUES}) v(path)")
def language_detect(spark, sf):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", T.detect_language(F.col("path")).alias("language"))


@query(f"SELECT path, list_last(string_split(path, '/')) AS name FROM (VALUES {_VALUES}) v(path) WHERE NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'dist', 'target'])")
def path_exclusion(spark, sf):
    return source_files.from_pairs(spark, [(p, "") for p in _PATHS]).select("path", "name")


@query("SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def basename(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


@query("""SELECT event_type, CASE WHEN event_type = 'Route' OR regexp_matches(lower(event_type), 'route|api') THEN 'HTTP' WHEN event_type = 'Tool' OR regexp_matches(lower(event_type), 'command|cmd') THEN 'CLI'
WHEN regexp_matches(lower(event_type), 'event|listener|subscriber') THEN 'Event' WHEN regexp_matches(lower(event_type), 'cron|schedule|job') THEN 'Cron' ELSE 'Unknown' END AS kind FROM (
SELECT DISTINCT event_type FROM events UNION SELECT unnest(['onEvent', 'runCommand', 'cronTask', 'capitalize', 'foo', 'Route', 'Tool']))""")
def process_type(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("onEvent", "runCommand", "cronTask", "capitalize", "foo", "Route", "Tool")], "event_type string")
    every = t(spark, sf, "events").select("event_type").unionByName(names).distinct()
    return every.select("event_type", T.process_type(F.col("event_type"), F.col("event_type")).alias("kind"))


# Graph tables


@query("SELECT o_custkey AS id, 'Customer' AS label, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def node_upsert(spark, sf):
    raw = t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return graph.upsert_nodes(raw)


@query("""SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'CodeRelation' AS rel_table, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag, l_discount)) AS type, arg_max(l_discount, (l_orderkey, l_linenumber, l_returnflag, l_discount)) AS confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey""")
def edge_upsert(spark, sf):
    s, p = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    raw = t(spark, sf, "lineitem").select(s.alias("src"), p.alias("dst"), F.lit("CodeRelation").alias("rel_table"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_discount").alias("seq"))
    return graph.upsert_edges(raw, _supply_nodes(spark, sf))


def _supply_nodes(spark, sf):
    s = t(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Supplier").alias("label"), F.col("s_name").alias("name"))
    return s.unionByName(t(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Part").alias("label"), F.col("p_name").alias("name")))


@query("""SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, s_name AS source_name, 'Supplier' AS source_type, p_name AS target_name, 'Part' AS target_type, 'CALLS' AS type, 0.5::DOUBLE AS confidence, count(*)::BIGINT AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def edge_endpoint_join(spark, sf):
    e = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    e = e.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"), "n")
    return graph.with_endpoints(e, _supply_nodes(spark, sf))


@query(r"""
WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
sym AS (SELECT n_name AS name, 'N' || n_nationkey AS id, n_nationkey AS seq FROM nation UNION ALL SELECT target, 'L' || min(page_id), 1000 + min(page_id) FROM links GROUP BY target),
ix AS (SELECT name, arg_max(id, seq) AS id FROM sym GROUP BY name)
SELECT 'Page:' || page_id AS src, ix.id AS dst FROM links JOIN ix ON target = name""")
def name_resolution(spark, sf):
    links = t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target"))
    nation = t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("seq"))
    own = links.groupBy(F.col("target").alias("name")).agg(F.min("page_id").alias("p")).select("name", F.concat(F.lit("L"), F.col("p").cast("string")).alias("id"), (F.col("p") + 1000).alias("seq"))
    return graph.resolve(links.select(F.concat(F.lit("Page:"), F.col("page_id").cast("string")).alias("src"), "target"), nation.unionByName(own))


def _geo(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = n.select(text("N", "n_nationkey").alias("id"), F.lit("Module").alias("label"), F.col("n_name").alias("name"), F.lit("geo").alias("file_path")).unionByName(r.select(text("R", "r_regionkey").alias("id"), F.lit("Folder").alias("label"), F.col("r_name").alias("name"), F.lit("geo").alias("file_path")))
    edges = n.select(text("N", "n_nationkey").alias("src"), text("R", "n_regionkey").alias("dst"), F.lit("CodeRelation").alias("rel_table"), F.lit("IMPORTS").alias("type"), F.lit(0.9).alias("confidence"))
    return nodes, edges


@query("""SELECT 'node' AS kind, 'N' || n_nationkey AS id, 'Module' AS label, n_name AS name, NULL AS type FROM nation UNION ALL SELECT 'node', 'R' || r_regionkey, 'Folder', r_name, NULL FROM region
UNION ALL SELECT 'edge', 'N' || n_nationkey || '_R' || n_regionkey, NULL, NULL, 'IMPORTS' FROM nation""")
def full_graph_export(spark, sf):
    out = graph.export(*_geo(spark, sf))
    field = lambda p: F.get_json_object("body", p)
    return out.select("kind", "id", field("$.label").alias("label"), field("$.properties.name").alias("name"), field("$.type").alias("type"))


@query("SELECT 'N' || n_nationkey AS id, 'Module' AS label, n_name AS name, 2 AS val, '#94a3b8' AS color FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Folder', r_name, 4, '#94a3b8' FROM region")
def graph_picture(spark, sf):
    return graph.picture(_geo(spark, sf)[0])


@query("SELECT n_name AS source, r_name AS target, 'IMPORTS' AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'A') ORDER BY n_name LIMIT 7")
def cypher_match(spark, sf):
    return cypher.run(spark, "MATCH (a:Module)-[r:CodeRelation]->(b) WHERE a.name CONTAINS 'A' RETURN a.name AS source, b.name AS target, COALESCE(r.type, 'CALLS') AS type ORDER BY a.name LIMIT 7", *_geo(spark, sf))


@query("SELECT 0::BIGINT AS files, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, 0::BIGINT AS communities, 0::BIGINT AS processes, (SELECT count(*) FROM nation) AS edges")
def index_stats(spark, sf):
    return graph.index_stats(*_geo(spark, sf))


@query("""
WITH p AS (SELECT DISTINCT 'u/' || source || '/' || lang || '/' || doc_id AS path FROM documents)
SELECT DISTINCT 'Folder:' || f AS id, list_last(string_split(f, '/')) AS name FROM (SELECT unnest(['u', 'u/' || string_split(path, '/')[2], 'u/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3]]) AS f FROM p)""")
def folder_nodes(spark, sf):
    paths = t(spark, sf, "documents").select(F.concat_ws("/", F.lit("u"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return graph.folders(paths)[0].select("id", "name")


# Communities, on trade between nations


_TRADE = """
trade AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
pairs AS (SELECT u, v, sum(w) AS w FROM (SELECT a AS u, b AS v, w FROM trade UNION ALL SELECT b, a, w FROM trade WHERE a <> b) GROUP BY ALL),
deg AS (SELECT u, sum(CASE WHEN u = v THEN 2 * w ELSE w END) AS degree FROM pairs GROUP BY u),
mem AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation)"""


def _trade(spark, sf):
    li, o, c, s = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "supplier"))
    e = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return e, community.symmetrise(e), t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))


@query(f"WITH {_TRADE} SELECT u, degree FROM deg")
def weighted_degree(spark, sf):
    return community.weighted_degree(_trade(spark, sf)[1])


@query(f"WITH {_TRADE} SELECT community, sum(degree) AS sigma_tot FROM deg JOIN mem ON u = node GROUP BY community")
def sigma_tot(spark, sf):
    _, pairs, mem = _trade(spark, sf)
    return community.sigma_tot(community.weighted_degree(pairs), mem)


@query(f"WITH {_TRADE} SELECT u, community, sum(w) AS weight FROM pairs JOIN mem ON v = node WHERE u <> v GROUP BY u, community")
def neighbor_community_weight(spark, sf):
    _, pairs, mem = _trade(spark, sf)
    return community.neighbour_weights(pairs, mem)


_SUPER = "SELECT x.community AS u, y.community AS v, sum(CASE WHEN x.community = y.community AND u <> v THEN w / 2 ELSE w END) AS w FROM pairs JOIN mem x ON u = x.node JOIN mem y ON v = y.node GROUP BY ALL"


@query(f"WITH {_TRADE} {_SUPER}")
def super_edges(spark, sf):
    _, pairs, mem = _trade(spark, sf)
    return community.super_edges(pairs, mem)


_Q = """, m AS (SELECT sum(degree) AS m2 FROM deg), inn AS (SELECT p.u, p.v, w, a.degree AS ku, b.degree AS kv FROM pairs p JOIN deg a ON p.u = a.u JOIN deg b ON p.v = b.u JOIN mem x ON p.u = x.node JOIN mem y ON p.v = y.node WHERE x.community = y.community)
SELECT round((SELECT sum(w * CASE WHEN u = v THEN 2 ELSE 1 END) FROM inn) / m2 - (SELECT sum(s * s) FROM (SELECT sum(degree) AS s FROM deg JOIN mem ON u = node GROUP BY community)) / (m2 * m2), 9) AS q,
 round((SELECT sum((w - ku * kv / m2) / m2) FROM inn, m), 9) AS q_adjacent FROM m"""


@query(f"WITH {_TRADE}{_Q}")
def modularity(spark, sf):
    _, pairs, mem = _trade(spark, sf)
    return community.modularity(pairs, mem).select(F.round("q", 9).alias("q"), F.round("q_adjacent", 9).alias("q_adjacent"))


@query(f"""WITH {_TRADE}, sup AS ({_SUPER}) SELECT u AS community, (SELECT count(*) FROM mem WHERE community = u)::BIGINT AS size, round(sum(CASE WHEN u = v THEN w ELSE 0 END) / sum(w), 9) AS cohesion FROM sup GROUP BY u""")
def community_stats(spark, sf):
    _, pairs, mem = _trade(spark, sf)
    named = mem.select(F.col("node"), "community")
    return community.community_stats(named, pairs).select("community", "size", F.round("cohesion", 9).alias("cohesion"))


@query()
def louvain(spark, sf):
    return community.louvain(_trade(spark, sf)[0])


# Flows and impact


@query("""
SELECT DISTINCT n.id, n.label, n.name FROM (SELECT 'F' || p_partkey AS id, CASE WHEN p_size > 45 THEN 'Route' ELSE 'Function' END AS label, p_type AS name, p_partkey FROM part) n
JOIN lineitem ON l_partkey = p_partkey WHERE label IN ('Route', 'Tool') OR regexp_matches(lower(name), 'handler|controller|command|main')""")
def entry_points(spark, sf):
    nodes = t(spark, sf, "part").select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") > 45, "Route").otherwise("Function").alias("label"), F.col("p_type").alias("name"))
    edges = t(spark, sf, "lineitem").select(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"))
    return traverse.entry_points(nodes, edges)


_SUPPLY = """
edges AS (SELECT DISTINCT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem)"""


def _supply(spark, sf):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    e = o.select(k("C", "o_custkey").alias("src"), k("O", "o_orderkey").alias("dst"))
    e = e.unionByName(li.select(k("O", "l_orderkey").alias("src"), k("P", "l_partkey").alias("dst"))).unionByName(li.select(k("P", "l_partkey").alias("src"), k("S", "l_suppkey").alias("dst")))
    return e.distinct()


def _walk_sql(start: str, here: str, there: str) -> str:
    return f"""WITH RECURSIVE {_SUPPLY}, walk AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT {there}, depth + 1 FROM walk JOIN edges ON {here} = node WHERE depth < 3)
SELECT '{start}' AS start, node, min(depth)::INT AS depth FROM walk GROUP BY node HAVING min(depth) > 0"""


@query(_walk_sql("C1", "src", "dst"))
def impact_downstream(spark, sf):
    return traverse.impact(_supply(spark, sf), spark.createDataFrame([("C1",)], "id string"), "downstream", 3)


@query(_walk_sql("S1", "dst", "src"))
def impact_upstream(spark, sf):
    return traverse.impact(_supply(spark, sf), spark.createDataFrame([("S1",)], "id string"), "upstream", 3)


_FLOW = """
trans AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL),
flow AS (SELECT src, dst, n / max(n) OVER () AS confidence FROM trans)"""


def _flow(spark, sf):
    from pyspark.sql import Window

    e = t(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).filter("dst IS NOT NULL")
    e = e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    return e.join(e.agg(F.max("n").alias("most"))).select("src", "dst", F.lit("CALLS").alias("type"), (F.col("n") / F.col("most")).alias("confidence"))


@query(f"""WITH RECURSIVE {_FLOW}, walk AS (SELECT DISTINCT src AS entry, src AS node, 0 AS depth FROM flow UNION SELECT entry, dst, depth + 1 FROM walk JOIN flow ON src = node WHERE confidence >= 0.5 AND depth < 4),
least AS (SELECT entry, node, min(depth)::INT AS depth FROM walk GROUP BY ALL)
SELECT entry, node, depth, round(1.0 - depth * 0.05, 6)::DOUBLE AS confidence, node NOT IN (SELECT src FROM flow) AS terminal, 'Process:' || entry AS process_id FROM least WHERE entry IN (SELECT entry FROM least GROUP BY entry HAVING count(*) >= 2)""")
def process_bfs(spark, sf):
    e = _flow(spark, sf)
    steps = traverse.processes(e, e.select(F.col("src").alias("id")), max_depth=4)
    return steps.select("entry", "node", "depth", F.round("confidence", 6).alias("confidence"), "terminal", "process_id")


@query()
def process_summary(spark, sf):
    e = _flow(spark, sf)
    nodes = e.select(F.col("src").alias("id"), F.col("src").alias("name"), F.lit("Function").alias("label")).distinct()
    return traverse.process_nodes(traverse.processes(e, nodes), nodes)


@query(f"WITH {_FLOW} SELECT DISTINCT dst AS node FROM flow WHERE dst NOT IN (SELECT src FROM flow WHERE src <> 'view')")
def terminals(spark, sf):
    e = _flow(spark, sf)
    return e.select(F.col("dst").alias("node")).join(e.filter("src <> 'view'").select(F.col("src").alias("node")), "node", "left_anti").distinct()


@query("""SELECT direction, other, type, name, label, rank FROM (
SELECT 'incoming' AS direction, 'N' || n_nationkey AS other, 'IMPORTS' AS type, n_name AS name, 'Module' AS label, row_number() OVER (ORDER BY 'N' || n_nationkey)::INT AS rank FROM nation WHERE n_regionkey = 1) WHERE rank <= 10""")
def symbol_context(spark, sf):
    return graph.context(*_geo(spark, sf), "R1")


@query("""
WITH spans AS (SELECT user_id, event_type AS id, floor(min(epoch(ts)))::BIGINT AS a, floor(max(epoch(ts)))::BIGINT AS b FROM events GROUP BY ALL), calls AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS line FROM events)
SELECT event_id, arg_max(id, (a, -b, id)) AS caller FROM calls c JOIN spans s ON c.user_id = s.user_id AND line BETWEEN a AND b GROUP BY event_id""")
def call_scope_range_join(spark, sf):
    ev = t(spark, sf, "events")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    spans = ev.groupBy(F.col("user_id").alias("file_path"), F.col("event_type").alias("id")).agg(F.min(sec).cast("long").alias("start_line"), F.max(sec).cast("long").alias("end_line"))
    calls = ev.select("event_id", F.col("user_id").alias("file_path"), sec.cast("long").alias("line"))
    return graph.enclosing(calls, spans).select("event_id", "caller")


# Source code


CORPUS = [
    ("app/a.py", "import os\nclass A:\n    def m(self):\n        return helper(1)\ndef helper(x):\n    return x\n"),
    ("app/main.py", "from app import a\n\ndef main():\n    run()\n    helper(2)\n\ndef run():\n    return a.A().m()\n"),
    ("web/x.ts", "import { y } from './y';\nexport class Shape {\n  area(k: number) {\n    return scale(k);\n  }\n}\nexport function scale(n: number) {\n  return n * 2;\n}\n"),
    ("lib/r.rs", "use std::fmt;\nstruct P { x: i32 }\nimpl P {\n    fn get(&self) -> i32 {\n        calc(self.x)\n    }\n}\nfn calc(v: i32) -> i32 {\n    v\n}\n"),
    ("bad/b.py", "def broken(:\n"),
]


def _parsed(spark):
    return parse.parse(source_files.for_parsing(source_files.from_pairs(spark, CORPUS)))


@query("""SELECT * FROM (VALUES ('app/a.py', 'Class:A', 2, 4), ('app/a.py', 'Method:m', 3, 4), ('app/a.py', 'Function:helper', 5, 6), ('app/main.py', 'Function:main', 3, 5), ('app/main.py', 'Function:run', 7, 8),
('web/x.ts', 'Class:Shape', 2, 6), ('web/x.ts', 'Method:area', 3, 5), ('web/x.ts', 'Function:scale', 7, 9), ('lib/r.rs', 'Struct:P', 2, 2), ('lib/r.rs', 'Class:P', 3, 7), ('lib/r.rs', 'Method:get', 4, 6), ('lib/r.rs', 'Function:calc', 8, 10)) v(file_path, id, start_line, end_line)""")
def parse_symbols(spark, sf):
    return _parsed(spark).select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.id", "s.start_line", "s.end_line")


@query("""SELECT * FROM (VALUES ('Method:m', 'Function:helper', 'CALLS', 0.8::DOUBLE), ('Function:main', 'Function:run', 'CALLS', 0.8), ('Function:main', 'Function:helper', 'CALLS', 0.8), ('Method:area', 'Function:scale', 'CALLS', 0.8), ('Method:get', 'Function:calc', 'CALLS', 0.8),
('File:app/a.py', 'Module:import os', 'IMPORTS', 0.9), ('File:app/main.py', 'Module:from app import a', 'IMPORTS', 0.9), ('File:web/x.ts', 'Module:import { y } from ./y;', 'IMPORTS', 0.9), ('File:lib/r.rs', 'Module:use std::fmt;', 'IMPORTS', 0.9)) v(src, dst, type, confidence)""")
def resolve_calls(spark, sf):
    return graph.build(_parsed(spark))[1].filter("rel_table = 'CodeRelation'").select("src", "dst", "type", "confidence")


@query("SELECT 4::BIGINT AS files, 16::BIGINT AS nodes, 16::BIGINT AS edges")
def build_counts(spark, sf):
    return graph.build_counts(_parsed(spark))


_MERGES = ["t h", "th e", "e r", "a n", "an d", "o n", "i n", "in g"]


def _toy_bpe() -> tokenize.Bpe:
    letters = [chr(c) for c in range(97, 123)]
    vocab = {x: i for i, x in enumerate(["[UNK]", *letters, *(m.replace(" ", "") for m in _MERGES)])}
    return tokenize.Bpe(vocab, _MERGES, 0)


@query()
def bpe_encode(spark, sf):
    ids = tokenize.encoder(_toy_bpe())
    return t(spark, sf, "benchmark").select("item_id", ids(F.col("text")).alias("e")).select("item_id", F.size("e.input_ids").alias("n_tokens"), F.array_join("e.input_ids", " ").alias("ids"))


@query()
def bpe_pad(spark, sf):
    ids = tokenize.encoder(_toy_bpe())
    e = t(spark, sf, "benchmark").select("item_id", ids(F.col("text")).alias("e")).select("item_id", "e.input_ids", "e.attention_mask")
    out = tokenize.pad_batch(e, F.floor(F.col("item_id") / 8))
    return out.select("item_id", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"))


@query()
def embed_nodes(spark, sf):
    nodes = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("File").alias("label"), F.col("source").alias("name"), F.col("text").alias("content"))
    made = embed.embed_chunks(embed.chunk_nodes(nodes), embed.hashed_model(64))
    return made.select("node_id", "chunk_index", "start_word", "end_word", "content_hash", F.size("embedding").alias("dims"), F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


# Extensions over the event table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return watch.event_windows(t(spark, sf, "events")).withColumn("total", F.round("total", 4))


# Index upkeep, dispatch, metadata, numbering


@query("SELECT vec_id % 2 = 0 AS again, count(*)::BIGINT AS n, count(DISTINCT vec_id)::BIGINT AS ids, round(sum(CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END * embedding[1]::DOUBLE), 4) AS first_sum FROM embeddings GROUP BY ALL")
def vector_insert(spark, sf):
    v = t(spark, sf, "embeddings").select("vec_id", "embedding")
    new = v.filter("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    made = search.insert_vectors(v, new, "vec_id")
    return made.groupBy((F.col("vec_id") % 2 == 0).alias("again")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first_sum"))


@query("SELECT doc_id AS node_id, NULL::DOUBLE AS score, 'bm25' AS sources FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 10")
def search_dispatch_keyword(spark, sf):
    docs, v, q = _lists(spark, sf)
    return search.dispatch(docs, v, WORD, ["text"], semantic=True)


@query(_RRF + " ORDER BY score DESC, node_id LIMIT 10")
def search_dispatch_semantic(spark, sf):
    docs, v, q = _lists(spark, sf)
    return search.dispatch(docs, v, WORD, ["text"], semantic=True, embedding=q).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, left(text, 2000) AS text FROM documents")
def content_preview(spark, sf):
    return search.preview(t(spark, sf, "documents").select("doc_id", "text"), "text")


@query("""
WITH m AS (SELECT l_partkey AS id, min_by(l_returnflag, l_orderkey * 100 + l_linenumber) AS name, min_by(l_linestatus, l_orderkey * 100 + l_linenumber) AS type FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1)
SELECT p_partkey AS node, coalesce(name, 'unknown') AS node_name, coalesce(type, 'CodeElement') AS node_type FROM part LEFT JOIN m ON p_partkey = id
""")
def step_metadata(spark, sf):
    seen = t(spark, sf, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("type"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return traverse.step_meta(t(spark, sf, "part").select(F.col("p_partkey").alias("node")), traverse.first_meta(seen))


@query("SELECT c_custkey AS node, c_mktsegment AS community, (dense_rank() OVER (ORDER BY least) - 1)::BIGINT AS number FROM (SELECT c_custkey, c_mktsegment, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS least FROM customer)")
def community_numbers(spark, sf):
    return community.renumber(t(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("community")))
