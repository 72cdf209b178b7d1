"""Keyword, vector and rank-fused search. Every limit follows a total order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.functions import text as T
from loomgraph.functions import vector as V
from loomgraph.operators.nearest import Nearest
from loomgraph.shared import store

RRF_K = 60


def contains_search(df: DataFrame, query: str, columns: list[str], key: str, limit: int | None = 10) -> DataFrame:
    """Rows in which any column holds ``query`` (case counts), lowest keys first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(query)), F.lit(False))
    out = df.filter(hit).orderBy(key)
    return out.limit(limit) if limit is not None else out


def lookup(df: DataFrame, name: str, name_col: str = "name", key: str = "id") -> DataFrame:
    """The first row of that name, or none."""
    return df.filter(F.col(name_col) == name).orderBy(key).limit(1)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "node_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance; none for a zero query; rows without a vector (removed ones) are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    live = vectors.filter((F.size(embedding) > 0) & F.lit(any(query)))
    return live.withColumn("distance", V.cosine_distance(F.col(embedding), q)).orderBy("distance", key).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "node_id", embedding: str = "embedding", query_key: str = "query_id", max_queries: int = 20_000, digits: int | None = None) -> DataFrame:
    """The k nearest of each query, with their rank; with ``digits``, distances that agree so far are ties, which the key settles.

    The side that is broadcast has a known bound: above ``max_queries`` the
    queries are numbered and taken in blocks of that many, the best k of each
    block are written, and the best k of all blocks are ranked. Each partition
    keeps k rows a query before anything is shuffled.
    """
    columns = queries.select(F.col(query_key), F.col(embedding).alias("_q"))
    order = Window.partitionBy(query_key).orderBy("_order", key)
    rank = lambda near: near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_order")
    if queries.limit(max_queries + 1).count() <= max_queries:
        return rank(_nearest(vectors, columns, k, key, embedding, query_key, digits))
    # a stored partition number and place in it, with each partition's start, count without gaps
    at = store(columns.withColumn("_id", F.monotonically_increasing_id()), "queries").withColumn("_part", F.shiftright("_id", 33))
    counts = sorted(tuple(r) for r in at.groupBy("_part").agg(F.count("*")).collect())
    starts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    number = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    block = F.floor(number / max_queries).cast("long").alias("_block")
    numbered = store(at.join(F.broadcast(at.sparkSession.createDataFrame(starts, "_part long, _start long")), "_part").select(query_key, "_q", block), "numbered")
    done = []
    for i in range(-(-sum(n for _, n in counts) // max_queries)):
        done.append(store(_nearest(vectors, numbered.filter(F.col("_block") == i).drop("_block"), k, key, embedding, query_key, digits), "nearest"))
    return rank(reduce(DataFrame.unionByName, done))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, embedding: str, query_key: str, digits: int | None) -> DataFrame:
    """For each of a block of queries (``query_key``, ``_q``), which is broadcast, the k nearest in every partition of the vectors, with ``distance`` and ``_order``, the distance by which they rank."""
    spark = vectors.sparkSession
    live = vectors.filter(F.size(embedding) > 0).select(key, embedding).sortWithinPartitions(key)
    shared = spark.sparkContext.broadcast(queries.filter(V.l2_norm(F.col("_q")) > 0).toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.combine_chunks()
        ids = pa.concat_arrays(asked.column(0).chunks) if len(asked) else None
        found = Nearest(pa.concat_arrays(asked.column(1).chunks), k, digits) if len(asked) else None
        for batch in batches:
            if found:
                found.add(batch.column(0), batch.column(1))
        if found and found.seen:
            for q, keys, distance, order in found.rows():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys, pa.array(distance), pa.array(order)], [query_key, key, "distance", "_order"])

    schema = StructType([StructField(query_key, queries.schema[query_key].dataType), StructField(key, vectors.schema[key].dataType), StructField("distance", DoubleType()), StructField("_order", DoubleType())])
    return live.mapInArrow(scan, schema)


def insert_vectors(vectors: DataFrame, new: DataFrame, key: str = "node_id", chunk: str | None = None, replace: bool = True) -> DataFrame:
    """The vectors with new ones added. With ``replace`` all old rows of a (key, chunk) that comes again go; else rows are appended as they are."""
    on = [key, chunk] if chunk else [key]
    kept = vectors.join(new.select(*on).distinct(), on, "left_anti") if replace else vectors
    return kept.select(*vectors.columns).unionByName(new.select(*vectors.columns))


def remove_nodes(vectors: DataFrame, gone: DataFrame, key: str = "node_id") -> DataFrame:
    return vectors.join(gone.select(key).distinct(), key, "left_anti")


def ranked(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """A short result list with its 1-based places."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(keyword: DataFrame, semantic: DataFrame, k: int | None = None, key: str = "node_id") -> DataFrame:
    """Reciprocal rank fusion of two lists of (key, rank); an entry twice in one list counts twice."""
    both = keyword.select(key, "rank", F.lit(True).alias("kw")).unionByName(semantic.select(key, "rank", F.lit(False).alias("kw")))
    fused = both.groupBy(key).agg(
        F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("score"),
        F.concat_ws(",", F.when(F.max("kw"), "bm25"), F.when(~F.min("kw"), "semantic")).alias("sources"),
    )
    return fused.orderBy(F.desc("score"), key).limit(k) if k is not None else fused


def hybrid(nodes: DataFrame, vectors: DataFrame, query: str, embedding: list[float], k: int, columns: list[str], key: str = "node_id") -> DataFrame:
    """Keyword and vector lists of 2k each, fused, the best k."""
    words = ranked(contains_search(nodes, query, columns, key, 2 * k).select(key), [key])
    near = ranked(knn(vectors, embedding, 2 * k, key).select(key, "distance"), ["distance", key])
    return rrf(words, near, k, key)


def dispatch(nodes: DataFrame, vectors: DataFrame | None, query: str, columns: list[str], semantic: bool = False, embedding: list[float] | None = None, limit: int | None = None, key: str = "node_id") -> DataFrame:
    """One entry for searches: hybrid where ``semantic`` is asked for and an embedding is given, else the keyword list; 10 rows unless said. Columns key, score, sources."""
    limit = 10 if limit is None else limit
    if semantic and embedding and vectors is not None:
        return hybrid(nodes, vectors, query, embedding, limit, columns, key).select(key, "score", "sources")
    found = contains_search(nodes, query, columns, key, limit)
    return found.select(key, F.lit(None).cast("double").alias("score"), F.lit("bm25").alias("sources"))


def preview(df: DataFrame, column: str = "content", chars: int = 2000) -> DataFrame:
    """``column`` cut to its first characters, for display alone."""
    return df.withColumn(column, F.substring(column, 1, chars))


def bm25(docs: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over lower-case words; term frequencies of the query's words alone are kept, in one pass and no explode."""
    terms = sorted(set(query.lower().split()))
    count = lambda term: F.size(F.filter("w", lambda x: x == term))
    words = T.words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    counted = docs.select(key, words.alias("w")).select(key, F.size("w").alias("n"), *[count(term).alias(f"t{i}") for i, term in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    joined = counted.filter(" OR ".join(f"t{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
