"""The corpus pipeline: classify, drop near copies, decontaminate, mix, and write token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and gives the reread table to the
next stage. All stages but the last return the columns of ``documents``; further
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, quality, queries, simhash, token_ids
from loomgraph.shared import drop, sieve, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What a worker that makes token ids holds: texts at once and words remembered. More of them take memory and save time.
BATCH_ROWS = 1000
WORDS = 250_000


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go."""
    scored = quality.with_score(docs.select(*COLUMNS), quality.fit(docs, queries.table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def _row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``uid``: 128 bits of the SHA-256 of doc_id and text, so that a decision on a row meets that row alone, whatever its doc_id."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
    return docs.withColumn("uid", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose uid is in ``gone``; a row that a sieve clears is not shuffled."""
    marked = sieve(docs, F.xxhash64("uid"), gone.select(F.xxhash64("uid").alias("h")))
    clear, rest = marked.filter("NOT maybe"), marked.filter("maybe").join(gone, "uid", "left_anti")
    return clear.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by five-word shingle similarity of 0.8 or more, the one of smallest doc_id stays.

    Every row is judged by itself, whatever its doc_id: a null one comes after all
    others, and of rows with the same one that of the smallest key stays. Null and
    empty texts are copies of each other. Rows that repeat under one doc_id and
    text are one row.
    """
    docs = docs.select(*COLUMNS)
    ids = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if len(set(ids)) > 1:  # rows that repeat under one doc_id
        docs = store(docs.dropDuplicates(["doc_id", "text"]), "distinct")
    docs = _row_key(docs)
    groups = simhash.near_rows(docs, "uid")
    gone = store(groups.filter("uid != keep").select("uid"), "gone")
    drop(groups)
    return _without(docs, gone)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; every row is judged by itself, by a key of its doc_id and text.

    Null and empty texts hold none and stay; rows that repeat stay or go together.
    """
    docs = _row_key(docs.select(*COLUMNS))
    marks = decontam.contaminated(docs, queries.table(spark, sf_dir, "benchmark"), key="uid")
    bad = store(marks.filter("contaminated").select("uid").distinct(), "bad")
    return _without(docs, bad)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents that it takes no time go."""
    taken = mixing.mix(docs, carry=("text", "lang", "n_chars", "source"))
    return taken.filter("times > 0").withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def _token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in shards, read back by key."""
    return token_ids.token_table(docs, queries.tokenizer_path(), batch_rows=BATCH_ROWS, memory=WORDS)


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("decontamination", _decontaminate), ("mixing", _mix), ("token_ids", _token_ids)]

#: No SQL: models, sketches and the tokenizer are beyond it; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
