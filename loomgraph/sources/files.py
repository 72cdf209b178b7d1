"""Source trees in, snapshots out and in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text as T
from loomgraph.shared import drop, store

_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as (path, name, is_directory, content, size), excluded folders left out; bytes that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    full = F.regexp_replace("path", "^file:/+", "file:/")
    path = F.substr(full, F.lit(len(base) + 1)) if root.startswith("/") else F.regexp_replace("path", "^.*?" + base, "")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = raw.select(path.alias("path"), F.lit(False).alias("is_directory"), text.alias("content"), F.col("length").alias("size"))
    return out.filter(T.is_included(F.col("path"))).select("path", T.basename(F.col("path")).alias("name"), "is_directory", "content", "size")


def from_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Files handed over as (path, content)."""
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1], False, c, len(c.encode())) for p, c in pairs], schema.FILES).filter(T.is_included(F.col("path")))


def for_parsing(files: DataFrame) -> DataFrame:
    """(path, language, content) of files with content in a known language."""
    return files.filter("NOT is_directory AND content IS NOT NULL").select("path", T.detect_language(F.col("path")).alias("language"), "content").filter("language IS NOT NULL")


def tracked(files: DataFrame, listing: DataFrame) -> DataFrame:
    """The files that a version-control listing (path) names."""
    return files.join(listing.select("path").distinct(), "path", "left_semi")


def save_snapshot(tables: dict[str, DataFrame], root: str, repo: str) -> None:
    """Write each table under its own folder, partitioned by repo; other repos stay."""
    for name, df in tables.items():
        df.withColumn("repo", F.lit(repo)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{root}/{name}")


def load_snapshot(spark: SparkSession, root: str, repo: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter(F.col("repo") == repo).drop("repo")


def list_repos(spark: SparkSession, root: str, name: str = "nodes") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").select("repo").distinct()


def delete_snapshot(spark: SparkSession, root: str, repo: str, names: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/repo={repo}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_state(hashes: DataFrame, root: str, repo: str) -> None:
    """Keep a repository's (path, hash) and the time, so that the next run can compare."""
    save_snapshot({"hashes": hashes.select("path", "hash").withColumn("saved_at", F.current_timestamp())}, root, repo)


def load_state(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(path, hash) as last saved; none for a repository never saved."""
    try:
        return load_snapshot(spark, root, repo, "hashes").select("path", "hash")
    except AnalysisException as why:
        if why.getCondition() not in _ABSENT:
            raise
        return spark.createDataFrame([], "path string, hash string")


class KeyValues:
    """A keyed table of strings by store name: put, get, get_all, delete. A put rewrites its store alone."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def get_all(self, name: str) -> DataFrame:
        try:
            return load_snapshot(self.spark, self.root, name, "values").select("key", "value")
        except AnalysisException as why:
            if why.getCondition() not in _ABSENT:
                raise
            return self.spark.createDataFrame([], "key string, value string")

    def get(self, name: str, key: str) -> str | None:
        row = self.get_all(name).filter(F.col("key") == key).first()
        return row["value"] if row else None

    def _write(self, name: str, rows: DataFrame) -> None:
        kept = store(rows, "values")  # the table that is read is the one written over
        save_snapshot({"values": kept}, self.root, name)
        drop(kept)

    def put(self, name: str, rows: DataFrame) -> None:
        """Add (key, value) rows; a key that is there is replaced."""
        new = rows.select("key", "value")
        self._write(name, self.get_all(name).join(new.select("key"), "key", "left_anti").unionByName(new))

    def delete(self, name: str, key: str) -> None:
        left = store(self.get_all(name).filter(F.col("key") != key), "left")
        delete_snapshot(self.spark, self.root, name, ["values"])
        if not left.isEmpty():
            save_snapshot({"values": left}, self.root, name)
        drop(left)
