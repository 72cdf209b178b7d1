"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sieve has 16 bits a key, at most so many in all: 2^28 bits are 32 MB, in rows of 4 KB.
SIEVE_BITS = 1 << 28
_SLOT = 1 << 15  # bits in one bitmap of bitmap_construct_agg
#: A driver whose Java heap takes more than this share of its bound hands back what is free, once in so many seconds at most.
HEAP_SHARE, RELIEF_S = 0.5, 4

_written: list[str] = []
_relieved = float("-inf")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where that is unset, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        with contextlib.suppress(Exception):
            if spark is not None:
                _delete(spark, path)


def _in_batches(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in a copy of its session that hands Python at most ``rows`` rows at once; the session itself keeps its setting."""
    spark = df.sparkSession
    copy = df._jdf.sparkSession().cloneSession()
    copy.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    made = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    return DataFrame(made, spark)


def _relieve(spark: SparkSession) -> None:
    """Hand back memory that the driver's Java process has freed and keeps: many plans, each of its own code, leave the heap at its bound and the C allocator full of holes."""
    global _relieved
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() < _relieved + RELIEF_S or runtime.totalMemory() < HEAP_SHARE * runtime.maxMemory():
        return
    gc.collect()  # what Python holds, the driver keeps
    runtime.gc()
    with contextlib.suppress(Exception):  # a JVM without this command (before 17.0.9) keeps the holes
        kind = jvm.java.lang.Class.forName
        types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, x in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(x)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    _relieved = time.monotonic()


def store(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    The files outlive any executor, so a lost executor costs no recomputation
    of what stands above them. They go when the application ends, or earlier by
    ``drop``. ``batch_rows`` bounds the rows that lie in a Python worker and its
    buffers at once, for plans that send whole texts there; all rows are taken.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    (_in_batches(df, batch_rows) if batch_rows else df).write.option("compression", "zstd").parquet(path)
    _written.append(path)
    _relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def store_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As ``store``, but as a table bucketed by ``key``: what is hashed by ``key`` into as many partitions meets it without a shuffle of it."""
    spark = df.sparkSession
    at = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/loomgraph/{at}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(at)
    _written.append(path)
    out = spark.table(at)
    out._stored_at, out._named = path, at
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``store`` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if hasattr(table, "_named"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._named}")
        if path in _written:
            _delete(table.sparkSession, path)
            _written.remove(path)


def sieve(df: DataFrame, hashed: Column, keys: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: false where no row of ``keys`` has this hash, true else, rarely without cause.

    ``keys`` has one long column, ``hashed`` is a long of the same make, both well
    mixed. Rows are tested where they are scanned, against broadcast bitmaps whose
    size follows from the count of keys up to ``SIEVE_BITS``; past some 2^25 keys
    more rows pass without cause, which costs work and loses nothing.
    """
    (name,) = keys.columns
    n = keys.count()
    bits = min(SIEVE_BITS, max(_SLOT, 1 << (16 * n - 1).bit_length() if n else _SLOT))
    place = lambda c: c.bitwiseAND(F.lit(bits - 1))
    slot, at = lambda c: F.shiftright(c, 15).cast("int"), lambda c: c.bitwiseAND(F.lit(_SLOT - 1))
    held = keys.select(place(F.col(name)).alias("_place")).select(slot(F.col("_place")).alias("_slot"), at(F.col("_place")).alias("_at"))
    maps = held.groupBy("_slot").agg(F.bitmap_construct_agg("_at").alias("_map"))
    out = df.withColumn("_place", place(hashed)).withColumn("_own", slot(F.col("_place"))).join(F.broadcast(maps), F.col("_own") == F.col("_slot"), "left")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at(F.col("_place")), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("_place").bitwiseAND(F.lit(7)).cast("int"))
    return out.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("_place", "_own", "_slot", "_map")
