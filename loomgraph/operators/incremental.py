"""Change detection between a stored and an incoming set of file hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path, status, old_hash, new_hash), status unchanged, changed, new or deleted; one full outer join on path."""
    s = stored.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    i = incoming.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("is"))
    status = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return s.join(i, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")


def needs_parse(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status").isin("changed", "new")).select("path")
