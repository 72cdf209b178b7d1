"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source of S words with target T is taken floor(T / S) whole times; the rest,
T - S * floor(T / S) words, is drawn without replacement. Every document has the
exponential key ``-ln(u) / weight``, u a fixed hash of its doc_id; documents are
ranked by key within their source and taken while the running word count,
including half of the document itself, stays within the rest. So a source misses
its target by half of its boundary document at most, and reruns agree.

The running sum needs no sort of a whole source: keys are cut into monotone
buckets, bucket totals are summed first, and only the bucket in which the rest
ends is sorted. A source with a third of all rows is spread over all tasks.

Defined results: null text has size 0; a document of size 0 takes 0 words; a
null source is a source of its own, last in order; a null doc_id hashes as an
empty string; repeated rows count as documents of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.shared import store

SPACE = " \t\n\x0b\f\r"
WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 100_000


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) fixed by doc_id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def prose_weight(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: highest where a word takes about seven characters with its space, as in prose."""
    return F.lit(1.0) / (1.0 + F.abs(F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1)) - 7.0))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): a share of all words dealt by weight, stopped at ``most`` times a source's size.

    Resharing the excess until no target is above its stop ends at one level L
    with target = min(stop, weight * L). Sources are ordered by stop / weight;
    L is the first level that the next source's stop does not undercut.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("ratio", "w", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    dealt = sources.withColumn("w", w).withColumn("stop", most * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("w"))
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(by), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by), F.lit(0)))
    place = F.row_number().over(Window.orderBy("ratio", "w", F.col("source").asc_nulls_last()))
    dealt = dealt.withColumn("level", level).withColumn("place", place).withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(whole))
    chosen = F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(whole)
    return dealt.select("source", "source_size", F.least(F.col("stop"), F.col("w") * F.coalesce(chosen, F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, times, and the columns of ``carry``; one row per input row."""
    size = word_count(F.col("text"))
    kept = {f"_c{i}": F.col(c) for i, c in enumerate(carry)}
    rows = docs.select("doc_id", "source", size.alias("size"), *[c.alias(k) for k, c in kept.items()], (weight if weight is not None else prose_weight(F.col("text"), size)).alias("weight"))
    rows = store(rows.select("doc_id", "source", "size", *kept, (-F.log(unit(F.col("doc_id"))) / F.col("weight")).alias("key")), "sizes")
    n = rows.count()
    buckets = max(64, -(-4 * n // BUCKET_ROWS))
    place = F.floor((1.0 - 1.0 / (1.0 + F.col("key"))) * buckets)
    rows = rows.withColumn("bucket", F.least(place, F.lit(buckets - 1)))

    totals = store(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "totals")
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = totals.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole", "rest", "before", "words")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))

    inside = (F.col("before") + F.col("words")) <= F.col("rest")
    outside = (F.col("before") > F.col("rest")) & ~inside
    clear = placed.filter(inside | outside).withColumn("more", inside.cast("long"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *kept).rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.filter(~(inside | outside))
    run = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    cut = cut.withColumn("more", (run <= F.col("rest")).cast("long"))
    times = F.col("whole") + F.col("more")
    return clear.unionByName(cut).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *[F.col(k).alias(c) for k, c in zip(kept, carry)])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(coalesce(text, '')) AS chars,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), keyed AS (
  SELECT *, -ln(u) / (1.0 / (1.0 + abs(chars::DOUBLE / greatest(size, 1) - 7.0))) AS key FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / w AS ratio FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level,
    row_number() OVER (ORDER BY ratio, w, source NULLS LAST) AS place
  FROM ranked WINDOW p AS (ORDER BY ratio, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(stop, w * coalesce((SELECT arg_min(level, place) FROM levels WHERE ratio >= level), 'inf'::DOUBLE)) AS target FROM levels
), run AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + k.size / 2.0 AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
