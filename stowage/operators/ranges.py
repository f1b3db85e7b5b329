"""Joins on intervals: Spark has no operator for them and would compare all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned_range_join(points: DataFrame, spans: DataFrame, *, at: str, begin: str, end: str, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """points joined to spans of the same ``keys`` with begin <= at < end.

    Either side gets the numbers of the bins of ``width`` it touches and is joined on those; a point has one bin, so
    no pair is found twice.  Spans need an end; choose a width near their usual length.
    """
    bins = F.sequence(F.floor(F.col(begin) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width)))
    right = spans.filter(F.col(end) > F.col(begin)).withColumn("_bin", F.explode(bins))
    left = points.withColumn("_bin", F.floor(F.col(at) / F.lit(width)))
    on = [left[k] == right[k] for k in keys] + [left["_bin"] == right["_bin"], left[at] >= right[begin], left[at] < right[end]]
    joined = left.join(right, on, how)
    for k in keys:
        joined = joined.drop(right[k])
    return joined.drop(left["_bin"]).drop(right["_bin"])


def as_of_join(points: DataFrame, marks: DataFrame, *, at: str, mark: str, keys: list[str], values: list[str], bucket: Callable[[Column], Column] = lambda _: F.lit(0)) -> DataFrame:
    """points with ``values`` of the latest row of marks (same keys) whose ``mark`` is at or before ``at``; null before the first.

    Both sides are sorted together once, with a running last value; nothing is compared pairwise.  ``bucket`` cuts a key's
    time line into stretches that are sorted apart, so a hot key is no single task's: it is a rising function of at and mark,
    such as ``lambda t: F.floor(t / 3600)``.  A stretch starts with the last value of the ones before.
    """
    fill = [F.lit(None).cast(marks.schema[v].dataType).alias(v) for v in values]
    own = points.columns
    left = points.select(*own, F.col(at).alias("_at"), F.lit(1).alias("_side"), *[f.alias("_" + v) for f, v in zip(fill, values)])
    nulls = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own if c not in keys]
    right = marks.select(*keys, *nulls, F.col(mark).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias("_" + v) for v in values])
    both = left.unionByName(right).withColumn("_stretch", bucket(F.col("_at")))
    packed = F.when(F.col("_side") == 0, F.struct(*["_" + v for v in values]))
    before = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last(packed, ignorenulls=True).over(before)).filter("_side = 1")
    ends = both.groupBy(*keys, "_stretch").agg(F.max_by(packed, F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    joined = found.join(carried, [*keys, "_stretch"]).withColumn("_found", F.coalesce("_found", "_carried"))
    return joined.select(*own, *[F.col("_found")["_" + v].alias(v) for v in values])


def cumulative_offset(order: list[Column], keys: list[str], size: str = "size") -> Column:
    """Where a row begins if rows of the same keys lie end to end in ``order``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")


def slices(reads: DataFrame, parts: DataFrame, *, keys: list[str], width: int) -> DataFrame:
    """Reads (offset, length) cut at the parts' borders: (keys, read columns, idx, part_offset, slice_length)."""
    bins = lambda a, b: F.sequence(F.floor(a / F.lit(width)), F.floor((b - 1) / F.lit(width)))
    r = reads.filter("length > 0").withColumn("_bin", F.explode(bins(F.col("offset"), F.col("offset") + F.col("length"))))
    p = parts.filter("size > 0").select(*keys, F.col("idx"), F.col("offset").alias("p_from"), (F.col("offset") + F.col("size")).alias("p_to"))
    p = p.withColumn("_bin", F.explode(bins(F.col("p_from"), F.col("p_to"))))
    j = r.join(p, [*keys, "_bin"])
    low = F.greatest(F.col("offset"), F.col("p_from"))
    high = F.least(F.col("offset") + F.col("length"), F.col("p_to"))
    # a pair that shares several bins counts in the first of them only
    once = j.filter((high > low) & (F.col("_bin") == F.floor(low / F.lit(width))))
    return once.select(*keys, "offset", "length", "idx", (low - F.col("p_from")).alias("part_offset"), (high - low).alias("slice_length"))
