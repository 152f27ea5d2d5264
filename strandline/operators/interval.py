"""Joins of points and intervals by buckets of time, so that they are equi-joins with a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def associate(frames: DataFrame, samples: DataFrame, keys: list[str], width_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """All samples within width_ns of a frame (both ends count): sorted indices and signed dts, and the nearest."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width_ns))
    near = samples.select(*keys, F.col(time).alias("_s"), F.col(order).alias("_i"), bucket(time).alias("_b"))
    spread = frames.withColumn("_b", F.explode(F.array(*[bucket(time) + d for d in (-1, 0, 1)])))
    pair = F.struct((F.col("_s") - F.col(time)).alias("dt"), F.col("_i").alias("i"))
    hit = spread.join(near, [*keys, "_b"]).where(F.abs(F.col("_s") - F.col(time)) <= width_ns)
    best = F.min_by(F.col("_i"), F.struct(F.abs(F.col("_s") - F.col(time)), F.col("_s"), F.col("_i")))
    # Sorted within a frame's window only; a window holds what the rate allows in width_ns.
    grouped = hit.groupBy(*frames.columns).agg(F.array_sort(F.collect_list(pair)).alias("pairs"), best.alias("nearest"))
    return grouped.select(*frames.columns, F.size("pairs").alias("n"), F.col("pairs.i").alias("indices"), F.col("pairs.dt").alias("dts"), "nearest")


def within(points: DataFrame, intervals: DataFrame, keys: list[str], bucket_ns: int, closed: bool = True, time: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Points with the intervals that hold them: start <= t <= end, or t < end if not ``closed``.

    An interval is repeated for each bucket it touches, so choose bucket_ns near the usual length.
    """
    b = lambda c: F.floor(c / F.lit(bucket_ns))
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    upper = F.col(time) <= F.col(end) if closed else F.col(time) < F.col(end)
    return points.withColumn("_b", b(F.col(time))).join(spread, [*keys, "_b"]).where((F.col(time) >= F.col(start)) & upper).drop("_b")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], pad_ns: int = 0, how: str = "left_semi", start: str = "start", end: str = "end") -> DataFrame:
    """Rows of a that some b overlaps (left_semi) or none does (left_anti), b widened by pad_ns on both sides.

    Some b overlaps a row exactly if, of the b that start by the row's end, the latest end reaches
    the row's start: a running maximum along one time line per key, with no pairs at all. Rows
    with a NULL bound overlap nothing.
    """
    mine = a.withColumns({"_at": F.col(end), "_kind": F.lit(1), "_reach": F.lit(None).cast("long")})
    other = b.select(*keys, (F.col(start) - pad_ns).alias("_at"), F.lit(0).alias("_kind"), (F.col(end) + pad_ns).cast("long").alias("_reach"))
    w = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_last(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    line = mine.unionByName(other.where("_at is not null"), allowMissingColumns=True).withColumn("_latest", F.max("_reach").over(w))
    hit = F.coalesce((F.col("_latest") >= F.col(start)) & F.col(end).isNotNull(), F.lit(False))
    return line.where((F.col("_kind") == 1) & (hit if how == "left_semi" else ~hit)).select(*a.columns)


def first_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_order: str, values: list[str], bucket_ns: int, start: str = "start", end: str = "end") -> DataFrame:
    """Each row of a with the first b, by b_order, that overlaps it; NULLs if none does.

    a_id names a row within its key. Both sides meet in the buckets they touch.
    """
    spread = lambda df, lo, hi: df.where(F.col(hi) >= F.col(lo)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ns), F.floor(F.col(hi) / bucket_ns))))
    other = spread(b.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), F.struct(F.col(b_order).alias("_order"), *values).alias("_row")), "_start", "_end")
    met = spread(a.select(*keys, a_id, start, end), start, end).join(other, [*keys, "_b"]).where((F.col("_start") <= F.col(end)) & (F.col(start) <= F.col("_end")))
    first = met.groupBy(*keys, a_id).agg(F.min_by("_row", "_row._order").alias("_first"))
    return a.join(first, [*keys, a_id], "left").select(*a.columns, *[F.col(f"_first.{v}").alias(f"first_{v}") for v in values])
