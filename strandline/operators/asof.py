"""Nearest-sample joins: linear in the samples, one shuffle by key, no interpolation unless asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip


def nearest(reference: DataFrame, target: DataFrame, keys: list[str], time: str = "t", values: list[str] | None = None, order: str = "sample_index") -> DataFrame:
    """Each reference row with the nearest target row of its key.

    Adds target_t, the target's ``values`` and dt_ns = target - reference. Equal distances go to
    the earlier sample; of samples at one time an exact hit takes the first by ``order``, an
    earlier neighbour is the last and a later one the first. NULLs where the key has no target.

    Both sides are laid along one time line per key; the neighbours are the last sample before
    and the first after, so the work is one sort, whatever the rates.
    """
    values = values or []
    both = bracket(reference, target, keys, time, values, order)
    before, after = F.col("before"), F.col("after")
    d_before, d_after = F.col(time) - before["t"], after["t"] - F.col(time)
    pick = F.when(before.isNull(), after).when(after.isNull() | (d_before <= d_after), before).otherwise(after)
    out = both.withColumn("pick", F.when(after.isNotNull() & (d_after == 0), after).otherwise(pick))
    return out.select(*reference.columns, F.col("pick.t").alias("target_t"), *[F.col(f"pick.{v}").alias(v) for v in values], (F.col("pick.t") - F.col(time)).alias("dt_ns"))


def bracket(reference: DataFrame, target: DataFrame, keys: list[str], time: str, values: list[str], order: str) -> DataFrame:
    """Reference rows with structs ``before`` (strictly earlier) and ``after`` (at or after) of the target."""
    sample = F.struct(F.col(time).alias("t"), *values)
    left = reference.withColumns({"_is_target": F.lit(0), "_at": F.col(time), "_order": F.lit(0).cast("long"), "_sample": F.lit(None).cast(target.select(sample.alias("s")).schema["s"].dataType)})
    right = target.select(*keys, F.col(time).alias("_at"), F.col(order).cast("long").alias("_order"), F.lit(1).alias("_is_target"), sample.alias("_sample"))
    line = left.unionByName(right, allowMissingColumns=True)
    # At one time references stand before targets: so "before" is strictly earlier and "after" at or later.
    w = Window.partitionBy(*keys).orderBy("_at", "_is_target", "_order")
    before = F.last("_sample", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_sample", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    # The frame that looks ahead is a running one over the reverse order.
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_is_target"), F.desc("_order"))
    after = F.last("_sample", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return line.withColumns({"before": before, "after": after}).where("_is_target = 0").select(*reference.columns, "before", "after")


def flagged(joined: DataFrame, tolerance_ns: Column | int) -> DataFrame:
    """valid and quality by tolerance; the nearest sample stays even where it is too far."""
    tolerance = tolerance_ns if isinstance(tolerance_ns, Column) else F.lit(tolerance_ns)
    valid = F.coalesce(F.abs("dt_ns") <= tolerance, F.lit(False))
    return joined.withColumns({"valid": valid, "quality": F.when(valid, F.greatest(F.lit(0.0), 1 - F.abs("dt_ns") / tolerance)).otherwise(0.0)})


def blanked(joined: DataFrame, values: list[str], tolerance_ns: int) -> DataFrame:
    """Values are NULL beyond the tolerance; dt_ns stays."""
    return joined.withColumns({v: F.when(F.abs("dt_ns") <= tolerance_ns, F.col(v)) for v in values})


def cadence_tolerance(reference_s: Column, target_s: Column, low: float = 0.020, high: float = 2.0) -> Column:
    """Half of both median intervals together, within bounds, in seconds."""
    return clip(0.5 * reference_s + 0.5 * target_s, low, high)


def timeline(reference: DataFrame, streams: dict[str, DataFrame], keys: list[str], tolerance_ns: int, order: str = "sample_index") -> DataFrame:
    """One wide row per reference sample: for each stream, in name order, t, dt_ns, valid and quality."""
    out = reference
    for name in sorted(streams):
        joined = flagged(nearest(out, streams[name], keys, order=order), tolerance_ns)
        out = joined.withColumnsRenamed({"target_t": f"{name}_t", "dt_ns": f"{name}_dt_ns", "valid": f"{name}_valid", "quality": f"{name}_quality"})
    return out


def interpolated(reference: DataFrame, target: DataFrame, keys: list[str], value: str, tolerance_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Linear between both neighbours if each is within the tolerance, else the nearest one that is; with the reason."""
    both = bracket(reference, target, keys, time, [value], order)
    t0, t1, v0, v1 = F.col("before.t"), F.col("after.t"), F.col(f"before.{value}"), F.col(f"after.{value}")
    near0, near1 = F.coalesce(F.col(time) - t0 <= tolerance_ns, F.lit(False)), F.coalesce(t1 - F.col(time) <= tolerance_ns, F.lit(False))
    lerp = v0 + (v1 - v0) * ((F.col(time) - t0) / (t1 - t0))
    out = F.when(t1 == F.col(time), v1).when(near0 & near1, lerp).when(near0, v0).when(near1, v1)
    reason = F.when(t1 == F.col(time), "exact").when(near0 & near1, "bracketed").when(near0 | near1, "nearest").when(t0.isNull() & t1.isNull(), "no samples").otherwise("too far")
    return both.select(*reference.columns, out.alias(value), reason.alias("reason"))


def backward(reference: DataFrame, target: DataFrame, keys: list[str], values: list[str], time: str = "t", order: str = "sample_index") -> DataFrame:
    """The last target at or before each reference row; the first one where none is."""
    both = bracket(reference, target, keys, time, values, order)
    pick = F.when(F.col("after.t") == F.col(time), F.col("after")).otherwise(F.coalesce("before", "after"))
    return both.withColumn("pick", pick).select(*reference.columns, F.col("pick.t").alias("target_t"), *[F.col(f"pick.{v}").alias(v) for v in values])


def sync_report(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute dt in ms per key: mean, median, p95, max, and pairs."""
    ms = F.abs("dt_ns") / 1e6
    return joined.groupBy(*keys).agg(
        F.count("dt_ns").alias("n_pairs"), F.avg(ms).alias("mean_ms"), F.percentile(ms, 0.5).alias("median_ms"), F.percentile(ms, 0.95).alias("p95_ms"), F.max(ms).alias("max_ms"),
    )


def grid(target: DataFrame, keys: list[str], step_ns: int, tolerance_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """A regular grid over each key's span with the nearest real sample; points beyond the tolerance are dropped.

    Adds sample, dt_ns and reuse, the number of grid points that share the sample.
    """
    spans = target.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    points = spans.select(*keys, F.explode(F.sequence("_t0", "_t1", F.lit(step_ns).cast("long"))).alias(time))
    joined = nearest(points, target, keys, time, [order], order).where(F.abs("dt_ns") <= tolerance_ns)
    return joined.withColumn("reuse", F.count("*").over(Window.partitionBy(*keys, order)))


def grid_frames(target: DataFrame, keys: list[str], step_ns: int | None, time: str = "t", order: str = "sample_index") -> DataFrame:
    """The real samples nearest to a regular grid over each key's span, each at most once; without a step all of them.

    Times of a key must rise strictly: the first that doesn't is an error.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    checked = F.when(F.col(time) <= F.lag(time).over(w), F.raise_error(F.lit("times must rise strictly"))).otherwise(F.col(time))
    rows = target.withColumn(time, checked)
    if step_ns is None:
        return rows.select(*keys, order, time)
    points = rows.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    points = points.select(*keys, F.explode(F.sequence("_t0", "_t1", F.lit(step_ns).cast("long"))).alias(time))
    picked = nearest(points, rows, keys, time, [order], order)
    return picked.select(*keys, order, F.col("target_t").alias(time)).distinct()


def grid_tolerance_ns(step_ns: Column, period_ns: Column) -> Column:
    """Half a grid step or half a frame's period, whichever is longer."""
    return F.greatest(step_ns, period_ns) / 2


def reindexed(reference: DataFrame, target: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Every reference row with the values of the target at exactly its keys and time; NULL where there is none."""
    return reference.join(target.select(*on, *values), on, "left")
