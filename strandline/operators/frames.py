"""Window-frame operators: differences, gradients, moving statistics, blocks and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import ordered


def forward_difference(df: DataFrame, keys: list[str], value: str, out: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Next minus this; the last row takes the difference before."""
    w = ordered(keys, time, order)
    ahead, behind = F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w)
    return df.withColumn(out, F.coalesce(ahead, behind))


def gradient(df: DataFrame, keys: list[str], value: str, out: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Second-order gradient on uneven times (first order at the ends), per second, over rows with a value."""
    w = ordered(keys, time, order)
    some = df.where(F.col(value).isNotNull())
    hd, hs = (F.col(time) - F.lag(time).over(w)) / 1e9, (F.lead(time).over(w) - F.col(time)) / 1e9
    before, after, f = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    inner = F.try_divide(hd * hd * after + (hs * hs - hd * hd) * f - hs * hs * before, hs * hd * (hd + hs))
    return some.withColumn(out, F.when(before.isNotNull() & after.isNotNull(), inner).when(after.isNotNull(), F.try_divide(after - f, hs)).otherwise(F.try_divide(f - before, hd)))


def around(keys: list[str], half_ns: int, time: str = "t"):
    """Frame of all rows within half_ns, both ends included."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(-half_ns, half_ns)


def beside(keys: list[str], half: int, time: str = "t", order: str = "sample_index"):
    """Frame of half rows on both sides."""
    return ordered(keys, time, order).rowsBetween(-half, half)


def moving_average(value: str, keys: list[str], half_ns: int, time: str = "t") -> Column:
    return F.avg(value).over(around(keys, half_ns, time)) if half_ns > 0 else F.col(value)


def moving_median(value: str, keys: list[str], half_ns: int, time: str = "t") -> Column:
    return F.percentile(value, F.lit(0.5)).over(around(keys, half_ns, time))


def moving_rms(value: str, keys: list[str], half: int) -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)).over(beside(keys, half)))


def blocks(df: DataFrame, keys: list[str], length_ns: int, out: str = "block", time: str = "t") -> DataFrame:
    """Number of the tumbling block from the key's first sample."""
    first = F.min(time).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.floor((F.col(time) - first) / length_ns))


def sliding(df: DataFrame, keys: list[str], length_ns: int, step_ns: int, aggregates: list[Column], time: str = "t") -> DataFrame:
    """Full windows [start, start + length) only, from the key's first sample, step by step; empty ones too.

    Each sample goes to the windows that hold it, at most ceil(length / step) of them.
    """
    spans = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1")).where(F.col("_t1") - F.col("_t0") >= length_ns)
    starts = spans.select(*keys, F.posexplode(F.sequence(F.col("_t0"), F.col("_t1") - length_ns, F.lit(step_ns).cast("long"))).alias("window", "start"))
    rel = F.col(time) - F.col("_t0")
    low = F.greatest(F.lit(0), F.floor((rel - length_ns) / step_ns) + 1)
    high = F.floor(rel / step_ns)
    last = F.floor((F.col("_t1") - F.col("_t0") - length_ns) / step_ns)
    placed = df.join(spans, keys).where(low <= F.least(high, last)).withColumn("window", F.explode(F.sequence(low.cast("int"), F.least(high, last).cast("int"))))
    return starts.join(placed.groupBy(*keys, "window").agg(*aggregates), [*keys, "window"], "left")


def unwrapped_degrees(df: DataFrame, keys: list[str], angle: str, out: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Angles made continuous: the wrapped steps summed from the first value on."""
    w = ordered(keys, time, order)
    step = F.pmod(F.col(angle) - F.lag(angle).over(w) + 180.0, F.lit(360.0)) - 180.0
    return df.withColumn("_step", F.coalesce(step, F.col(angle))).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
