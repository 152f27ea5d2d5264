"""Stream quality: rates, gaps, segments, clock fit, disorder, duplicates, failure flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import quantiles


def stored(keys: list[str], order: str = "sample_index"):
    """Storage order: rates and gaps look at samples as they were written, so that disorder shows."""
    return Window.partitionBy(*keys).orderBy(order)


def with_dt(df: DataFrame, keys: list[str], time: str = "t", order: str = "sample_index") -> DataFrame:
    w = stored(keys, order)
    return df.withColumns({"prev_t": F.lag(time).over(w), "dt": F.col(time) - F.lag(time).over(w)})


def rates(df: DataFrame, keys: list[str], time: str = "t", order: str = "sample_index") -> DataFrame:
    """Count, span rate, median rate, spread of dt in seconds, and how many dt aren't positive or are zero."""
    dt = F.col("dt") / 1e9
    span = (F.max(time) - F.min(time)) / 1e9
    return with_dt(df, keys, time, order).groupBy(*keys).agg(
        F.count("*").alias("n"), F.try_divide(F.count("*") - 1, span).alias("span_rate_hz"), F.try_divide(F.lit(1.0), F.percentile(dt, 0.5)).alias("median_rate_hz"),
        F.avg(dt).alias("dt_mean_s"), F.stddev_pop(dt).alias("dt_std_s"), F.min(dt).alias("dt_min_s"), F.max(dt).alias("dt_max_s"),
        F.percentile(dt, 0.01).alias("dt_p01_s"), F.percentile(dt, 0.99).alias("dt_p99_s"), F.count_if(F.col("dt") <= 0).alias("n_not_increasing"), F.count_if(F.col("dt") == 0).alias("n_duplicate"),
    )


def gaps(df: DataFrame, keys: list[str], absolute_ns: int, factor: float = 1.5, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Steps longer than factor medians or than absolute_ns (off where the median reaches it), or not positive.

    missing is the half-even rounded number of periods less one.
    """
    steps = with_dt(df, keys, time, order)
    median = steps.groupBy(*keys).agg(F.percentile("dt", 0.5).alias("median_dt"))
    rows = steps.join(median, keys)
    absolute = (F.col("median_dt") < absolute_ns) & (F.col("dt") > absolute_ns)
    periods = F.try_divide(F.col("dt"), F.col("median_dt"))
    found = rows.where((F.col("dt") > factor * F.col("median_dt")) | absolute | (F.col("dt") <= 0))
    return found.select(
        *keys, F.col(order).alias("index_after"), F.col("prev_t").alias("t_before"), F.col(time).alias("t_after"), (F.col("dt") / 1e6).alias("dt_ms"), periods.alias("periods"),
        F.greatest(F.lit(0).cast("long"), F.rint(periods).cast("long") - 1).alias("missing"), absolute.alias("over_absolute"), (F.col("dt") <= 0).alias("not_increasing"),
    )


def segments(df: DataFrame, keys: list[str], absolute_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Stretches without a break: longer than two medians or absolute_ns, whichever is less, or not positive."""
    steps = with_dt(df, keys, time, order)
    median = steps.groupBy(*keys).agg(F.percentile("dt", 0.5).alias("median_dt"))
    limit = F.least(2 * F.col("median_dt"), F.lit(float(absolute_ns)))
    broken = F.coalesce((F.col("dt") > limit) | (F.col("dt") <= 0), F.lit(False))
    marked = steps.join(median, keys).withColumn("segment", F.sum(broken.cast("int")).over(stored(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "segment").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def clock_fit(df: DataFrame, keys: list[str], time: str = "t", order: str = "sample_index") -> DataFrame:
    """Least-squares line of time on sample number: period, and residuals' largest size and spread, in seconds."""
    w = stored(keys, order)
    rows = df.withColumn("k", (F.row_number().over(w) - 1).cast("double")).withColumn("s", (F.col(time) - F.min(time).over(Window.partitionBy(*keys))) / 1e9)
    fit = rows.groupBy(*keys).agg(F.regr_slope("s", "k").alias("slope"), F.regr_intercept("s", "k").alias("icept"))
    residual = F.col("s") - (F.col("icept") + F.col("slope") * F.col("k"))
    return rows.join(fit, keys).withColumn("r", residual).groupBy(*keys).agg(
        F.first("slope").alias("period_s"), F.max(F.abs("r")).alias("max_residual_s"), F.stddev_pop("r").alias("residual_std_s"), F.max_by("r", "k").alias("last_residual_s")
    )


def reordered(df: DataFrame, keys: list[str], time: str = "t", order: str = "sample_index") -> DataFrame:
    """Samples that a stable sort by time moves."""
    by_time = Window.partitionBy(*keys).orderBy(time, order)
    moved = (F.row_number().over(stored(keys, order)) != F.row_number().over(by_time)).cast("int")
    return df.withColumn("_moved", moved).groupBy(*keys).agg(F.sum("_moved").alias("n_reordered"), F.count("*").alias("n"))


def flicker(df: DataFrame, keys: list[str], present, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Rows absent between two present ones, and pairs of rows absent between present ones."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    rows = df.withColumn("_on", F.coalesce(present, F.lit(False))).withColumns({"_b": F.lag("_on").over(w), "_a": F.lead("_on").over(w), "_aa": F.lead("_on", 2).over(w)})
    one, two = F.col("_b") & ~F.col("_on") & F.col("_a"), F.col("_b") & ~F.col("_on") & ~F.col("_a") & F.col("_aa")
    return rows.groupBy(*keys).agg(F.count_if(one).alias("dropouts_1"), F.count_if(two).alias("dropouts_2"), F.count_if("_on").alias("n_present"))


def outliers(df: DataFrame, keys: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows strictly beyond the key's own quantiles, with a severity from 0 to 1 by rank of excess."""
    q = quantiles(df, keys, value, {"q_low": low, "q_high": high})
    flag = F.when(F.col(value) > F.col("q_high"), "high").when(F.col(value) < F.col("q_low"), "low")
    span = F.col("q_high") - F.col("q_low")
    excess = F.when(F.col(value) > F.col("q_high"), F.col(value) - F.col("q_high")).otherwise(F.col("q_low") - F.col(value))
    severity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(excess, span)))
    return df.join(q, keys).withColumn("flag", flag).where("flag is not null").withColumn("severity", severity)


def duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that repeat an earlier row's key, with the first one's order value."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({"first_of": F.first(order).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)}).where("_n > 1").drop("_n")
