"""Runs of rows: gaps and islands, episodes, excursions, fixations, label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], time: str = "t", order: str = "sample_index"):
    return Window.partitionBy(*keys).orderBy(time, order)


def runs(df: DataFrame, keys: list[str], state: Column, time: str = "t", order: str = "sample_index", max_gap_ns: int | None = None) -> DataFrame:
    """df with run_id: a new run where ``state`` changes, or after a longer gap than max_gap_ns."""
    w = ordered(keys, time, order)
    changed = ~state.eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)
    if max_gap_ns is not None:
        changed = changed | F.coalesce(F.col(time) - F.lag(time).over(w) > max_gap_ns, F.lit(False))
    return df.withColumn("_new", changed.cast("int")).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_table(df: DataFrame, keys: list[str], flag: Column, time: str = "t", order: str = "sample_index", max_gap_ns: int | None = None) -> DataFrame:
    """Runs in which ``flag`` is true: start, end, n_samples, duration_s (last minus first)."""
    marked = runs(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, F.col("_flag"), time, order, max_gap_ns)
    table = marked.where("_flag").groupBy(*keys, "run_id").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples"))
    return table.withColumn("duration_s", (F.col("end") - F.col("start")) / 1e9)


def episodes(df: DataFrame, keys: list[str], value: str, flag: Column, min_s: float = 0.0, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs of ``flag`` of at least min_s: mean, and peak = largest |value| with the sign of the mean."""
    marked = runs(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, F.col("_flag"), time, order)
    table = marked.where("_flag").groupBy(*keys, "run_id").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples"), F.avg(value).alias("mean_value"),
        (F.max(F.abs(value)) * F.signum(F.avg(value))).alias("peak_value"),
    )
    return table.withColumn("duration_s", (F.col("end") - F.col("start")) / 1e9).where(F.col("duration_s") >= min_s)


def excursions(df: DataFrame, keys: list[str], value: str, boundary: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs beyond +-boundary, of one sign each: direction, and the value at the first largest |value|."""
    side = F.when(F.col(value) > boundary, 1).when(F.col(value) < -boundary, -1).otherwise(0)
    marked = runs(df.withColumn("_side", side), keys, F.col("_side"), time, order)
    first_peak = F.max_by(F.col(value), F.struct(F.abs(value), -F.col(time), -F.col(order)))
    return marked.where("_side <> 0").groupBy(*keys, "run_id").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples"), F.signum(F.avg(value)).alias("direction"), first_peak.alias("peak_value")
    )


def fixations(df: DataFrame, keys: list[str], slow: Column, max_gap_ns: int, min_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Groups of slow rows that bridge short excursions.

    A slow row starts a group if the row just before it isn't slow and stands more than max_gap_ns
    after the previous slow row; neighbouring slow rows are never parted. Groups of two rows and
    more that last at least min_ns stay, with dense ids from 0.
    """
    w = ordered(keys, time, order)
    rows = df.withColumn("_slow", F.coalesce(slow, F.lit(False)))
    rows = rows.withColumns({"_before_slow": F.lag("_slow").over(w), "_before_t": F.lag(time).over(w)}).where("_slow")
    last = F.lag(time).over(w)
    new = last.isNull() | (~F.coalesce("_before_slow", F.lit(False)) & (F.col("_before_t") - last > max_gap_ns))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy(*keys, "_group").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples"))
    groups = groups.where((F.col("n_samples") >= 2) & (F.col("end") - F.col("start") >= min_ns))
    return groups.withColumn("fixation_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).drop("_group")


def transitions(df: DataFrame, keys: list[str], label: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Counts of label changes from one row to the next; NULL labels are left out before."""
    w = ordered(keys, time, order)
    steps = df.where(F.col(label).isNotNull()).withColumn("to_label", F.lead(label).over(w))
    changed = steps.where(F.col("to_label").isNotNull() & (F.col("to_label") != F.col(label)))
    return changed.groupBy(*keys, F.col(label).alias("from_label"), "to_label").agg(F.count("*").alias("n"))


def visits(df: DataFrame, keys: list[str], label: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Per label: samples, visits (runs) and revisits (runs less one)."""
    marked = runs(df, keys, F.col(label), time, order)
    table = marked.groupBy(*keys, label).agg(F.count("*").alias("n_samples"), F.count_distinct("run_id").alias("visits"))
    return table.withColumn("revisits", F.col("visits") - 1)


def changes(df: DataFrame, keys: list[str], state: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Rows where ``state`` isn't NULL and differs from the row before (NULL differs too), with ``previous``."""
    w = ordered(keys, time, order)
    rows = df.withColumns({"previous": F.lag(state).over(w), "_row": F.row_number().over(w)})
    return rows.where((F.col("_row") > 1) & F.col(state).isNotNull() & ~F.col(state).eqNullSafe(F.col("previous"))).drop("_row")


def returns(df: DataFrame, keys: list[str], label: str, interval_s: float, time: str = "t") -> DataFrame:
    """Per key and label: seconds from the key's first row to the label's first, and its returns a minute.

    A return is a gap of over two intervals between the label's rows; the minutes are the key's rows
    times the interval.
    """
    whole = df.groupBy(*keys).agg(F.min(time).alias("_first"), (F.count("*") * interval_s / 60).alias("_minutes"))
    gap = (F.col(time) - F.lag(time).over(Window.partitionBy(*keys, label).orderBy(time))) / 1e9
    by = df.withColumn("_gap", gap).groupBy(*keys, label).agg(F.min(time).alias("_at"), F.count_if(F.col("_gap") > 2 * interval_s).alias("_n"))
    return by.join(whole, keys).select(*keys, label, ((F.col("_at") - F.col("_first")) / 1e9).alias("time_to_first_s"), F.try_divide(F.col("_n"), F.col("_minutes")).alias("returns_per_minute"))


def off_runs(df: DataFrame, keys: list[str], valid: Column, inside: Column, interval_s: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs of rows that are invalid or not inside, per key: number, seconds (rows times the interval), longest, mean, and runs without any valid row."""
    ok = F.coalesce(valid, F.lit(False))
    marked = runs(df.withColumns({"_ok": ok, "_off": ~(ok & F.coalesce(inside, F.lit(False)))}), keys, F.col("_off"), time, order)
    table = marked.where("_off").groupBy(*keys, "run_id").agg((F.count("*") * interval_s).alias("s"), (~F.bool_or("_ok")).alias("blind"))
    return table.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum("s").alias("total_s"), F.max("s").alias("longest_s"), F.avg("s").alias("mean_s"), F.count_if("blind").alias("n_blind"))
