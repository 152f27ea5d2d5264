"""Directions and attention: angular speed, scan paths, blink categories, head and eye, attention bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_reason, ratio
from .interval import overlapping, within
from .islands import ordered, runs


def angular_speed(df: DataFrame, keys: list[str], yaw: str, pitch: str, out: str = "speed_deg_s", time: str = "t", order: str = "sample_index") -> DataFrame:
    """Great-circle speed to the next direction in degrees a second; the last row takes the one before."""
    w = ordered(keys, time, order)
    dot = F.sin(pitch) * F.sin(F.lead(pitch).over(w)) + F.cos(pitch) * F.cos(F.lead(pitch).over(w)) * F.cos(F.lead(yaw).over(w) - F.col(yaw))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    speed = F.try_divide(angle, (F.lead(time).over(w) - F.col(time)) / 1e9)
    return df.withColumn("_v", F.when(F.lead(time).over(w).isNotNull(), speed)).withColumn(out, F.coalesce("_v", F.lag("_v").over(w))).drop("_v")


def masked_rate(df: DataFrame, keys: list[str], value: str, valid: str, out: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Forward difference per second where this row and the next are valid; the last row by its own flag."""
    w = ordered(keys, time, order)
    ahead = F.try_divide(F.lead(value).over(w) - F.col(value), (F.lead(time).over(w) - F.col(time)) / 1e9)
    behind = F.try_divide(F.col(value) - F.lag(value).over(w), (F.col(time) - F.lag(time).over(w)) / 1e9)
    last = F.lead(time).over(w).isNull()
    return df.withColumn(out, F.when(last & F.col(valid), behind).when(F.col(valid) & F.lead(valid).over(w), ahead))


def scan_path(df: DataFrame, keys: list[str], u: str, v: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Path length, dispersion hypot(sd, sd) with n in the divisor, mean distance from the origin, step quantiles."""
    w = ordered(keys, time, order)
    step = F.hypot(F.col(u) - F.lag(u).over(w), F.col(v) - F.lag(v).over(w))
    return df.withColumn("_step", step).groupBy(*keys).agg(
        F.sum("_step").alias("path_length"), F.hypot(F.stddev_pop(u), F.stddev_pop(v)).alias("dispersion"), F.avg(F.hypot(u, v)).alias("eccentricity"),
        F.percentile("_step", 0.5).alias("step_median"), F.percentile("_step", 0.95).alias("step_p95"),
    )


def attention(df: DataFrame, keys: list[str], label: str, n_labels: int, off: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Per key: samples, valid share, entropy, visits, changes, longest glance at ``off`` (samples times the median interval)."""
    w = ordered(keys, time, order)
    marked = runs(df.withColumn("_dt", F.lead(time).over(w) - F.col(time)), keys, F.col(label), time, order)
    step = marked.groupBy(*keys).agg((F.percentile("_dt", 0.5) / 1e9).alias("interval_s"), F.count("*").alias("n"), F.count(label).alias("n_valid"), F.count_distinct("run_id").alias("n_runs"))
    share = marked.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("c")).withColumn("_p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    spread = share.groupBy(*keys).agg((-F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.lit(n_labels))).alias("entropy"), F.max(F.when(F.col(label) == off, F.col("_p"))).alias("off_share"))
    glances = marked.where(F.col(label) == off).groupBy(*keys, "run_id").agg(F.count("*").alias("len")).groupBy(*keys).agg(F.count("*").alias("n_glances"), F.max("len").alias("longest"))
    out = step.join(spread, keys, "left").join(glances, keys, "left")
    return out.select(
        *keys, "n", ratio(F.col("n_valid"), F.col("n")).alias("valid_share"), "entropy", F.coalesce("off_share", F.lit(0.0)).alias("off_share"), "n_runs", F.coalesce("n_glances", F.lit(0)).alias("n_glances"),
        (F.coalesce("longest", F.lit(0)) * F.col("interval_s")).alias("longest_glance_s"),
    )


def short_runs(df: DataFrame, keys: list[str], label: str, most_s: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs of a label of at most most_s (last minus first), their number per second of recording."""
    lengths = runs(df, keys, F.col(label), time, order).groupBy(*keys, "run_id").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return lengths.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.count_if((F.col("b") - F.col("a")) / 1e9 <= most_s).alias("n_short"),
        F.try_divide(F.count_if((F.col("b") - F.col("a")) / 1e9 <= most_s).cast("double"), (F.max("b") - F.min("a")) / 1e9).alias("short_per_s"),
    )


def closures(df: DataFrame, keys: list[str], left: str, right: str, left_ok: str, right_ok: str, max_gap_ns: int, short_s: float, long_s: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs in which either eye is closed, parted by gaps, in categories.

    duration is last minus first plus the median interval. Categories in order: uncertain (an eye
    unknown in over half), partial (never both), blink, long, prolonged.
    """
    w = ordered(keys, time, order)
    rows = df.withColumns({"_l": F.when(F.col(left_ok), F.col(left)), "_r": F.when(F.col(right_ok), F.col(right)), "_dt": F.lead(time).over(w) - F.col(time)})
    closed = F.coalesce("_l", F.lit(False)) | F.coalesce("_r", F.lit(False))
    step = rows.groupBy(*keys).agg(F.percentile("_dt", 0.5).alias("_step"))
    marked = runs(rows.withColumn("_c", closed), keys, F.col("_c"), time, order, max_gap_ns).where("_c")
    table = marked.groupBy(*keys, "run_id").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.count_if(F.col("_l") & F.col("_r")).alias("n_both"),
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("n_unknown"),
    )
    timed = table.join(step, keys).withColumn("duration_s", (F.col("end") - F.col("start") + F.col("_step")) / 1e9)
    kind = first_reason([(2 * F.col("n_unknown") > F.col("n"), "uncertain"), (F.col("n_both") == 0, "partial"), (F.col("duration_s") <= short_s, "blink"), (F.col("duration_s") <= long_s, "long")], "prolonged")
    return timed.withColumn("category", kind).drop("_step", "run_id")


def head_assisted(eye: DataFrame, head: DataFrame, keys: list[str], pad_ns: int) -> DataFrame:
    """Eye excursions with and without a head excursion around them, and the share with."""
    both = overlapping(eye, head, keys, pad_ns, "left_semi").withColumn("assisted", F.lit(True)).unionByName(overlapping(eye, head, keys, pad_ns, "left_anti").withColumn("assisted", F.lit(False)))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("assisted").alias("n_assisted"), ratio(F.count_if("assisted"), F.count("*")).alias("assisted_share"))


def continuity(df: DataFrame, keys: list[str], present: Column, solid: float = 0.8, dashed: float = 0.2, switches_per_s: float = 0.5, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Line continuity from the share of presence and the changes a second: solid, dashed, absent or unclear."""
    w = ordered(keys, time, order)
    rows = df.withColumn("_on", present.cast("int"))
    change = (F.col("_on") != F.lag("_on").over(w)).cast("int")
    stats = rows.withColumn("_ch", F.coalesce(change, F.lit(0))).groupBy(*keys).agg(F.avg("_on").alias("duty"), F.sum("_ch").alias("switches"), ((F.max(time) - F.min(time)) / 1e9).alias("span_s"))
    rate = F.coalesce(F.try_divide(F.col("switches").cast("double"), F.col("span_s")), F.lit(0.0))
    kind = first_reason([(F.col("duty") >= solid, "solid"), ((F.col("duty") >= dashed) & (rate >= switches_per_s), "dashed"), (F.col("duty") < dashed, "absent")], "unclear")
    return stats.withColumns({"switches_per_s": rate, "state": kind})


def crossings(df: DataFrame, keys: list[str], offset: str, error: str, limit_m: float, min_s: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs with |offset| of limit_m and more for min_s and more, with a verdict.

    Not evaluable where the mean position error exceeds the mean displacement.
    """
    marked = runs(df.withColumn("_out", F.coalesce(F.abs(offset) >= limit_m, F.lit(False))), keys, F.col("_out"), time, order).where("_out")
    table = marked.groupBy(*keys, "run_id").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.avg(offset).alias("mean_offset_m"), F.avg(error).alias("mean_error_m"), F.max(F.abs(offset)).alias("largest_m")
    )
    long = table.withColumn("duration_s", (F.col("end") - F.col("start")) / 1e9).where(F.col("duration_s") >= min_s)
    verdict = first_reason([(F.col("mean_error_m").isNull() | (F.col("mean_error_m") > F.abs("mean_offset_m")), "not evaluable"), (F.col("largest_m") >= 2 * limit_m, "clear"), (F.col("n") >= 3, "likely")], "weak")
    return long.withColumns({"verdict": verdict, "crossed_negative": F.col("mean_offset_m") < 0}).drop("run_id")


def rolled_up(classes: DataFrame, levels: int = 8) -> DataFrame:
    """classes(class_id, class_name, parent_id) with the name of the top ancestor, by at most ``levels`` parent joins.

    Stops early once nothing moves; a cycle ends at the last level.
    """
    out = classes.select("class_id", "class_name", F.coalesce("parent_id", "class_id").alias("top_id"))
    up = classes.select(F.col("class_id").alias("top_id"), F.coalesce("parent_id", "class_id").alias("next_id"))
    for _ in range(levels):
        out = out.join(up, "top_id", "left").select("class_id", "class_name", F.coalesce("next_id", "top_id").alias("top_id"))
    return out.join(classes.select(F.col("class_id").alias("top_id"), F.col("class_name").alias("group_name")), "top_id", "left").select("class_id", "class_name", "group_name")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key repeats on either side."""
    for name, side in (("left", a), ("right", b)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys repeat on the {name} side")
    return a.join(b, keys)


def recovered(short: DataFrame, matched: DataFrame, keys: list[str], label: str, other: str, bucket_ns: int) -> DataFrame:
    """Short runs of run A (start, end, label) whose matched rows in run B (t, other) never show the label."""
    own = short.select(*keys, "start", "end", F.col(label).alias("_label"))
    rows = matched.select(*keys, "t", F.col(other).alias("_other"))
    joined = within(rows, own, keys, bucket_ns)
    seen = joined.groupBy(*keys, "start", "end", "_label").agg(F.bool_or(F.col("_other") == F.col("_label")).alias("seen"), F.count("*").alias("n"))
    return seen.where(~F.col("seen")).select(*keys, "start", "end", F.col("_label").alias(label), "n")
