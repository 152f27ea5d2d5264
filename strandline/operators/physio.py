"""Pulse and pupil: peaks, intervals, variability in windows, quality reasons, light residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_reasons, clip, ratio
from . import asof, frames
from .islands import ordered


def peaks(df: DataFrame, keys: list[str], value: str, least: float, refractory_ns: int, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Local maxima of at least ``least`` that are the largest within refractory_ns on both sides, the first of equals."""
    w = ordered(keys, time, order)
    near = frames.around(keys, refractory_ns, time)
    rows = df.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w), "_m": F.max(value).over(near)})
    rows = rows.withColumn("_first", F.min(F.when(F.col(value) == F.col("_m"), F.col(time))).over(near))
    top = (F.col(value) >= least) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_a")) & (F.col(value) == F.col("_m")) & (F.col("_first") == F.col(time))
    return rows.where(top).drop("_b", "_a", "_m", "_first")


def beats(found: DataFrame, keys: list[str], low_ms: float = 333.0, high_ms: float = 1500.0, most_change: float = 0.3, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Interval to the beat before, rate, and all reasons against it."""
    w = ordered(keys, time, order)
    ibi = (F.col(time) - F.lag(time).over(w)) / 1e6
    rows = found.withColumn("ibi_ms", ibi).withColumn("local_ms", F.percentile("ibi_ms", F.lit(0.5)).over(frames.beside(keys, 5, time, order)))
    change = F.abs(F.col("ibi_ms") - F.col("local_ms")) / F.col("local_ms")
    reason = all_reasons([(F.col("ibi_ms").isNull(), "first beat"), (F.col("ibi_ms") < low_ms, "too short"), (F.col("ibi_ms") > high_ms, "too long"), (change > most_change, "irregular")])
    return rows.withColumns({"heart_rate_bpm": ratio(F.lit(60_000.0), F.col("ibi_ms")), "reason": reason}).withColumn("valid", F.col("reason").isNull())


def variability(rows: DataFrame, keys: list[str], block: str, least_beats: int = 5) -> DataFrame:
    """Per block: beats, mean rate, RMSSD and pNN50 over neighbouring valid beats, SDNN; NULL and a refusal below the least."""
    w = Window.partitionBy(*keys, block).orderBy("t", "sample_index")
    steps = rows.withColumn("_d", F.when(F.col("valid") & F.lag("valid").over(w), F.col("ibi_ms") - F.lag("ibi_ms").over(w)))
    some = F.when(F.col("valid"), F.col("ibi_ms"))
    out = steps.groupBy(*keys, block).agg(
        F.count(some).alias("n_beats"), F.avg(60_000 / some).alias("_hr"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("_rmssd"), F.stddev_samp(some).alias("_sdnn"),
        F.avg(F.when(F.abs("_d") > 50, 1.0).when(F.col("_d").isNotNull(), 0.0)).alias("_pnn50"),
    )
    enough = F.col("n_beats") >= least_beats
    named = {n: F.when(enough, F.col(f"_{n}")) for n in ("hr", "rmssd", "sdnn", "pnn50")}
    return out.withColumns(named).withColumn("refusal", F.when(~enough, "too few beats")).drop("_hr", "_rmssd", "_sdnn", "_pnn50")


def window_quality(df: DataFrame, keys: list[str], value: str, block: str, low: float, high: float, least: int, most_flat: float = 0.2) -> DataFrame:
    """Per block: samples, share at the limits, share of equal neighbours, spread, and all reasons against using it."""
    w = Window.partitionBy(*keys, block).orderBy("t", "sample_index")
    flat = (F.col(value) == F.lag(value).over(w)).cast("int")
    stats = df.withColumn("_flat", F.coalesce(flat, F.lit(0))).groupBy(*keys, block).agg(
        F.count(value).alias("n"), F.avg(((F.col(value) <= low) | (F.col(value) >= high)).cast("int")).alias("saturated"), F.avg("_flat").alias("flat"), F.stddev_pop(value).alias("spread")
    )
    reason = all_reasons([(F.col("n") < least, "dropout"), (F.col("saturated") > 0.1, "saturation"), (F.col("flat") > most_flat, "flat"), (F.coalesce(F.col("spread"), F.lit(0.0)) < 1e-9, "no signal")])
    return stats.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def light_residual(pupil: DataFrame, light: DataFrame, keys: list[str], tolerance_ns: int, least: int = 32) -> DataFrame:
    """Pupil less what log10(lux + 1) explains, per key; NULL below ``least`` pairs or where light hardly varies."""
    lit = light.withColumnRenamed("value", "lux")
    joined = asof.blanked(asof.nearest(pupil, lit, keys, values=["lux"]), ["lux"], tolerance_ns).withColumn("log_lux", F.log10(clip(F.col("lux"), 0, 1e12) + 1))
    ok = (F.regr_count("value", "log_lux") >= least) & (F.stddev_pop("log_lux") >= 1e-6)
    fit = joined.groupBy(*keys).agg(F.when(ok, F.regr_slope("value", "log_lux")).alias("slope"), F.when(ok, F.regr_intercept("value", "log_lux")).alias("icept"))
    return joined.join(fit, keys).withColumn("residual", F.col("value") - (F.col("icept") + F.col("slope") * F.col("log_lux")))


def tagged(found: DataFrame, windows: DataFrame, keys: list[str], usable: str, reason: str, quality: str) -> DataFrame:
    """Beats with the quality of the last window that starts at or before them (the first one where none does), invalid in an unusable one."""
    near = asof.backward(found, windows, keys, [usable, reason, quality])
    bad = ~F.coalesce(usable, F.lit(True))
    why = F.when(bad & F.col("valid"), F.concat(F.lit("window rejected: "), F.coalesce(reason, F.lit("unknown"))))
    return near.select(*[c for c in found.columns if c != "valid"], F.col(quality).alias("sqi"), (F.col("valid") & ~bad).alias("valid"), why.alias("rejected"))
