"""Events and the windows around them: detection, clipping, response against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_reasons
from .interval import within
from .islands import ordered


def detect(df: DataFrame, keys: list[str], rules: dict[str, Column], min_s: float = 0.0, time: str = "t", order: str = "sample_index") -> DataFrame:
    """One event per run of each rule: kind, start, end, duration_s and an id kind_000 by start within kind."""
    w = ordered(keys, time, order)
    on = {kind: F.coalesce(flag, F.lit(False)) for kind, flag in rules.items()}
    # All rules' runs come from one sort; only rows in a run are told apart by rule, and the keys' partitioning serves the grouping.
    rows = df.withColumns({f"_on{i}": flag for i, flag in enumerate(on.values())})
    new = [(~F.col(f"_on{i}").eqNullSafe(F.lag(f"_on{i}").over(w))).cast("int") for i in range(len(on))]
    rows = rows.withColumns({f"_new{i}": c for i, c in enumerate(new)})
    run = [F.sum(f"_new{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in range(len(on))]
    rows = rows.withColumns({f"_run{i}": c for i, c in enumerate(run)})
    each = F.array(*[F.when(F.col(f"_on{i}"), F.struct(F.lit(kind).alias("kind"), F.col(f"_run{i}").alias("run"))) for i, kind in enumerate(on)])
    told = rows.select(*keys, time, F.explode(F.array_compact(each)).alias("_r")).select(*keys, time, "_r.kind", "_r.run")
    found = told.groupBy(*keys, "kind", "run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples")).drop("run")
    found = found.withColumn("duration_s", (F.col("end") - F.col("start")) / 1e9).where(F.col("duration_s") >= min_s)
    found = found.select(*keys, "start", "end", "n_samples", "duration_s", "kind")
    w = Window.partitionBy(*keys, "kind").orderBy("start")
    return found.withColumn("event_name", F.format_string("%s_%03d", "kind", F.row_number().over(w)))


#: Kinds raised where a matched track comes near a feature: column of the distance, kind, metres.
NEAR = [("distance_to_junction_m", "junction_crossing", 30.0), ("distance_to_signals_m", "traffic_signals", 40.0), ("distance_to_crossing_m", "pedestrian_crossing", 25.0)]


def road_events(matched: DataFrame, keys: list[str], bend: float = 0.02, slow: float = 0.5, least_s: float = 1.0, near: list[tuple[str, str, float]] = NEAR, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Events that the map and the speed define: kind, start, end, peak, and progress, way and class at the peak.

    ``matched`` has route_progress_m, way_id, road_class, is_roundabout, curvature, speed_mps and the
    distances of ``near``; NULL raises nothing. An event ends at the first sample after its run, or
    the last sample. Its peak is the nearest sample to a feature, the sharpest of a curve, the middle
    of a roundabout or a straight, the first of a stop; the first of equals. Curves and straights last
    ``least_s`` at least. A junction's approach ends at the crossing's peak. A change of class is
    raised where a sample has one and the sample before another or none.
    """
    w = ordered(keys, time, order)
    curve = F.abs("curvature")
    # family: (flag, what is least at the peak)
    runs = {"roundabout": (F.col("is_roundabout"), None)} | {kind: (F.col(c) <= limit, F.col(c)) for c, kind, limit in near}
    runs |= {"curve": (curve >= bend, -curve), "straight": (curve < bend, None), "stop": (F.col("speed_mps") < slow, None)}
    here = F.struct(F.col(time).alias("t"), F.col("route_progress_m").alias("progress"), F.col("way_id").alias("way"), F.col("road_class").alias("cls"))
    rows = matched.withColumns({"_n": F.row_number().over(w), "_here": here} | {f"_on{i}": F.coalesce(flag, F.lit(False)) for i, (flag, _) in enumerate(runs.values())})
    rows = rows.withColumns({"_next": F.lead("_here").over(w), "_then": F.lead(time, 2).over(w), "_back": F.lag("_here").over(w)} | {f"_new{i}": (~F.col(f"_on{i}").eqNullSafe(F.lag(f"_on{i}").over(w))).cast("int") for i in range(len(runs))})
    rows = rows.withColumns({f"_run{i}": F.sum(f"_new{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in range(len(runs))})
    rows = rows.withColumns({"_end": F.coalesce("_next.t", time), "_far": F.coalesce("_then", "_next.t", time)})

    event = lambda kind, start, end, peak: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), peak.alias("at"))
    each = F.array(*[F.when(F.col(f"_on{i}"), F.struct(F.lit(kind).alias("family"), F.col(f"_run{i}").alias("run"), (F.lit(None) if least is None else least).cast("double").alias("least"))) for i, (kind, (_, least)) in enumerate(runs.items())])
    told = rows.select(*keys, F.struct("_n", "_here", "_next", "_end", "_far").alias("r"), F.explode(F.array_compact(each)).alias("f")).select(*keys, "f.*", "r")
    # The row in the middle needs the run's length: one pass over the run's rows, which spill.
    run = Window.partitionBy(*keys, "family", "run")
    middle = F.col("r._n") == F.min("r._n").over(run) + F.floor(F.count("*").over(run) / 2)
    found = told.withColumn("_m", middle).groupBy(*keys, "family", "run").agg(
        F.min("r").alias("a"), F.max("r").alias("b"), F.min(F.struct("least", "r")).alias("best"), F.max(F.when(F.col("_m"), F.col("r"))).alias("mid"))
    a, b, best, mid = (lambda part: F.col(f"a.{part}")), (lambda part: F.col(f"b.{part}")), (lambda part: F.col(f"best.r.{part}")), (lambda part: F.col(f"mid.{part}"))
    start, end, peak = a("_here.t"), b("_end"), best("_here")
    family = lambda kind: F.col("family") == kind
    long = (b("_here.t") - start) / 1e9 >= least_s
    events = [F.when(family("roundabout"), event(*e)) for e in (("roundabout_traverse", start, end, mid("_here")), ("roundabout_entry", start, a("_end"), a("_here")), ("roundabout_exit", b("_here.t"), end, b("_here")))]
    events += [F.when(family(kind), event(kind, start, end, peak)) for _, kind, _ in near]
    events += [F.when(family("junction_crossing"), event("junction_approach", start, F.when(best("_n") > a("_n"), best("_here.t")).otherwise(a("_end")), a("_here")))]
    events += [F.when(family("curve") & long, event("curve", start, end, peak)), F.when(family("straight") & long, event("straight", start, end, mid("_here")))]
    events += [F.when(family("stop"), event("stop", start, end, a("_here"))), F.when(family("stop") & b("_next").isNotNull(), event("restart", b("_here.t"), b("_far"), b("_next")))]
    raised = found.select(*keys, F.explode(F.array_compact(F.array(*events))).alias("e"))
    other = F.col("_back").isNotNull() & F.col("road_class").isNotNull() & ~F.col("road_class").eqNullSafe(F.col("_back.cls"))
    raised = raised.unionByName(rows.where(other).select(*keys, event("road_class_change", F.col("_back.t"), F.col("_end"), F.col("_here")).alias("e")))
    return raised.select(*keys, "e.kind", "e.start", "e.end", F.col("e.at.t").alias("peak"), F.col("e.at.progress").alias("route_progress_m"), F.col("e.at.way").alias("way_id"), F.col("e.at.cls").alias("road_class"))


def windows(events: DataFrame, spec: DataFrame, spans: DataFrame, keys: list[str], event_id: str, contaminating: list[str] | None = None, bucket_ns: int = 60_000_000_000, reasons: bool = False) -> DataFrame:
    """Windows of each event from spec(name, from_s, to_s).

    Offsets from 0 on are laid at the event's end, others at its start (so is the window named
    ``event``). Windows are clipped to the recording of ``spans(start0, end0)``, and trimmed by
    other families' contaminating events between the window's far end and the event. Only what
    overlaps a window can trim it, so both meet in buckets of bucket_ns; choose it near the
    windows' length. With ``reasons`` a column tells what clipped a window.
    """
    at_end = (F.col("from_s") >= 0) & (F.col("window") != "event")
    anchor = F.when(at_end, F.col("end")).otherwise(F.col("start"))
    # spec is a handful of rows, as configuration.
    laid = events.join(F.broadcast(spec.withColumnRenamed("name", "window")), how="cross").join(spans, keys)
    laid = laid.withColumns({"want_a": anchor + F.rint(F.col("from_s") * 1e9).cast("long"), "want_b": anchor + F.rint(F.col("to_s") * 1e9).cast("long")})
    laid = laid.withColumns({"a": F.greatest("want_a", "start0"), "b": F.least("want_b", "end0")})
    if contaminating:
        other = events.where(F.col("kind").isin(contaminating)).select(*keys, F.col("kind").alias("_kind"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        spread = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket_ns), F.floor(F.greatest(a, b) / bucket_ns))))
        cut = spread(laid.select(*keys, event_id, "window", "kind", "start", "end", "a", "b"), "a", "b")
        cross = cut.join(spread(other, "_s", "_e"), [*keys, "_b"]).where(F.col("_kind") != F.col("kind"))
        before = F.max(F.when((F.col("_e") > F.col("a")) & (F.col("_e") <= F.col("start")) & (F.col("_s") < F.col("b")), F.col("_e")))
        after = F.min(F.when((F.col("_s") >= F.col("end")) & (F.col("_e") > F.col("a")) & (F.col("_s") < F.col("b")), F.col("_s")))
        trims = cross.groupBy(*keys, event_id, "window").agg(before.alias("trim_a"), after.alias("trim_b"))
        laid = laid.join(trims, [*keys, event_id, "window"], "left").withColumns({"a": F.greatest("a", "trim_a"), "b": F.least("b", "trim_b")})
    else:
        laid = laid.withColumns({"trim_a": F.lit(None).cast("long"), "trim_b": F.lit(None).cast("long")})
    laid = laid.withColumn("b", F.greatest("a", "b"))
    clipped = (F.col("a") != F.col("want_a")) | (F.col("b") != F.col("want_b"))
    why = all_reasons([
        (F.col("start0") > F.col("want_a"), "recording starts later"), (F.col("end0") < F.col("want_b"), "recording ends earlier"),
        (F.coalesce(F.col("trim_a") > F.greatest("want_a", "start0"), F.lit(False)), "event of another kind before"), (F.coalesce(F.col("trim_b") < F.least("want_b", "end0"), F.lit(False)), "event of another kind after"),
    ])
    out = laid.select(*keys, event_id, "kind", "window", F.col("a").alias("start"), F.col("b").alias("end"), clipped.alias("clipped"), why.alias("clip_reason"))
    return out if reasons else out.drop("clip_reason")


def summarise(laid: DataFrame, samples: DataFrame, keys: list[str], event_id: str, value: str, bucket_ns: int, least: int = 2) -> DataFrame:
    """Mean and count of a signal in each window, both ends included; no mean below ``least`` samples."""
    hits = within(samples.select(*keys, "t", value), laid, keys, bucket_ns).groupBy(*keys, event_id, "window").agg(F.count(value).alias("n"), F.avg(value).alias("_mean"))
    out = laid.join(hits, [*keys, event_id, "window"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("mean_value", F.when(F.col("n") >= least, F.col("_mean"))).drop("_mean")


def response(summary: DataFrame, keys: list[str], event_id: str, names: list[str], baseline: str) -> DataFrame:
    """One row per event: a column per window, and each window's difference from the baseline."""
    wide = summary.groupBy(*keys, event_id, "kind").pivot("window", names).agg(F.first("mean_value"))
    return wide.withColumns({f"{n}_delta": F.col(n) - F.col(baseline) for n in names if n != baseline})


def phases(events: DataFrame, samples: DataFrame, keys: list[str], event_id: str, value: str, reach_ns: int, bucket_ns: int) -> DataFrame:
    """Mean before, during and after each event, half-open; phases without samples are left out."""
    parts = F.array(
        F.struct(F.lit("pre").alias("phase"), (F.col("start") - reach_ns).alias("a"), F.col("start").alias("b")),
        F.struct(F.lit("event").alias("phase"), F.col("start").alias("a"), F.col("end").alias("b")),
        F.struct(F.lit("post").alias("phase"), F.col("end").alias("a"), (F.col("end") + reach_ns).alias("b")),
    )
    laid = events.select(*keys, event_id, F.explode(parts).alias("p")).select(*keys, event_id, "p.phase", F.col("p.a").alias("start"), F.col("p.b").alias("end"))
    hits = within(samples.select(*keys, "t", value), laid, keys, bucket_ns, closed=False)
    return hits.groupBy(*keys, event_id, "phase").agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def polarity(df: DataFrame, keys: list[str], flag: str, most_share: float = 0.35, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Which value of a two-valued flag means closed: the rarer one, if its runs are shorter too; else undecided."""
    from .islands import ordered, runs

    w = ordered(keys, time, order)
    rows = runs(df.where(F.col(flag).isNotNull()).withColumn("_dt", F.lead(time).over(w) - F.col(time)), keys, F.col(flag), time, order)
    step = rows.groupBy(*keys).agg(F.percentile("_dt", 0.5).alias("step"))
    lengths = rows.groupBy(*keys, flag, "run_id").agg((F.max(time) - F.min(time)).alias("len"), F.count("*").alias("n"))
    # A single sample lasts one interval.
    lengths = lengths.join(step, keys).withColumn("len", F.when(F.col("n") == 1, F.col("step")).otherwise(F.col("len")))
    by = lengths.groupBy(*keys).agg(
        F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias("n_true"), F.sum("n").alias("n"),
        F.percentile(F.when(F.col(flag), F.col("len")), 0.5).alias("len_true"), F.percentile(F.when(~F.col(flag), F.col("len")), 0.5).alias("len_false"),
    )
    share = F.col("n_true") / F.col("n")
    closed = F.when((share <= most_share) & (F.col("len_true") < F.col("len_false")), "true").when((1 - share <= most_share) & (F.col("len_false") < F.col("len_true")), "false").otherwise("undecided")
    return by.select(*keys, "n", "n_true", closed.alias("closed_value"))


def window_statistics(samples: DataFrame, windows: DataFrame, keys: list[str], window_id: str, bucket_ns: int, closed: Column, value: str) -> DataFrame:
    """In any windows(start, end): samples, closures a minute (rises of ``closed``), share closed, median value, and mean step of the value."""
    w = Window.partitionBy(*keys).orderBy("t", "sample_index")
    flagged = samples.withColumn("_closed", F.coalesce(closed, F.lit(False)))
    marked = flagged.withColumns({"_rise": F.col("_closed") & ~F.coalesce(F.lag("_closed").over(w), F.lit(False)), "_step": F.abs(F.col(value) - F.lag(value).over(w))})
    inside = within(marked, windows.select(*keys, window_id, "start", "end"), keys, bucket_ns)
    minutes = (F.first("end") - F.first("start")) / 6e10
    return inside.groupBy(*keys, window_id).agg(
        F.count("*").alias("n"), F.try_divide(F.count_if("_rise"), minutes).alias("closures_per_minute"), F.avg(F.col("_closed").cast("double")).alias("closed_share"),
        F.percentile(value, 0.5).alias("median_value"), F.avg("_step").alias("mean_step"),
    )
