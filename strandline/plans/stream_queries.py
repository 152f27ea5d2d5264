"""Queries on sample streams: rates, gaps, nearest joins, grids, frames, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, frames, interval, islands, quality
from .base import HOUR, KS, K, S, query, r6, rounded, samples

R = lambda x: f"round({x}, 6) + 0.0"
R3 = lambda x: f"round({x}, 3) + 0.0"
DT = f"with {S}, d as (select *, lag(t) over w as prev_t, t - lag(t) over w as dt from s window w as (partition by recording_id, stream order by sample_index)), m as (select recording_id, stream, quantile_cont(dt, 0.5) as median_dt from d group by all)"


@query(f"""{DT} select recording_id, stream, count(*) as n, {R('1e3 * (count(*) - 1) / nullif((max(t) - min(t)) / 1e9, 0)')} as span_rate_mhz, {R('1e3 / nullif(quantile_cont(dt / 1e9, 0.5), 0)')} as median_rate_mhz,
{R3('avg(dt / 1e9)')} as dt_mean_s, {R3('stddev_pop(dt / 1e9)')} as dt_std_s, {R3('min(dt / 1e9)')} as dt_min_s, {R3('max(dt / 1e9)')} as dt_max_s, {R3('quantile_cont(dt / 1e9, 0.01)')} as dt_p01_s,
{R3('quantile_cont(dt / 1e9, 0.99)')} as dt_p99_s, count(*) filter (dt <= 0) as n_not_increasing, count(*) filter (dt = 0) as n_duplicate from d group by recording_id, stream""")
def stream_rates(spark, sf_dir):
    found = quality.rates(samples(spark, sf_dir), KS)
    mhz = [rounded(1e3 * F.col(f"{c}_hz")).alias(f"{c}_mhz") for c in ("span_rate", "median_rate")]
    seconds = [rounded(F.col(c), 3).alias(c) for c in found.columns if c.endswith("_s")]
    return found.select(*KS, "n", *mhz, *seconds, "n_not_increasing", "n_duplicate")


GAPS = f"""{DT}, g as (select d.*, median_dt, dt / nullif(median_dt, 0) as periods, (median_dt < {72 * HOUR} and dt > {72 * HOUR}) as over_absolute from d join m using (recording_id, stream))
select recording_id, stream, sample_index as index_after, prev_t as t_before, t as t_after, {R('dt / 1e6')} as dt_ms, {R('periods')} as periods,
greatest(0, round_even(periods, 0)::bigint - 1) as missing, over_absolute, dt <= 0 as not_increasing from g where dt > 1.5 * median_dt or over_absolute or dt <= 0"""


@query(GAPS)
def stream_gaps(spark, sf_dir):
    return r6(quality.gaps(samples(spark, sf_dir), KS, 72 * HOUR))


@query(f"with x as ({GAPS}) select recording_id, stream, count(*) as n_gaps, sum(missing)::bigint as missing, {R('max(dt_ms)')} as longest_ms, count(*) filter (over_absolute) as n_over from x group by all")
def gap_summary(spark, sf_dir):
    found = quality.gaps(samples(spark, sf_dir), KS, 72 * HOUR)
    return r6(found.groupBy(*KS).agg(F.count("*").alias("n_gaps"), F.sum("missing").alias("missing"), F.max("dt_ms").alias("longest_ms"), F.count_if("over_absolute").alias("n_over")))


@query(f"""{DT}, b as (select d.*, sum(case when dt > least(2 * median_dt, {72 * HOUR}) or dt <= 0 then 1 else 0 end) over (partition by recording_id, stream order by sample_index) as segment from d join m using (recording_id, stream))
select recording_id, stream, segment::bigint as segment, min(t) as start, max(t) as end, count(*) as n from b group by recording_id, stream, segment""")
def stream_segments(spark, sf_dir):
    return quality.segments(samples(spark, sf_dir), KS, 72 * HOUR)


@query(f"""with {S}, k as (select *, row_number() over (partition by recording_id order by sample_index) - 1 as k, (t - min(t) over (partition by recording_id)) / 1e9 as sec from s),
f as (select recording_id, regr_slope(sec, k) as sl, regr_intercept(sec, k) as ic from k group by all), e as (select k.*, sl, sec - (ic + sl * k) as r from k join f using (recording_id))
select recording_id, round(any_value(sl), 3) + 0.0 as period_s, round(max(abs(r)), 3) + 0.0 as max_residual_s, round(stddev_pop(r), 3) + 0.0 as residual_std_s, round(arg_max(r, k), 3) + 0.0 as last_residual_s from e group by recording_id""")
def stream_clock_fit(spark, sf_dir):
    fit = quality.clock_fit(samples(spark, sf_dir), K)
    return fit.select(*K, *[(F.round(c, 3) + 0.0).alias(c) for c in fit.columns[1:]])


@query(f"""{DT}, x as (select recording_id, stream, (count(*) - 1) / nullif((max(t) - min(t)) / 1e9, 0) as span_rate, 1e9 / nullif(quantile_cont(dt, 0.5), 0) as median_rate from d group by all)
select recording_id, stream, {R('median_rate / span_rate')} as burst_ratio, coalesce(median_rate / span_rate > 2, false) as bursty from x""")
def stream_burstiness(spark, sf_dir):
    rates = quality.rates(samples(spark, sf_dir), KS)
    ratio = F.try_divide(F.col("median_rate_hz"), F.col("span_rate_hz"))
    return r6(rates.select(*KS, ratio.alias("burst_ratio"), F.coalesce(ratio > 2, F.lit(False)).alias("bursty")))


@query(f"""with {S}, m as (select recording_id, (row_number() over (partition by recording_id order by sample_index) <> row_number() over (partition by recording_id order by t, sample_index))::int as moved from s)
select recording_id, sum(moved)::bigint as n_reordered, count(*) as n from m group by all""")
def stream_reordered(spark, sf_dir):
    return quality.reordered(samples(spark, sf_dir), K)


NEAREST = f"""c as (select * from s where stream = 'click'), v as (select * from s where stream = 'view'),
j as (select c.*, v.t as target_t, v.value as view_value, v.t - c.t as dt_ns, row_number() over (partition by c.recording_id, c.sample_index order by abs(v.t - c.t), v.t, v.sample_index) as rn
from c left join v using (recording_id)), n as (select * exclude (rn) from j where rn = 1)"""


@query(f"""with {S}, {NEAREST} select recording_id, sample_index, t, target_t, {R('view_value')} as view_value, dt_ns, coalesce(abs(dt_ns) <= {12 * HOUR}, false) as valid,
case when abs(dt_ns) <= {12 * HOUR} then {R(f'greatest(0, 1 - abs(dt_ns) / {12 * HOUR}.0)')} else 0.0 end as quality from n""")
def asof_nearest_flagged(spark, sf_dir):
    views = samples(spark, sf_dir, "view").withColumnRenamed("value", "view_value")
    joined = asof.flagged(asof.nearest(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), views, K, values=["view_value"]), 12 * HOUR)
    return r6(joined)


@query(f"""with {S}, {NEAREST} select recording_id, sample_index, t, target_t, case when abs(dt_ns) <= {12 * HOUR} then {R('view_value')} end as view_value, dt_ns from n""")
def asof_nearest_blanked(spark, sf_dir):
    views = samples(spark, sf_dir, "view").withColumnRenamed("value", "view_value")
    joined = asof.nearest(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), views, K, values=["view_value"])
    return r6(asof.blanked(joined, ["view_value"], 12 * HOUR))


@query(f"""with {S}, {NEAREST} select recording_id, count(dt_ns) as n_pairs, floor(avg(abs(dt_ns) / 1e6) + 0.25013) as mean_ms, floor(quantile_cont(abs(dt_ns) / 1e6, 0.5) + 0.25013) as median_ms,
floor(quantile_cont(abs(dt_ns) / 1e6, 0.95) + 0.25013) as p95_ms, floor(max(abs(dt_ns) / 1e6) + 0.25013) as max_ms from n group by recording_id""")
def asof_sync_report(spark, sf_dir):
    report = asof.sync_report(asof.nearest(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"), K), K)
    # Whole milliseconds, cut where no quantile of microseconds can lie.
    return report.withColumns({c: F.floor(F.col(c) + 0.25013).cast("double") for c in report.columns if c.endswith("_ms")})


def _timeline_sql(name: str) -> str:
    return f"""{name} as (select c.sample_index, v.t as {name}_t, v.t - c.t as {name}_dt_ns, coalesce(abs(v.t - c.t) <= {24 * HOUR}, false) as {name}_valid,
    case when abs(v.t - c.t) <= {24 * HOUR} then {R(f'greatest(0, 1 - abs(v.t - c.t) / {24 * HOUR}.0)')} else 0.0 end as {name}_quality,
    row_number() over (partition by c.sample_index order by abs(v.t - c.t), v.t, v.sample_index) as rn from c left join (select * from s where stream = '{name}') v using (recording_id))"""


@query(f"""with {S}, c as (select * from s where stream = 'click'), {_timeline_sql('error')}, {_timeline_sql('purchase')}, {_timeline_sql('view')}
select c.recording_id, c.sample_index, c.t, error.* exclude (rn, sample_index), purchase.* exclude (rn, sample_index), view.* exclude (rn, sample_index)
from c join error on c.sample_index = error.sample_index and error.rn = 1 join purchase on c.sample_index = purchase.sample_index and purchase.rn = 1 join view on c.sample_index = view.sample_index and view.rn = 1""")
def asof_timeline(spark, sf_dir):
    others = {name: samples(spark, sf_dir, name) for name in ("view", "error", "purchase")}
    return r6(asof.timeline(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), others, K, 24 * HOUR))


@query(f"""with {S}, d as (select recording_id, stream, t - lag(t) over (partition by recording_id, stream order by t, sample_index) as dt from s), m as (select recording_id, stream, quantile_cont(dt / 1e9, 0.5) as med from d group by all)
select a.recording_id, b.stream, {R('least(greatest(0.5 * a.med + 0.5 * b.med, 0.02), 86400.0)')} as tolerance_s from m a join m b using (recording_id) where a.stream = 'click' and b.stream <> 'click' and a.med is not null and b.med is not null""")
def asof_cadence_tolerance(spark, sf_dir):
    w = Window.partitionBy(*KS).orderBy("t", "sample_index")
    steps = samples(spark, sf_dir).withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 1e9).groupBy(*KS).agg(F.percentile("dt", 0.5).alias("med")).where("med is not null")
    click = steps.where("stream = 'click'").select("recording_id", F.col("med").alias("ref"))
    return r6(steps.where("stream <> 'click'").join(click, K).select(*KS, asof.cadence_tolerance(F.col("ref"), F.col("med"), 0.02, 86400.0).alias("tolerance_s")))


BRACKET = f"""c as (select recording_id, sample_index, t from s where stream = 'click'), v as (select * from s where stream = 'view'),
b as (select c.*, max(v.t) filter (v.t < c.t) as t0, min(v.t) filter (v.t >= c.t) as t1, arg_max(v.value, v.sample_index) filter (v.t < c.t) as v0, arg_min(v.value, v.sample_index) filter (v.t >= c.t) as v1
from c left join v using (recording_id) group by all)"""


@query(f"""with {S}, {BRACKET}, x as (select *, coalesce(t - t0 <= {18 * HOUR}, false) as n0, coalesce(t1 - t <= {18 * HOUR}, false) as n1 from b)
select recording_id, sample_index, t, {R("case when t1 = t then v1 when n0 and n1 then v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) when n0 then v0 when n1 then v1 end")} as value,
case when t1 = t then 'exact' when n0 and n1 then 'bracketed' when n0 or n1 then 'nearest' when t0 is null and t1 is null then 'no samples' else 'too far' end as reason from x""")
def asof_interpolated(spark, sf_dir):
    return r6(asof.interpolated(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), samples(spark, sf_dir, "view"), K, "value", 18 * HOUR))


@query(f"""with {S}, {BRACKET} select recording_id, sample_index, t, case when t1 = t then t1 else coalesce(t0, t1) end as target_t, {R('case when t1 = t then v1 when t0 is not null then v0 else v1 end')} as value from b""")
def asof_backward(spark, sf_dir):
    return r6(asof.backward(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), samples(spark, sf_dir, "view"), K, ["value"]))


@query(f"""with {S}, p as (select recording_id, unnest(range(min(t), max(t) + 1, {24 * HOUR})) as t from s group by recording_id),
j as (select p.recording_id, p.t, s.t as target_t, s.sample_index, s.t - p.t as dt_ns, row_number() over (partition by p.recording_id, p.t order by abs(s.t - p.t), s.t, s.sample_index) as rn from p join s using (recording_id)),
g as (select * from j where rn = 1 and abs(dt_ns) <= {6 * HOUR}) select recording_id, t, target_t, sample_index, dt_ns, count(*) over (partition by recording_id, sample_index) as reuse from g""")
def regular_grid(spark, sf_dir):
    return asof.grid(samples(spark, sf_dir), K, 24 * HOUR, 6 * HOUR)


@query(f"""with {S}, c as (select recording_id, sample_index, t from s where stream = 'click'), v as (select * from s where stream = 'view'),
j as (select c.*, v.sample_index as i, v.t - c.t as dt, v.t as vt from c join v on c.recording_id = v.recording_id and abs(v.t - c.t) <= {24 * HOUR})
select recording_id, sample_index, t, count(*)::int as n, list(i order by dt, i)::varchar as indices, list(dt order by dt, i)::varchar as dts, first(i order by abs(dt), vt, i) as nearest from j group by all""")
def window_association(spark, sf_dir):
    found = interval.associate(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t"), samples(spark, sf_dir, "view"), K, 24 * HOUR)
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    return found.withColumns({"indices": text("indices"), "dts": text("dts")})


IV = f"iv as (select recording_id, sample_index as iv_id, t as start, t + {36 * HOUR} as end from s where stream = 'purchase')"


def _intervals(spark, sf_dir):
    return samples(spark, sf_dir, "purchase").select("recording_id", F.col("sample_index").alias("iv_id"), F.col("t").alias("start"), (F.col("t") + 36 * HOUR).alias("end"))


@query(f"with {S}, {IV} select iv.recording_id, iv_id, count(*) as n, {R('avg(value)')} as mean_value from iv join s on s.recording_id = iv.recording_id and s.t between iv.start and iv.end group by all")
def interval_inclusive(spark, sf_dir):
    hits = interval.within(samples(spark, sf_dir), _intervals(spark, sf_dir), K, 36 * HOUR)
    return r6(hits.groupBy("recording_id", "iv_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query(f"with {S}, {IV} select iv.recording_id, iv_id, count(*) as n, {R('avg(value)')} as mean_value from iv join s on s.recording_id = iv.recording_id and s.t >= iv.start and s.t < iv.end group by all")
def interval_half_open(spark, sf_dir):
    hits = interval.within(samples(spark, sf_dir), _intervals(spark, sf_dir), K, 36 * HOUR, closed=False)
    return r6(hits.groupBy("recording_id", "iv_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


ERR = f"er as (select recording_id, sample_index as er_id, t as start, t + {12 * HOUR} as end from s where stream = 'error')"


def _errors(spark, sf_dir):
    return samples(spark, sf_dir, "error").select("recording_id", F.col("sample_index").alias("er_id"), F.col("t").alias("start"), (F.col("t") + 12 * HOUR).alias("end"))


_OVER = f"er.recording_id = iv.recording_id and er.start - {6 * HOUR} <= iv.end and iv.start <= er.end + {6 * HOUR}"


@query(f"with {S}, {IV}, {ERR} select iv.* from iv where exists (select 1 from er where {_OVER})")
def interval_overlap_semi(spark, sf_dir):
    return interval.overlapping(_intervals(spark, sf_dir), _errors(spark, sf_dir), K, 6 * HOUR, "left_semi")


@query(f"with {S}, {IV}, {ERR} select iv.* from iv where not exists (select 1 from er where {_OVER})")
def interval_overlap_anti(spark, sf_dir):
    return interval.overlapping(_intervals(spark, sf_dir), _errors(spark, sf_dir), K, 6 * HOUR, "left_anti")


@query(f"""with {S}, {IV}, {ERR}, j as (select iv.*, er_id as first_er_id, row_number() over (partition by iv.recording_id, iv_id order by er_id nulls last) as rn
from iv left join er on er.recording_id = iv.recording_id and er.start <= iv.end and iv.start <= er.end) select * exclude (rn) from j where rn = 1""")
def interval_first_overlap(spark, sf_dir):
    return interval.first_overlap(_intervals(spark, sf_dir), _errors(spark, sf_dir), K, "iv_id", "er_id", ["er_id"], 36 * HOUR)


W = "window w as (partition by recording_id order by t, sample_index)"


@query(f"""with {S}, d as (select recording_id, sample_index, t, value, lag(t) over w as pt, lead(t) over w as nt, lag(value) over w as pv, lead(value) over w as nv from s {W})
select recording_id, sample_index, {R('coalesce(nv - value, value - pv)')} as step, {R('''1e5 * case when pv is not null and nv is not null then
 (((t - pt) / 1e9) * ((t - pt) / 1e9) * nv + (((nt - t) / 1e9) * ((nt - t) / 1e9) - ((t - pt) / 1e9) * ((t - pt) / 1e9)) * value - ((nt - t) / 1e9) * ((nt - t) / 1e9) * pv) / (((nt - t) / 1e9) * ((t - pt) / 1e9) * (((t - pt) / 1e9) + ((nt - t) / 1e9)))
 when nv is not null then (nv - value) / ((nt - t) / 1e9) else (value - pv) / ((t - pt) / 1e9) end''')} as slope from d""")
def frame_gradient(spark, sf_dir):
    df = frames.gradient(frames.forward_difference(samples(spark, sf_dir), K, "value", "step"), K, "value", "slope")
    return df.select("recording_id", "sample_index", rounded(F.col("step")).alias("step"), rounded(1e5 * F.col("slope")).alias("slope"))


@query(f"""with {S} select recording_id, sample_index, {R('avg(value) over f')} as mean_value, {R('quantile_cont(value, 0.5) over f')} as median_value, {R('sqrt(avg(value * value) over b)')} as rms, {R('quantile_cont(value, 0.5) over b')} as local_median
from s window f as (partition by recording_id order by t range between {36 * HOUR} preceding and {36 * HOUR} following), b as (partition by recording_id order by t, sample_index rows between 3 preceding and 3 following)""")
def frame_moving(spark, sf_dir):
    df = samples(spark, sf_dir)
    return r6(df.select(
        "recording_id", "sample_index", frames.moving_average("value", K, 36 * HOUR).alias("mean_value"), frames.moving_median("value", K, 36 * HOUR).alias("median_value"),
        frames.moving_rms("value", K, 3).alias("rms"), F.percentile("value", F.lit(0.5)).over(frames.beside(K, 3)).alias("local_median"),
    ))


@query(f"""with {S}, a as (select *, value * 0.72 as ang from s), d as (select *, ang - lag(ang) over w as st from a {W}),
e as (select *, coalesce((((st + 180) % 360) + 360) % 360 - 180, ang) as step from d)
select recording_id, sample_index, {R('sum(step) over w')} as unwrapped, {R('sum(value) over w')} as running, last_value(case when stream = 'view' then sample_index end ignore nulls) over w as last_view from e {W}""")
def frame_cumulative(spark, sf_dir):
    df = frames.unwrapped_degrees(samples(spark, sf_dir).withColumn("angle", F.col("value") * 0.72), K, "angle", "unwrapped")
    w = islands.ordered(K).rowsBetween(Window.unboundedPreceding, 0)
    return r6(df.select("recording_id", "sample_index", "unwrapped", F.sum("value").over(w).alias("running"), F.last(F.when(F.col("stream") == "view", F.col("sample_index")), True).over(w).alias("last_view")))


@query(f"""with {S}, b as (select *, ((t - min(t) over (partition by recording_id)) // {72 * HOUR})::bigint as block from s) select recording_id, block, count(*) as n, {R('avg(value)')} as mean_value from b group by all""")
def frame_blocks(spark, sf_dir):
    return r6(frames.blocks(samples(spark, sf_dir), K, 72 * HOUR).groupBy("recording_id", "block").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query(f"""with {S}, p as (select recording_id, min(t) as t0, max(t) as t1 from s group by all), x as (select recording_id, unnest(range(t0, t1 - {96 * HOUR} + 1, {48 * HOUR})) as start, t0 from p where t1 - t0 >= {96 * HOUR})
select x.recording_id, ((x.start - t0) // {48 * HOUR})::int as window, x.start, nullif(count(s.t), 0) as n, {R('avg(value)')} as mean_value from x left join s on s.recording_id = x.recording_id and s.t >= x.start and s.t < x.start + {96 * HOUR} group by all""")
def frame_sliding(spark, sf_dir):
    return r6(frames.sliding(samples(spark, sf_dir), K, 96 * HOUR, 48 * HOUR, [F.count("*").alias("n"), F.avg("value").alias("mean_value")]))


RUN = f"""with {S}, f as (select *, value > 250 as flag, lag(value > 250) over w as pf from s {W}), i as (select *, sum(case when flag is distinct from pf then 1 else 0 end) over w as run from f {W})"""


@query(f"""{RUN} select recording_id, min(t) as start, max(t) as end, count(*) as n_samples, {R('(max(t) - min(t)) / 1e9')} as duration_s from i where flag group by recording_id, run""")
def island_runs(spark, sf_dir):
    return r6(islands.run_table(samples(spark, sf_dir), K, F.col("value") > 250).drop("run_id"))


@query(f"""with {S}, f as (select *, stream as st, lag(stream) over w as pf, t - lag(t) over w as dt from s {W}), i as (select *, sum(case when st is distinct from pf or dt > {24 * HOUR} then 1 else 0 end) over w as run from f {W})
select recording_id, run::bigint as run_id, any_value(st) as label, min(t) as start, max(t) as end, count(*) as n_samples from i group by recording_id, run""")
def island_label_runs(spark, sf_dir):
    marked = islands.runs(samples(spark, sf_dir), K, F.col("stream"), max_gap_ns=24 * HOUR)
    return marked.groupBy("recording_id", "run_id").agg(F.first("stream").alias("label"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_samples"))


@query(f"""{RUN.replace('value > 250', 'value > 60')}, e as (select recording_id, min(t) as start, max(t) as end, count(*) as n_samples, avg(value) as mean_value, max(abs(value)) * sign(avg(value)) as peak_value from i where flag group by recording_id, run)
select recording_id, start, "end", n_samples, {R('mean_value')} as mean_value, {R('peak_value')} as peak_value, {R('("end" - start) / 1e9')} as duration_s from e where ("end" - start) / 1e9 >= 7200""")
def island_episodes(spark, sf_dir):
    return r6(islands.episodes(samples(spark, sf_dir), K, "value", F.col("value") > 60, 7200.0).drop("run_id"))


@query(f"""with {S}, c as (select *, value - 250 as dev, case when value - 250 > 100 then 1 when value - 250 < -100 then -1 else 0 end as side from s), f as (select *, lag(side) over w as ps from c {W}),
i as (select *, sum(case when side is distinct from ps then 1 else 0 end) over w as run from f {W})
select recording_id, min(t) as start, max(t) as end, count(*) as n_samples, sign(avg(dev))::double as direction, {R('first(dev order by abs(dev) desc, t, sample_index)')} as peak_value from i where side <> 0 group by recording_id, run""")
def island_excursions(spark, sf_dir):
    return r6(islands.excursions(samples(spark, sf_dir).withColumn("dev", F.col("value") - 250), K, "dev", 100.0).drop("run_id"))


@query(f"""with {S}, a as (select *, value < 300 as slow, lag(value < 300) over w as bs, lag(t) over w as bt from s {W}), l as (select *, lag(t) over (partition by recording_id order by t, sample_index) as p from a where slow),
g as (select *, sum(case when p is null or (not coalesce(bs, false) and bt - p > {12 * HOUR}) then 1 else 0 end) over (partition by recording_id order by t, sample_index) as grp from l),
x as (select recording_id, min(t) as start, max(t) as end, count(*) as n_samples from g group by recording_id, grp having count(*) >= 2 and max(t) - min(t) >= {24 * HOUR})
select *, (row_number() over (partition by recording_id order by start) - 1)::int as fixation_id from x""")
def island_fixations(spark, sf_dir):
    return islands.fixations(samples(spark, sf_dir), K, F.col("value") < 300, 12 * HOUR, 24 * HOUR)


@query(f"with {S}, l as (select recording_id, stream as from_label, lead(stream) over w as to_label from s {W}) select recording_id, from_label, to_label, count(*) as n from l where to_label <> from_label group by all")
def label_transitions(spark, sf_dir):
    return islands.transitions(samples(spark, sf_dir), K, "stream")


@query(f"""with {S}, f as (select *, lag(stream) over w as pf from s {W}) select recording_id, stream, count(*) as n_samples, count(*) filter (stream is distinct from pf) as visits, count(*) filter (stream is distinct from pf) - 1 as revisits from f group by all""")
def label_visits(spark, sf_dir):
    return islands.visits(samples(spark, sf_dir), K, "stream")


@query(f"""with {S}, f as (select recording_id, stream = 'view' as o, lag(stream = 'view') over w as b, lead(stream = 'view') over w as a, lead(stream = 'view', 2) over w as aa from s {W})
select recording_id, count(*) filter (b and not o and a) as dropouts_1, count(*) filter (b and not o and not a and aa) as dropouts_2, count(*) filter (o) as n_present from f group by all""")
def label_flicker(spark, sf_dir):
    return quality.flicker(samples(spark, sf_dir), K, F.col("stream") == "view")


@query(f"""with {S}, q as (select stream, quantile_cont(value, 0.1) as ql, quantile_cont(value, 0.9) as qh from s group by all)
select stream, recording_id, sample_index, case when value > qh then 'high' else 'low' end as flag, {R('least(1, greatest(0, case when value > qh then value - qh else ql - value end / (qh - ql)))')} as severity from s join q using (stream) where value > qh or value < ql""")
def quantile_outliers(spark, sf_dir):
    found = quality.outliers(samples(spark, sf_dir), ["stream"], "value")
    return r6(found.select("stream", "recording_id", "sample_index", "flag", "severity"))


@query(f"""with {S}, q as (select quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.6) as hi from s), f as (select *, value < lo or value > hi as flag from s, q), g as (select *, lag(flag) over w as pf from f {W}),
i as (select *, sum(case when flag is distinct from pf then 1 else 0 end) over w as run from g {W}) select recording_id, count(distinct run) filter (flag) as n_runs, count(*) filter (flag) as n_flagged from i group by recording_id""")
def quantile_runs(spark, sf_dir):
    df = samples(spark, sf_dir)
    q = df.agg(F.percentile("value", 0.25).alias("lo"), F.percentile("value", 0.6).alias("hi"))
    marked = islands.runs(df.join(F.broadcast(q), how="cross").withColumn("flag", (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))), K, F.col("flag"))
    return marked.groupBy("recording_id").agg(F.count_distinct(F.when(F.col("flag"), F.col("run_id"))).alias("n_runs"), F.count_if("flag").alias("n_flagged"))


@query(f"""with {S}, f as (select recording_id, sample_index, first_value(value) over b as a, min(value) over (partition by recording_id order by t, sample_index rows between 3 preceding and current row) as lo,
max(value) over (partition by recording_id order by t, sample_index rows between 2 preceding and current row) as hi, count(*) over b as n from s window b as (partition by recording_id order by t, sample_index rows between 3 preceding and current row))
select recording_id, count(*) filter (n = 4 and a > 0.01 and lo > 0 and hi < 0.4 * a) as n_trails from f group by all""")
def temporal_trails(spark, sf_dir):
    w = islands.ordered(K)
    df = samples(spark, sf_dir).select("recording_id", F.first("value").over(w.rowsBetween(-3, 0)).alias("a"), F.min("value").over(w.rowsBetween(-3, 0)).alias("lo"), F.max("value").over(w.rowsBetween(-2, 0)).alias("hi"), F.count("*").over(w.rowsBetween(-3, 0)).alias("n"))
    return df.groupBy("recording_id").agg(F.count_if(F.expr("n = 4 and a > 0.01 and lo > 0 and hi < 0.4 * a")).alias("n_trails"))
