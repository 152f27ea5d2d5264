"""Queries on windows of rows, grids, returns, routes, drawn intervals, agreement and masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, events, islands, labels, physio, select, spatial, stats
from .base import DRAW, HOUR, KS, K, S, query, r6, samples, table

R = lambda x: f"round({x}, 6) + 0.0"
R3 = lambda x: f"round({x}, 3) + 0.0"
W = "window w as (partition by recording_id order by t, sample_index)"


# --- rows and grids


@query(f"""with {S}, f as (select recording_id, min(t) as t0 from s group by 1) select s.recording_id, sample_index, t from s join f using (recording_id) where t >= t0 + {24 * HOUR} and t <= t0 + {240 * HOUR}""")
def time_window(spark, sf_dir):
    df = samples(spark, sf_dir).select("recording_id", "sample_index", "t")
    return select.time_window(df, K, "t", start_s=24 * 3600.0, end_s=240 * 3600.0)


@query(f"""with {S}, o as (select recording_id, row_number() over w as sample_index, t from (select distinct recording_id, t, 0 as sample_index from s) {W}), g as (select recording_id, unnest(range(min(t), max(t) + 1, {24 * HOUR})) as g from o group by 1),
j as (select g.recording_id, g, sample_index, t, row_number() over (partition by g.recording_id, g order by abs(t - g), t) as rn from g join o using (recording_id)) select distinct recording_id, sample_index, t from j where rn = 1""")
def grid_frames(spark, sf_dir):
    rows = samples(spark, sf_dir).select("recording_id", "t").distinct().withColumn("sample_index", F.row_number().over(Window.partitionBy("recording_id").orderBy("t")))
    return asof.grid_frames(rows, K, 24 * HOUR)


@query(f"""with {S}, d as (select recording_id, t - lag(t) over w as dt from s {W}) select recording_id, greatest({12 * HOUR}, median(dt)) / 2 / 1e9 as tolerance_s from d group by 1""")
def grid_tolerance(spark, sf_dir):
    dt = F.col("t") - F.lag("t").over(islands.ordered(K))
    by = samples(spark, sf_dir).withColumn("dt", dt).groupBy("recording_id").agg(F.percentile("dt", 0.5).alias("period"))
    return by.select("recording_id", (asof.grid_tolerance_ns(F.lit(12 * HOUR), F.col("period")) / 1e9).alias("tolerance_s"))


@query(f"""with {S}, a as (select distinct recording_id, t // {24 * HOUR} as day from s where stream = 'click'), b as (select recording_id, t // {24 * HOUR} as day, max(value) as value from s where stream = 'view' group by all) select a.recording_id, a.day::bigint as day, {R('value')} as value from a left join b using (recording_id, day)""")
def reindexed(spark, sf_dir):
    day = F.floor(F.col("t") / (24 * HOUR)).alias("day")
    clicks = samples(spark, sf_dir, "click").select("recording_id", day).distinct()
    views = samples(spark, sf_dir, "view").groupBy("recording_id", day).agg(F.max("value").alias("value"))
    return r6(asof.reindexed(clicks, views, ["recording_id", "day"], ["value"]))


# --- changes and runs


@query(f"""with {S}, a as (select *, nullif(stream, 'error') as state from s), b as (select *, lag(state) over w as previous, row_number() over w as rn from a {W}) select recording_id, sample_index, t, previous, state from b where rn > 1 and state is not null and state is distinct from previous""")
def state_changes(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("state", F.nullif("stream", F.lit("error")))
    return islands.changes(df, K, "state").select("recording_id", "sample_index", "t", "previous", "state")


@query(f"""with {S}, g as (select *, (t - lag(t) over (partition by recording_id, stream order by t)) / 1e9 as gap from s), k as (select recording_id, min(t) as t0, count(*) * 3600.0::double / 60 as minutes from s group by 1)
select recording_id, stream, {R('(min(t) - any_value(t0)) / 1e9')} as time_to_first_s, {R('count(*) filter (gap > 7200) / any_value(minutes)')} as returns_per_minute from g join k using (recording_id) group by all""")
def label_returns(spark, sf_dir):
    return r6(islands.returns(samples(spark, sf_dir), K, "stream", 3600.0))


@query(f"""with {S}, a as (select *, value >= 5 as ok, not (value >= 5 and stream in ('view', 'click')) as off from s), b as (select *, coalesce((off is distinct from lag(off) over w)::int, 1) as nw from a {W}), c as (select *, sum(nw) over w as run from b {W}), r as (select recording_id, run, count(*) * 0.5::double as s, not bool_or(ok) as blind from c where off group by all)
select recording_id, count(*) as n_runs, {R('sum(s)')} as total_s, {R('max(s)')} as longest_s, {R('avg(s)')} as mean_s, count(*) filter (blind) as n_blind from r group by 1""")
def off_runs(spark, sf_dir):
    return r6(islands.off_runs(samples(spark, sf_dir), K, F.col("value") >= 5, F.col("stream").isin("view", "click"), 0.5))


@query(f"""with {S}, a as (select *, value > 40 as f from s), b as (select *, coalesce((f is distinct from lag(f) over w)::int, 1) as nw from a {W}), c as (select *, sum(nw) over w as run from b {W}), r as (select recording_id, run, (max(t) - min(t)) / 1e9 as d from c where f group by all)
select count(*) as n, {R('avg(d)')} as mean, {R('stddev_samp(d)')} as sd, {R('quantile_cont(d, 0.05)')} as p05, {R('quantile_cont(d, 0.25)')} as p25, {R('median(d)')} as median, {R('quantile_cont(d, 0.75)')} as p75, {R('quantile_cont(d, 0.95)')} as p95, {R('min(d)')} as lowest, {R('max(d)')} as highest, {R('quantile_cont(d, 0.75) - quantile_cont(d, 0.25)')} as iqr from r""")
def duration_summary(spark, sf_dir):
    found = islands.run_table(samples(spark, sf_dir), K, F.col("value") > 40)
    return r6(found.agg(*stats.describe("duration_s")))


# --- selection


@query("""with q as (select lang, quantile_cont(n_chars, 0.15) as a, quantile_cont(n_chars, 0.85) as b from documents group by 1)
select doc_id, d.lang, n_chars, array_to_string(list_filter([case when n_chars < a then 'length:short' when n_chars > b then 'length:long' else 'length:usual' end], lambda x: x is not null), '; ') as strata from documents d join q on d.lang = q.lang where n_chars is not null""")
def stratified_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").where("n_chars is not null")
    found = select.stratified(docs, ["lang"], {"n_chars": 0.15}, {"n_chars": 0.85}, {"n_chars": ("length:short", "length:long", "length:usual")})
    return found.withColumn("strata", F.array_join("strata", "; "))


@query(f"""with x as (select doc_id, n_chars, {DRAW(0, 'doc_id')} as draw from documents), u as (select doc_id, 'uniform' as bucket from x where doc_id % 50 = 0), h as (select doc_id, 'hard' as bucket from x where doc_id % 50 <> 0 order by n_chars desc, doc_id limit 20),
d as (select doc_id, 'drawn' as bucket from x where doc_id % 50 <> 0 and doc_id not in (select doc_id from h) order by draw, doc_id limit 30) select * from u union all select * from h union all select * from d""")
def validation_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("n_chars", F.coalesce("n_chars", F.lit(-1)))
    return select.buckets(docs, "doc_id", "n_chars", 50, 20, 30).select("doc_id", "bucket")


# --- routes


XY = "x as (select recording_id, sample_index, t, value as x, (sample_index % 97)::double as y from s)"
#: A step of whole turns away from a boundary of the rounding.
HEAD = f"""{XY}, st as (select *, lead(x) over w - x as dx, lead(y) over w - y as dy from x {W}), own as (select *, case when sqrt(dx * dx + dy * dy) >= 20 then (degrees(atan2(dx, dy)) + 360) % 360 end as o from st), hd as (select *, last_value(o ignore nulls) over (partition by recording_id order by t, sample_index rows between unbounded preceding and current row) as heading_deg from own)"""


def _track(spark, sf_dir):
    df = samples(spark, sf_dir).select("recording_id", "sample_index", "t", F.col("value").alias("x"), (F.col("sample_index") % 97).cast("double").alias("y"))
    return spatial.heading(df, K, "x", "y", 20.0)


@query(f"with {S}, {HEAD} select recording_id, sample_index, {R('heading_deg')} as heading_deg from hd")
def track_heading(spark, sf_dir):
    return r6(_track(spark, sf_dir).select("recording_id", "sample_index", "heading_deg"))


@query(f"with {S}, {HEAD} select recording_id, sample_index, {R('(30 - x) * cos(radians(heading_deg)) - (40 - y) * sin(radians(heading_deg))')} as offset_m from hd where heading_deg is not null")
def lateral_offset(spark, sf_dir):
    rows = _track(spark, sf_dir).where("heading_deg is not null")
    return r6(rows.select("recording_id", "sample_index", spatial.lateral_offset(F.col("heading_deg"), 30 - F.col("x"), 40 - F.col("y")).alias("offset_m")))


@query(f"""with {S}, f as (select recording_id, sample_index as fix, t as ft, floor(value / 10)::bigint as bin_key, sample_index * 1.5::double as progress, case when sample_index % 3 > 0 then value end as speed from s where stream = 'view'), fr as (select recording_id, sample_index, t from s where stream = 'click'),
us as (select recording_id, median(speed) as usual from f group by 1), j as (select fr.*, f.*, row_number() over (partition by fr.recording_id, fr.sample_index order by abs(ft - t), ft, fix) as rn from fr left join f on f.recording_id = fr.recording_id), p as (select j.recording_id, sample_index, t, bin_key, progress, abs(ft - t) / 1e9 as dt, coalesce(speed, usual) as sp, ft from j left join us using (recording_id) where rn = 1)
select recording_id, sample_index, t, {R('dt')} as dt_s, {R3('dt * sp')} as uncertainty_m, case when dt <= 86400 then bin_key end as bin_key, case when dt <= 86400 then {R('progress')} end as progress, coalesce(dt <= 86400, false) as bin_valid, case when ft is null then 'no fix' when dt <= 86400 then 'ok' else 'too far in time' end as bin_reason from p""")
def frames_to_bins(spark, sf_dir):
    df = samples(spark, sf_dir)
    fixes = df.where("stream = 'view'").select("recording_id", "sample_index", "t", F.floor(F.col("value") / 10).alias("bin_key"), (F.col("sample_index") * 1.5).alias("progress"), F.when(F.col("sample_index") % 3 > 0, F.col("value")).alias("speed"))
    frames = df.where("stream = 'click'").select("recording_id", "sample_index", "t")
    found = spatial.frames_to_bins(frames, fixes, K, "bin_key", "progress", "speed", 86_400.0)
    return r6(found.withColumn("uncertainty_m", F.round("uncertainty_m", 3)))


@query(f"""with {S}, r as (select recording_id, (count(*) - 1) / ((max(t) - min(t)) / 1e9) * 3600 as rate, median(value) as speed from s group by 1 having count(*) > 1), z as (select *, 0.5 * speed / rate as resolution from r), c as (select recording_id, min(size) as size from z, unnest([100.0::double, 500.0, 1000.0, 2000.0]) u(size) where size >= resolution and size * rate / speed >= 2 group by 1)
select recording_id, {R('resolution')} as resolution_m, size as bin_size_m, {R('size * rate / speed')} as expected_fixes from z left join c using (recording_id)""")
def usable_bin(spark, sf_dir):
    by = samples(spark, sf_dir).groupBy("recording_id").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 1e9).alias("span"), F.percentile("value", 0.5).alias("speed_mps")).where("n > 1")
    rates = by.select("recording_id", ((F.col("n") - 1) / F.col("span") * 3600).alias("rate_hz"), "speed_mps")
    return r6(spatial.usable_bin(rates, K, [100.0, 500.0, 1000.0, 2000.0]))


@query("""with p as (select o_orderstatus = 'F' as paired, case when o_orderstatus <> 'F' then case when o_totalprice > 100000 then 'too far; also late' when o_totalprice > 20000 then 'turned' end end as reason from orders), w as (select case when paired then 'paired' else 'rejected: ' || coalesce(trim(split_part(reason, ';', 1)), 'unknown') end as what from p)
select 'considered' as what, count(*) as n_bins, null::double as length_m from p union all select what, count(*), case when what = 'paired' then count(*) * 50.0::double end from w group by what""")
def route_summary(spark, sf_dir):
    price = F.col("o_totalprice")
    paired = F.col("o_orderstatus") == "F"
    reason = F.when(~paired, F.when(price > 100_000, "too far; also late").when(price > 20_000, "turned"))
    return spatial.route_summary(table(spark, sf_dir, "orders").select(paired.alias("paired"), reason.alias("rejection_reason")), 50.0)


# --- drawn intervals


@query(f"""with r as (select s_nationkey as k, s_acctbal as v, row_number() over (partition by s_nationkey order by s_suppkey) as slot, count(*) over (partition by s_nationkey) as n from supplier where s_acctbal is not null), d as (select k, rep, {DRAW(1, 'rep', 'slot')} % n + 1 as slot from r, range(200) x(rep)),
m as (select d.k, rep, avg(v) as m from d join r using (k, slot) group by all), q as (select k, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1) select k as s_nationkey, {R3('avg(v)')} as estimate, count(*) as n, {R3('any_value(lo)')} as ci_low, {R3('any_value(hi)')} as ci_high from r join q using (k) group by k""")
def mean_bootstrap(spark, sf_dir):
    return r6(stats.mean_bootstrap(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey"), 3)


def _resampled(keys: str, order: str, value: str, name: str) -> str:
    """CTEs that end in ``name`` with the drawn values, for the oracle of the two bootstraps below, from ``u``."""
    join = " and ".join(f"d.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    select_keys = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""ra as (select {keys}, {value} as v, row_number() over (partition by {keys} order by {order}) - 1 as pos, count(*) over (partition by {keys}) as n from u), r as (select *, pos // 4 as block, pos % 4 as inn, ceil(n / 4)::bigint as blocks from ra),
d as (select {keys}, block as slot, rep, {DRAW(1, 'rep', 'block')} % blocks as block from r, range(200) x(rep) where inn = 0),
pl as (select {select_keys}, rep, v, n, row_number() over (partition by {select_keys}, rep order by slot, inn) as place from d join r on {join} and d.block = r.block), {name} as (select * from pl where place <= n)"""


@query(f"""with u as (select p_type[1:5] as kind, p_brand, avg(l_extendedprice) filter (l_returnflag = 'A') - avg(l_extendedprice) filter (l_returnflag = 'R') as df from lineitem join part on l_partkey = p_partkey group by all having df is not null), {_resampled('kind', 'p_brand', 'df', 'z')},
m as (select kind, rep, median(v) as m from z group by all), q as (select kind, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1)
select kind, {R3('median(df)')} as difference, count(*) as n_units, {R3('any_value(lo)')} as ci_low, {R3('any_value(hi)')} as ci_high, count(*) < 8 as few_units from u join q using (kind) group by kind""")
def paired_bootstrap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.substring("p_type", 1, 5).alias("kind"))
    of = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    pairs = lines.join(parts, "l_partkey").groupBy("kind", "p_brand").agg(of("A").alias("a"), of("R").alias("b"))
    return r6(stats.paired_bootstrap(pairs, ["kind"], "a", "b", "p_brand"), 3)


@query(f"""with u as (select o_orderpriority as k, o_orderstatus as g, strftime(o_orderdate, '%Y-%m') as mo, avg(o_totalprice) as v0 from orders where o_orderstatus in ('F', 'P') group by all), {_resampled('k, g', 'mo', 'v0', 'z')},
m as (select k, rep, g, median(v) as m from z group by all), a as (select k, rep, max(m) filter (g = 'F') - max(m) filter (g = 'P') as df from m group by all), q as (select k, quantile_cont(df, 0.025) as lo, quantile_cont(df, 0.975) as hi from a group by 1),
e as (select k, median(v0) filter (g = 'F') - median(v0) filter (g = 'P') as difference, count(*) filter (g = 'F') as n_a, count(*) filter (g = 'P') as n_b from u group by 1 having n_a >= 3 and n_b >= 3)
select k as o_orderpriority, {R3('difference')} as difference, n_a, n_b, {R3('lo')} as ci_low, {R3('hi')} as ci_high, least(n_a, n_b) < 8 as few_units from e join q using (k)""")
def two_sample_bootstrap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("mo")).agg(F.avg("o_totalprice").alias("v"))
    return r6(stats.two_sample_bootstrap(orders, ["o_orderpriority"], "o_orderstatus", "F", "P", "v", "mo"), 3)


@query(f"""with {S}, g as (select recording_id, (t - lag(t) over w) / 1e9 as gap from s {W}), m as (select recording_id, median(gap) as gap from g group by 1) select recording_id, case when gap > 0 then greatest(1, round_even(259200 / gap, 0)::int) else 1 end as events_per_block from m""")
def events_per_block(spark, sf_dir):
    return stats.events_per_block(samples(spark, sf_dir), K, "t", "sample_index", 259_200.0)


@query(f"""with q as (select o_orderstatus, quantile_cont(o_totalprice, 0.05) as l, quantile_cont(o_totalprice, 0.95) as h from orders group by 1) select o_orderstatus, o_orderkey, {R('case when h - l <= 1e-12 then 0.5 else least(1, greatest(0, (o_totalprice - l) / (h - l))) end')} as index_value, {R('1 / 5')} as completeness, 'traffic_interaction' as index_name from orders join q using (o_orderstatus)""")
def traffic_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("vehicle_count"))
    return r6(stats.named_index(orders, ["o_orderstatus"], ["o_orderkey"], "traffic_interaction"))


@query(f"""with {S}, m as (select stream, median(value) as m from s group by 1) select stream, {R('median(abs(value - m))')} as deviation from s join m using (stream) group by 1""")
def own_statistic(spark, sf_dir):
    return r6(stats.apply_statistic(samples(spark, sf_dir), ["stream"], "value", lambda x: np.median(np.abs(x - np.median(x))), "deviation"))


# --- agreement and masks


AGREE = "a as (select lang, quality as a, case when n_chars > 200 then 1 - toxic end as b from documents join labels using (doc_id))"


@query(f"""with {AGREE}, c as (select lang, unnest(list_distinct(list_filter([a, b], lambda x: x is not null))) as class_name, a, b from a), n as (select lang, count(*) filter (a is not null and b is not null) as n_common, count(*) filter (a = b) as same from a group by 1)
select c.lang, class_name, count(*) filter (a = b) as intersection, count(*) as "union", any_value(n_common) as n_common, {R('any_value(same / n_common)')} as agreement, {R('count(*) filter (a = b) / count(*)')} as iou from c join n on c.lang = n.lang group by c.lang, class_name""")
def method_agreement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    said = docs.select("lang", F.col("quality").alias("a"), F.when(F.col("n_chars") > 200, 1 - F.col("toxic")).alias("b"))
    return r6(labels.class_agreement(said, ["lang"], "a", "b"))


@query(f"""with f as (select l_orderkey, avg((l_returnflag <> 'N')::int) as c, count(distinct nullif(l_returnflag, 'N')) as n from lineitem group by 1) select count(*) as n_frames, {R('avg(c)')} as coverage, {R('avg(1 - c)')} as unknown, {R('avg(n)')} as classes_per_frame from f""")
def label_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("label"))
    return r6(labels.coverage_metrics(lines, "l_orderkey", "label"))


@query(f"""with {S}, d as (select recording_id, stream, t // {24 * HOUR} as day from s) select recording_id, {R("greatest(count(distinct day) filter (stream = 'view'), count(distinct day) filter (stream = 'click')) / count(distinct day)")} as continuity from d group by 1""")
def best_presence(spark, sf_dir):
    df = samples(spark, sf_dir).select("recording_id", "stream", F.floor(F.col("t") / (24 * HOUR)).alias("day"))
    return r6(labels.best_presence(df, K, "day", "stream", ["view", "click"]))


@query(f"""with pl as (select p_brand, p_partkey % 50 as x, p_partkey % 37 as y, p_size % 4 as label from part), pt as (select distinct p_brand, id, u, v from part, (values (1, 10.0, 10.0), (2, 24.6, 18.2), (3, 45.0, 30.0)) q(id, u, v)),
c as (select pt.p_brand, id, label, count(*) as n from pt join pl on pl.p_brand = pt.p_brand and abs(x - round(u)) <= 6 and abs(y - round(v)) <= 6 and label > 0 group by all), k as (select *, row_number() over (partition by p_brand, id order by n desc, label) as rn, sum(n) over (partition by p_brand, id) as tot from c)
select pt.p_brand, pt.id, coalesce(label, 0)::int as label, {R('coalesce(n / tot, 0)')} as share from pt left join (select * from k where rn = 1) k using (p_brand, id)""")
def dominant_near(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    places = part.select("p_brand", (F.col("p_partkey") % 50).alias("x"), (F.col("p_partkey") % 37).alias("y"), (F.col("p_size") % 4).alias("label"))
    spots = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, u, v in ((1, 10.0, 10.0), (2, 24.6, 18.2), (3, 45.0, 30.0))])
    points = part.select("p_brand").distinct().select("p_brand", F.explode(spots).alias("s")).select("p_brand", "s.*")
    return r6(labels.dominant_near(points, places, ["p_brand"], "id", 6))


@query(f"""with v as (select label, list_transform(embedding[1:4], lambda x: x::double * x::double) as c, list_transform(embedding[5:12], lambda x: abs(x::double)) as m from embeddings), e as (select label, unnest(range(8)) as cell, c, m from v), f as (select label, cell, unnest(range(4)) as class_id, c, m from e),
s as (select label, cell, class_id, sum(c[class_id + 1] * m[cell + 1]) as s from f group by all), p as (select *, s / sum(s) over (partition by label, cell) as p from s) select label, cell::int as cell, arg_max(class_id, p)::int as class_id, {R('max(p)')} as confidence, {R('-sum(case when p > 0 then p * ln(p) else 0 end) / ln(4)')} as entropy from p group by label, cell""")
def mask_aggregation(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    queries = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice(v, 1, 4), lambda x: x * x).alias("classes"), F.transform(F.slice(v, 5, 8), F.abs).alias("mask"))
    return r6(labels.aggregated_masks(queries, ["label"], "classes", "mask", 4))


@query(f"""with {S} select recording_id, sample_index, value between 10 and 60 and sample_index % 97 between 20 and 80 and ((sample_index % 10) / 10.0 < 0.3 or value > 50) as candidate from s""")
def zone_candidates(spark, sf_dir):
    index = F.col("sample_index")
    found = labels.zone_candidate(F.col("value"), index % 97, (10.0, 20.0, 60.0, 80.0), (index % 10) / 10, 0.3, F.col("value"), 50.0)
    return samples(spark, sf_dir).select("recording_id", "sample_index", found.alias("candidate"))


# --- beats and windows


@query(f"""with {S}, q as (select recording_id, sample_index as wi, t as wt, value > 20 as usable, 'noise' as reason, round(value / 100, 6) as sqi from s where stream = 'view'), b as (select recording_id, sample_index, t, value, value > 2 as valid from s where stream = 'click'),
j as (select b.*, q.usable, q.reason, q.sqi, row_number() over (partition by b.recording_id, b.sample_index order by (wt <= b.t) desc, case when wt <= b.t then -wt else wt end, wi) as rn from b left join q using (recording_id))
select recording_id, sample_index, t, {R('value')} as value, sqi + 0.0 as sqi, valid and coalesce(usable, true) as valid, case when not coalesce(usable, true) and valid then 'window rejected: ' || reason end as rejected from j where rn = 1""")
def tagged_beats(spark, sf_dir):
    df = samples(spark, sf_dir)
    windows = df.where("stream = 'view'").select("recording_id", "sample_index", "t", (F.col("value") > 20).alias("usable"), F.lit("noise").alias("reason"), F.round(F.col("value") / 100, 6).alias("quality"))
    found = df.where("stream = 'click'").select("recording_id", "sample_index", "t", "value", (F.col("value") > 2).alias("valid"))
    return r6(physio.tagged(found, windows, K, "usable", "reason", "quality"))


@query(f"""with {S}, w as (select recording_id, sample_index as window_id, t - {36 * HOUR} as a, t + {36 * HOUR} as b from s where stream = 'error'), m as (select *, value < 20 as c, value < 20 and not coalesce(lag(value) over w < 20, false) as rise, abs(value - lag(value) over w) as step from s {W})
select w.recording_id, window_id, count(*) as n, {R('count(*) filter (rise) / ((any_value(b) - any_value(a)) / 6e10)')} as closures_per_minute, {R('avg(c::int)')} as closed_share, {R('median(value)')} as median_value, {R('avg(step)')} as mean_step from w join m on m.recording_id = w.recording_id and m.t between a and b group by all""")
def window_statistics(spark, sf_dir):
    df = samples(spark, sf_dir)
    windows = df.where("stream = 'error'").select("recording_id", F.col("sample_index").alias("window_id"), (F.col("t") - 36 * HOUR).alias("start"), (F.col("t") + 36 * HOUR).alias("end"))
    return r6(events.window_statistics(df, windows, K, "window_id", 72 * HOUR, F.col("value") < 20, "value"))


@query(f"""with {S} select recording_id, stream, count(*) as n, {R('min(value)')} as value_lowest, {R('max(value)')} as value_highest, min(t) as time_first from s group by all""")
def flattened(spark, sf_dir):
    by = samples(spark, sf_dir).groupBy(*KS).agg(F.count("*").alias("n"), F.struct(F.min("value").alias("lowest"), F.max("value").alias("highest")).alias("value"), F.struct(F.min("t").alias("first")).alias("time"))
    return r6(select.flat(by))
