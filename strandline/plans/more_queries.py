"""Queries on map matching, pulse-like signals and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, frames, mapmatch, physio, spatial
from .base import HOUR, K, S, query, r6, rounded, samples

R = lambda x: f"round({x}, 6) + 0.0"
W = "window w as (partition by recording_id order by t, sample_index)"

#: A town of six streets each way, 100 m and 20 m apart, over the plane of (value, sample_index % 100).
NODES_SQL = "nd as (select i * 100 + j as node_id, i * 100.0::double as x, j * 20.0::double as y from (select unnest(range(6))::bigint as i) a cross join (select unnest(range(6))::bigint as j) b)"
WAYS_SQL = "wy as (select j as way_id, i as k, i * 100 + j as node_id from (select unnest(range(6))::bigint as i) a cross join (select unnest(range(6))::bigint as j) b union all select 100 + i, j, i * 100 + j from (select unnest(range(6))::bigint as i) a cross join (select unnest(range(6))::bigint as j) b)"
SEG_SQL = """sg as (select way_id, k::int as seg, node_id as from_node, lead(node_id) over (partition by way_id order by k) as to_node from wy),
sl as (select sg.*, a.x as ax, a.y as ay, b.x as bx, b.y as by_, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) as length_m from sg join nd a on a.node_id = from_node join nd b on b.node_id = to_node),
so as (select *, sum(length_m) over (partition by way_id order by seg) - length_m as offset_m from sl)"""


def _town(spark):
    i = spark.range(6).withColumnRenamed("id", "i")
    nodes = i.join(F.broadcast(spark.range(6).withColumnRenamed("id", "j")), how="cross").select((F.col("i") * 100 + F.col("j")).alias("node_id"), (F.col("i") * 100.0).alias("x"), (F.col("j") * 20.0).alias("y"))
    streets = spark.range(6).select(F.col("id").alias("way_id"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda k: k * 100 + F.col("id")).alias("nodes"))
    lanes = spark.range(6).select((F.col("id") + 100).alias("way_id"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda k: F.col("id") * 100 + k).alias("nodes"))
    return streets.unionByName(lanes), nodes


def _fixes(spark, sf_dir):
    return samples(spark, sf_dir).select("recording_id", "sample_index", "t", F.col("value").alias("x"), (F.col("sample_index") % 100).cast("double").alias("y"))


@query(f"with {NODES_SQL}, {WAYS_SQL}, {SEG_SQL} select way_id, seg, from_node, to_node, {R('length_m')} as length_m, {R('offset_m')} as offset_m from so")
def network_segments(spark, sf_dir):
    return r6(mapmatch.segments(*_town(spark)).select("way_id", "seg", "from_node", "to_node", "length_m", "offset_m"))


@query(f"with {NODES_SQL}, {WAYS_SQL} select node_id, count(distinct way_id) as n_ways from wy where node_id not in (select node_id from wy where way_id = 103) group by 1 having count(distinct way_id) >= 2")
def network_junctions(spark, sf_dir):
    ways, _ = _town(spark)
    return mapmatch.junctions(ways, ways.where("way_id = 103"))


#: Headings of the track over (value, sample_index % 97) by steps of 20 and more.
HEAD = f"""hx as (select recording_id, sample_index, t, value as x, (sample_index % 97)::double as y from s), hs as (select *, lead(x) over w - x as dx, lead(y) over w - y as dy from hx {W}), ho as (select *, case when sqrt(dx * dx + dy * dy) >= 20 then (degrees(atan2(dx, dy)) + 360) % 360 end as o from hs),
hd as (select *, last_value(o ignore nulls) over (partition by recording_id order by t, sample_index rows between unbounded preceding and current row) as heading_deg from ho)"""
#: Candidates within 30 m of (value, sample_index % 100), one of each way, by nearness.
CAND_SQL = f"""fx as (select recording_id, sample_index, value as x, (sample_index % 100)::double as y from s),
d as (select recording_id, sample_index, way_id, seg, offset_m, length_m, x, y, ax, ay, bx, by_, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (length_m * length_m))) as u from fx cross join so),
e as (select *, sqrt(pow(x - (ax + u * (bx - ax)), 2) + pow(y - (ay + u * (by_ - ay)), 2)) as dist from d), f as (select *, row_number() over (partition by recording_id, sample_index, way_id order by dist, seg) as rn from e where dist <= 30),
g as (select *, row_number() over (partition by recording_id, sample_index order by dist, way_id) as p from f where rn = 1)"""


@query(f"""with {S}, {NODES_SQL}, {WAYS_SQL}, {SEG_SQL}, {CAND_SQL}
select recording_id, sample_index, way_id, seg, {R('dist')} as distance_m, {R('offset_m + u * length_m')} as along_m from g where p <= 3""")
def map_candidates(spark, sf_dir):
    found = mapmatch.candidates(_fixes(spark, sf_dir), mapmatch.segments(*_town(spark)), K, 30.0, 3)
    return found.select("recording_id", "sample_index", "way_id", "seg", rounded(F.col("distance_m")).alias("distance_m"), rounded(F.col("along_m")).alias("along_m"))


@query()
def hmm_map_match(spark, sf_dir):
    """Viterbi decoding is sequential; a test holds it against all sequences of a short track."""
    return r6(mapmatch.decode(mapmatch.candidates(_fixes(spark, sf_dir), mapmatch.segments(*_town(spark)), K, 30.0), K))


@query(f"""with {S}, {NODES_SQL}, {WAYS_SQL}, {SEG_SQL}, {CAND_SQL}, {HEAD}, ch as (select recording_id, sample_index, way_id, dist, offset_m + u * length_m as along, ax + u * (bx - ax) as px, ay + u * (by_ - ay) as py, (degrees(atan2(bx - ax, by_ - ay)) + 360) % 360 as rh from g where p = 1),
j as (select h.recording_id, h.sample_index, h.t, heading_deg, case when h.sample_index % 5 > 0 then x / 10 end as speed, case when h.sample_index % 4 > 0 then h.sample_index % 40 end as acc, ch.* exclude (recording_id, sample_index) from hd h left join ch using (recording_id, sample_index)),
q as (select *, abs((heading_deg - rh + 540) % 360 - 180) as ahead, coalesce(heading_deg is not null and (speed is null or speed >= 2), false) as trust from j), v as (select *, least(ahead, 180 - ahead) as herr, case when way_id is null then 'no road near' when dist > 9 then 'too far from the road' when trust and least(ahead, 180 - ahead) > 60 then 'turned from the road' else 'ok' end as reason from q),
tp as (select distinct a.way_id as wa, b.way_id as wb from wy a join wy b using (node_id)), mm as (select *, lag(way_id) over w as lw, lag(along) over w as la, lag(px) over w as lx, lag(py) over w as ly from v where reason = 'ok' {W}),
st2 as (select mm.*, coalesce(case when way_id = lw then abs(along - la) else sqrt(pow(px - lx, 2) + pow(py - ly, 2)) + case when wa is null then 60 else 5 end end, 0) as step from mm left join tp on wa = way_id and wb = lw), pr as (select *, sum(step) over w as progress, coalesce(way_id % 2 = 0 and 180 - ahead < ahead, false) as against from st2 {W})
select v.recording_id, v.sample_index, v.reason, pr.way_id, {R('pr.herr')} as heading_error_deg, {R('pr.progress')} as route_progress_m, coalesce(against, false) as against_oneway, case when pr.way_id >= 100 then 'lane' when pr.way_id < 100 then 'street' end as road_class,
nullif(case when pr.way_id is not null then concat_ws('; ', case when not pr.trust then 'heading not trusted' end, case when pr.acc is null then 'accuracy unreported' end, case when pr.acc > 25 then 'poor accuracy' end, case when pr.dist > 4.5 then 'far from the road' end, case when against then 'against one way' end) end, '') as warnings,
coalesce({R('cbrt((1 - pr.dist / 9) * case when pr.trust then 1 - pr.herr / 60 else 0.5 end * 8 / greatest(8, coalesce(pr.acc, 8)))')}, 0) as match_quality from v left join pr using (recording_id, sample_index)""")
def assessed_match(spark, sf_dir):
    """Fixes laid on their nearest road; the gates, warnings, attributes, quality and progress are those of ``match``."""
    ways, nodes = _town(spark)
    ways = ways.withColumns({"oneway": F.col("way_id") % 2 == 0, "road_class": F.when(F.col("way_id") >= 100, "lane").otherwise("street")})
    i = F.col("sample_index")
    fixes = _fixes(spark, sf_dir).withColumns({"speed_mps": F.when(i % 5 > 0, F.col("x") / 10), "accuracy_m": F.when(i % 4 > 0, i % 40)})
    fixes = spatial.heading(fixes.withColumn("y", (i % 97).cast("double")), K, "x", "y", 20.0).withColumn("y", (i % 100).cast("double"))
    nearest = mapmatch.candidates(fixes.select("recording_id", "sample_index", "t", "x", "y"), mapmatch.described(mapmatch.segments(ways, nodes)), K, 30.0, 1)
    found = mapmatch.assessed(fixes, nearest.drop("t", "x", "y", "seg"), ways, K, 9.0)
    return r6(found.select("recording_id", "sample_index", "reason", "way_id", "heading_error_deg", "route_progress_m", "against_oneway", "road_class", "warnings", "match_quality"))


@query(f"""with bend as (select unnest([[0.0::double, 0.0], [10.0, 0.0], [20.0, 10.0], [20.0, 30.0], [0.0, 30.0]]) as p, generate_subscripts([1, 2, 3, 4, 5], 1) as k), v as (select k, p[1] as x, p[2] as y, lag(p[1]) over w as ax, lag(p[2]) over w as ay, lead(p[1]) over w as cx, lead(p[2]) over w as cy from bend window w as (order by k)),
c as (select *, 2 * abs((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / (sqrt(pow(x - ax, 2) + pow(y - ay, 2)) * sqrt(pow(cx - x, 2) + pow(cy - y, 2)) * sqrt(pow(cx - ax, 2) + pow(cy - ay, 2))) as k0 from v), e as (select *, coalesce(k0, lead(k0) over w, lag(k0) over w) as kv from c window w as (order by k))
select (k - 1)::int as seg, {R('kv')} as curve_from, {R('lead(kv) over (order by k)')} as curve_to, {R('(degrees(atan2(cx - x, cy - y)) + 360) % 360')} as road_heading_deg from e qualify cx is not null""")
def road_curvature(spark, sf_dir):
    places = [(0.0, 0.0), (10.0, 0.0), (20.0, 10.0), (20.0, 30.0), (0.0, 30.0)]
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "node_id long, x double, y double")
    ways = spark.createDataFrame([(1, list(range(5)))], "way_id long, nodes array<long>")
    return r6(mapmatch.described(mapmatch.segments(ways, nodes)).select("seg", "curve_from", "curve_to", "road_heading_deg"))


def _run(name: str, flag: str, least: str = "null") -> str:
    """CTE of the runs of a flag over m: first and last row, and the row of the least value, the first of equals."""
    return f"""{name} as (select recording_id, min(n) as a, max(n) as b, arg_min(n, (l, n)) as best from (select *, {least} as l, n - row_number() over (partition by recording_id order by n) as run from m where {flag}) group by recording_id, run)"""


@query(f"""with {S}, m as (select recording_id, row_number() over w as n, t, sample_index * 1.5::double as pg, floor(value / 10)::bigint as way, nullif(stream, 'error') as cls, value between 30 and 60 as rb, case when sample_index % 7 > 0 then value % 50 end as dj, (value + 10) % 90 as ds, (value + 30) % 80 as dc, case when sample_index % 9 > 0 then (value % 5 - 2) / 50 end as cv, value / 20 as sp from s {W}),
{_run('rr', 'rb')}, {_run('rj', 'dj <= 30', 'dj')}, {_run('rs', 'ds <= 40', 'ds')}, {_run('rc', 'dc <= 25', 'dc')}, {_run('rv', 'abs(cv) >= 0.02', '-abs(cv)')}, {_run('rt', 'abs(cv) < 0.02')}, {_run('rp', 'sp < 0.5')},
e as (select recording_id, 'roundabout_traverse' as kind, a, b + 1 as e, a + (b + 1 - a) // 2 as p, 0 as least from rr union all select recording_id, 'roundabout_entry', a, a + 1, a, 0 from rr union all select recording_id, 'roundabout_exit', b, b + 1, b, 0 from rr
union all select recording_id, 'junction_crossing', a, b + 1, best, 0 from rj union all select recording_id, 'junction_approach', a, greatest(best, a + 1), a, 0 from rj union all select recording_id, 'traffic_signals', a, b + 1, best, 0 from rs union all select recording_id, 'pedestrian_crossing', a, b + 1, best, 0 from rc
union all select recording_id, 'curve', a, b + 1, best, b from rv union all select recording_id, 'straight', a, b + 1, a + (b + 1 - a) // 2, b from rt union all select recording_id, 'stop', a, b + 1, a, 0 from rp
union all select recording_id, 'restart', b, b + 2, b + 1, 0 from rp where b < (select max(n) from m where m.recording_id = rp.recording_id) union all select recording_id, 'road_class_change', n - 1, n + 1, n, 0 from (select *, lag(cls) over (partition by recording_id order by n) as was from m) where n > 1 and cls is not null and cls is distinct from was),
z as (select recording_id, max(n) as n from m group by 1)
select e.recording_id, kind, ma.t as start, me.t as "end", mp.t as peak, {R('mp.pg')} as route_progress_m, mp.way as way_id, mp.cls as road_class from e join z using (recording_id) join m ma on ma.recording_id = e.recording_id and ma.n = e.a join m me on me.recording_id = e.recording_id and me.n = least(e.e, z.n)
join m mp on mp.recording_id = e.recording_id and mp.n = e.p left join m ml on ml.recording_id = e.recording_id and ml.n = nullif(e.least, 0) where ml.t is null or (ml.t - ma.t) / 1e9 >= 3600""")
def road_events(spark, sf_dir):
    i, v = F.col("sample_index"), F.col("value")
    df = samples(spark, sf_dir).withColumns({
        "route_progress_m": i * 1.5, "way_id": F.floor(v / 10), "road_class": F.nullif("stream", F.lit("error")), "is_roundabout": v.between(30, 60), "speed_mps": v / 20,
        "distance_to_junction_m": F.when(i % 7 > 0, v % 50), "distance_to_signals_m": (v + 10) % 90, "distance_to_crossing_m": (v + 30) % 80, "curvature": F.when(i % 9 > 0, (v % 5 - 2) / 50),
    })
    return r6(events.road_events(df, K, least_s=3600.0))


PEAKS = f"""pk0 as (select *, lag(value) over (partition by recording_id order by t, sample_index) as b, lead(value) over (partition by recording_id order by t, sample_index) as a, max(value) over f as m
from s window f as (partition by recording_id order by t range between {24 * HOUR} preceding and {24 * HOUR} following)),
pk1 as (select *, min(case when value = m then t end) over (partition by recording_id order by t range between {24 * HOUR} preceding and {24 * HOUR} following) as ft from pk0),
pk as (select recording_id, sample_index, t, value from pk1 where value >= 30 and value > b and value >= a and value = m and ft = t)"""


def _peaks(spark, sf_dir):
    return physio.peaks(samples(spark, sf_dir).select("recording_id", "sample_index", "t", "value"), K, "value", 30.0, 24 * HOUR)


@query(f"with {S}, {PEAKS} select recording_id, sample_index, t, {R('value')} as value from pk")
def pulse_peaks(spark, sf_dir):
    return r6(_peaks(spark, sf_dir))


BEATS = f"""{PEAKS}, b0 as (select *, (t - lag(t) over (partition by recording_id order by t, sample_index)) / 1e6 as ibi_ms from pk),
b1 as (select *, quantile_cont(ibi_ms, 0.5) over (partition by recording_id order by t, sample_index rows between 5 preceding and 5 following) as loc from b0),
b2 as (select *, nullif(concat_ws('; ', case when ibi_ms is null then 'first beat' end, case when ibi_ms < 9e7 then 'too short' end, case when ibi_ms > 4e8 then 'too long' end, case when abs(ibi_ms - loc) / loc > 0.6 then 'irregular' end), '') as reason from b1)"""


@query(f"with {S}, {BEATS} select recording_id, sample_index, {R('ibi_ms / 3.6e6')} as ibi_hours, reason, reason is null as valid from b2")
def beat_intervals(spark, sf_dir):
    found = physio.beats(_peaks(spark, sf_dir), K, 9e7, 4e8, 0.6)
    return found.select("recording_id", "sample_index", rounded(F.col("ibi_ms") / 3.6e6).alias("ibi_hours"), "reason", "valid")


@query(f"""with {S}, {BEATS}, b3 as (select *, reason is null as valid, ((t - min(t) over (partition by recording_id)) // {240 * HOUR})::bigint as block from b2),
b4 as (select *, case when valid and lag(valid) over w then ibi_ms - lag(ibi_ms) over w end as d from b3 window w as (partition by recording_id, block order by t, sample_index)),
b5 as (select recording_id, block, count(*) filter (valid) as n_beats, avg(60000 / ibi_ms) filter (valid) as hr, sqrt(avg(d * d)) as rmssd, stddev_samp(ibi_ms) filter (valid) as sdnn, avg(case when abs(d) > 50 then 1.0 when d is not null then 0.0 end) as pnn50 from b4 group by all)
select recording_id, block, n_beats, case when n_beats >= 3 then {R('1e6 * hr')} end as hr_e6, case when n_beats >= 3 then {R('rmssd / 3.6e6')} end as rmssd_hours, case when n_beats >= 3 then {R('sdnn / 3.6e6')} end as sdnn_hours, case when n_beats >= 3 then {R('pnn50')} end as pnn50, case when n_beats < 3 then 'too few beats' end as refusal from b5""")
def beat_variability(spark, sf_dir):
    found = frames.blocks(physio.beats(_peaks(spark, sf_dir), K, 9e7, 4e8, 0.6), K, 240 * HOUR)
    out = physio.variability(found, K, "block", 3)
    return out.select("recording_id", "block", "n_beats", rounded(1e6 * F.col("hr")).alias("hr_e6"), rounded(F.col("rmssd") / 3.6e6).alias("rmssd_hours"), rounded(F.col("sdnn") / 3.6e6).alias("sdnn_hours"), rounded(F.col("pnn50")).alias("pnn50"), "refusal")


@query(f"""with {S}, b as (select *, ((t - min(t) over (partition by recording_id)) // {120 * HOUR})::bigint as block from s), c as (select *, coalesce((value = lag(value) over (partition by recording_id, block order by t, sample_index))::int, 0) as fl from b),
q as (select recording_id, block, count(value) as n, avg((value <= 1 or value >= 150)::int) as saturated, avg(fl) as flat, stddev_pop(value) as spread from c group by all),
r as (select *, nullif(concat_ws('; ', case when n < 8 then 'dropout' end, case when saturated > 0.1 then 'saturation' end, case when flat > 0.2 then 'flat' end, case when coalesce(spread, 0) < 1e-9 then 'no signal' end), '') as reason from q)
select recording_id, block, n, {R('saturated')} as saturated, {R('flat')} as flat, {R('spread')} as spread, reason, reason is null as usable from r""")
def window_quality(spark, sf_dir):
    return r6(physio.window_quality(frames.blocks(samples(spark, sf_dir), K, 120 * HOUR), K, "value", "block", 1.0, 150.0, 8))


@query(f"""with {S}, c as (select * from s where stream = 'click'), j as (select c.*, v.value as lux, abs(v.t - c.t) as ad, row_number() over (partition by c.recording_id, c.sample_index order by abs(v.t - c.t), v.t, v.sample_index) as rn from c left join (select * from s where stream = 'view') v using (recording_id)),
p as (select recording_id, sample_index, value, case when ad <= {72 * HOUR} then log10(least(greatest(lux, 0), 1e12) + 1) end as ll from j where rn = 1), f as (select recording_id, regr_count(value, ll) as n, stddev_pop(ll) as sd, regr_slope(value, ll) as sl, regr_intercept(value, ll) as ic from p group by all)
select recording_id, sample_index, case when n >= 8 and sd >= 1e-6 then {R('sl')} end as slope, case when n >= 8 and sd >= 1e-6 then {R('value - (ic + sl * ll)')} end as residual from p join f using (recording_id)""")
def light_residual(spark, sf_dir):
    found = physio.light_residual(samples(spark, sf_dir, "click").select("recording_id", "sample_index", "t", "value"), samples(spark, sf_dir, "view"), K, 72 * HOUR, 8)
    return r6(found.select("recording_id", "sample_index", "slope", "residual"))
