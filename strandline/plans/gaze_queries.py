"""Queries on directions, attention, closures and lines, over the events as samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames, gaze, islands, stats
from .base import HOUR, K, S, permutation_sql, micros, query, r6, rounded, samples, table

R = lambda x: f"round({x}, 6) + 0.0"
W = "window w as (partition by recording_id order by t, sample_index)"


@query(f"""with {S}, a as (select *, radians(value * 0.3) as yaw, radians((sample_index % 60) - 30) as pitch from s),
b as (select recording_id, sample_index, t, degrees(acos(least(1.0, greatest(-1.0, sin(pitch) * sin(lead(pitch) over w) + cos(pitch) * cos(lead(pitch) over w) * cos(lead(yaw) over w - yaw))))) / ((lead(t) over w - t) / 1e9) as v, lead(t) over w as nt from a {W})
select recording_id, sample_index, round(1e3 * coalesce(v, lag(v) over w), 5) + 0.0 as speed_mdeg_s from b {W}""")
def angular_speed(spark, sf_dir):
    df = samples(spark, sf_dir).withColumns({"yaw": F.radians(F.col("value") * 0.3), "pitch": F.radians((F.col("sample_index") % 60) - 30)})
    found = gaze.angular_speed(df, K, "yaw", "pitch")
    return found.select("recording_id", "sample_index", rounded(1e3 * F.col("speed_deg_s"), 5).alias("speed_mdeg_s"))


@query(f"""with {S}, a as (select *, sample_index % 9 <> 0 as ok, lead(sample_index % 9 <> 0) over w as nok, lead(value) over w as nv, lag(value) over w as pv, lead(t) over w as nt, lag(t) over w as pt from s {W})
select recording_id, sample_index, {R('1e4 * case when nt is null and ok then (value - pv) / ((t - pt) / 1e9) when ok and nok then (nv - value) / ((nt - t) / 1e9) end')} as rate_e4 from a""")
def masked_rate(spark, sf_dir):
    found = gaze.masked_rate(samples(spark, sf_dir).withColumn("ok", F.col("sample_index") % 9 != 0), K, "value", "ok", "rate")
    return found.select("recording_id", "sample_index", rounded(1e4 * F.col("rate")).alias("rate_e4"))


@query(f"""with {S}, a as (select recording_id, value as u, (sample_index % 50)::double as v, sqrt(pow(value - lag(value) over w, 2) + pow(sample_index % 50 - lag(sample_index % 50) over w, 2)) as st from s {W})
select recording_id, {R('sum(st)')} as path_length, {R('sqrt(pow(stddev_pop(u), 2) + pow(stddev_pop(v), 2))')} as dispersion, {R('avg(sqrt(u * u + v * v))')} as eccentricity, {R('quantile_cont(st, 0.5)')} as step_median, {R('quantile_cont(st, 0.95)')} as step_p95 from a group by recording_id""")
def scan_path(spark, sf_dir):
    return r6(gaze.scan_path(samples(spark, sf_dir).withColumn("v", (F.col("sample_index") % 50).cast("double")), K, "value", "v"))


LAB = "l0 as (select *, case when sample_index % 8 = 0 then null else stream end as label from s)"


def _labelled(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("label", F.when(F.col("sample_index") % 8 != 0, F.col("stream")))


@query(f"""with {S}, {LAB}, f as (select *, lag(label) over w as pl, row_number() over w as rn, lead(t) over w - t as dt from l0 {W}), i as (select *, sum(case when label is distinct from pl or rn = 1 then 1 else 0 end) over w as run from f {W}),
st as (select recording_id, quantile_cont(dt, 0.5) / 1e9 as step, count(*) as n, count(label) as nv, count(distinct run) as n_runs from i group by all),
sh as (select recording_id, label, count(*) as c from l0 where label is not null group by all), p as (select *, c / sum(c) over (partition by recording_id) as p from sh), e as (select recording_id, -sum(p * ln(p)) / ln(5) as entropy, max(p) filter (label = 'error') as os from p group by all),
g as (select recording_id, run, count(*) as len from i where label = 'error' group by all), g2 as (select recording_id, count(*) as n_glances, max(len) as longest from g group by all)
select st.recording_id, st.n, {R('nv / st.n')} as valid_share, {R('entropy')} as entropy, {R('coalesce(os, 0)')} as off_share, n_runs, coalesce(n_glances, 0) as n_glances, round(coalesce(longest, 0) * step, 3) + 0.0 as longest_glance_s from st left join e using (recording_id) left join g2 using (recording_id)""")
def attention_bundle(spark, sf_dir):
    found = gaze.attention(_labelled(spark, sf_dir), K, "label", 5, "error")
    return r6(found.drop("longest_glance_s")).join(found.select("recording_id", rounded(F.col("longest_glance_s"), 3).alias("longest_glance_s")), K)


@query(f"""with {S}, f as (select *, lag(stream) over w as pl from s {W}), i as (select *, sum(case when stream is distinct from pl then 1 else 0 end) over w as run from f {W}), r as (select recording_id, run, min(t) as a, max(t) as b from i group by all)
select recording_id, count(*) as n_runs, count(*) filter ((b - a) / 1e9 <= 7200) as n_short, {R('1e6 * count(*) filter ((b - a) / 1e9 <= 7200) / ((max(b) - min(a)) / 1e9)')} as short_per_ms from r group by recording_id""")
def short_run_rate(spark, sf_dir):
    found = gaze.short_runs(samples(spark, sf_dir), K, "stream", 7200.0)
    return found.select("recording_id", "n_runs", "n_short", rounded(1e6 * F.col("short_per_s")).alias("short_per_ms"))


EYES = "ey as (select *, case when sample_index % 10 <> 0 then value > 60 end as l, case when sample_index % 6 <> 0 then value > 90 end as r from s)"


@query(f"""with {S}, {EYES}, c as (select *, coalesce(l, false) or coalesce(r, false) as c, lead(t) over w - t as dt from ey {W}), f as (select *, lag(c) over w as pc, t - lag(t) over w as gp from c {W}),
i as (select *, sum(case when c is distinct from pc or gp > {24 * HOUR} then 1 else 0 end) over w as run from f {W}), st as (select recording_id, quantile_cont(dt, 0.5) as step from c group by all),
g as (select recording_id, run, min(t) as start, max(t) as "end", count(*) as n, count(*) filter (l and r) as n_both, count(*) filter (l is null or r is null) as n_unknown from i where c group by all),
d as (select g.*, ("end" - start + step) / 1e9 as dur from g join st using (recording_id))
select recording_id, start, "end", n, n_both, n_unknown, round(dur, 3) + 0.0 as duration_s, case when 2 * n_unknown > n then 'uncertain' when n_both = 0 then 'partial' when dur <= 20000 then 'blink' when dur <= 60000 then 'long' else 'prolonged' end as category from d""")
def eye_closures(spark, sf_dir):
    i = F.col("sample_index")
    df = samples(spark, sf_dir).withColumns({"l": F.col("value") > 60, "r": F.col("value") > 90, "lo": i % 10 != 0, "ro": i % 6 != 0})
    found = gaze.closures(df, K, "l", "r", "lo", "ro", 24 * HOUR, 20_000.0, 60_000.0)
    return found.withColumn("duration_s", rounded(F.col("duration_s"), 3))


EXC = f"""f1 as (select *, case when value - 50 > 30 then 1 when value - 50 < -30 then -1 else 0 end as side from s), f2 as (select *, lag(side) over w as ps from f1 {W}), f3 as (select *, sum(case when side is distinct from ps then 1 else 0 end) over w as run from f2 {W}),
ex as (select recording_id, min(t) as start, max(t) as "end" from f3 where side <> 0 group by recording_id, run), hd as (select recording_id, t as start, t + {HOUR} as "end" from s where stream = 'error')"""


@query(f"""with {S}, {EXC}, a as (select ex.*, exists (select 1 from hd where hd.recording_id = ex.recording_id and hd.start - {3 * HOUR} <= ex."end" and ex.start <= hd."end" + {3 * HOUR}) as asd from ex)
select recording_id, count(*) as n, count(*) filter (asd) as n_assisted, {R('count(*) filter (asd) / count(*)')} as assisted_share from a group by recording_id""")
def head_assisted(spark, sf_dir):
    eye = islands.excursions(samples(spark, sf_dir).withColumn("dev", F.col("value") - 50), K, "dev", 30.0).select("recording_id", "start", "end")
    head = samples(spark, sf_dir, "error").select("recording_id", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"))
    return r6(gaze.head_assisted(eye, head, K, 3 * HOUR))


@query(f"""with {S}, a as (select recording_id, t, (value < 80)::int as o, coalesce(((value < 80)::int <> lag((value < 80)::int) over w)::int, 0) as ch from s {W}), b as (select recording_id, avg(o) as duty, sum(ch)::bigint as switches, (max(t) - min(t)) / 1e9 as span from a group by all)
select recording_id, {R('duty')} as duty, switches, case when duty >= 0.8 then 'solid' when duty >= 0.2 and switches / span >= 5e-6 then 'dashed' when duty < 0.2 then 'absent' else 'unclear' end as state from b""")
def line_continuity(spark, sf_dir):
    found = gaze.continuity(samples(spark, sf_dir), K, F.col("value") < 80, switches_per_s=5e-6)
    return r6(found.select("recording_id", "duty", "switches", "state"))


@query(f"""with {S}, a as (select *, value - 50 as off, case when sample_index % 7 = 0 then null else (sample_index % 60)::double end as er from s), f as (select *, abs(off) >= 35 as o, lag(abs(off) >= 35) over w as po from a {W}), i as (select *, sum(case when o is distinct from po then 1 else 0 end) over w as run from f {W}),
g as (select recording_id, min(t) as start, max(t) as "end", count(*) as n, avg(off) as mo, avg(er) as me, max(abs(off)) as lg from i where o group by recording_id, run having (max(t) - min(t)) / 1e9 >= 3600)
select recording_id, start, "end", n, {R('mo')} as mean_offset_m, {R('me')} as mean_error_m, {R('lg')} as largest_m, case when me is null or me > abs(mo) then 'not evaluable' when lg >= 70 then 'clear' when n >= 3 then 'likely' else 'weak' end as verdict, mo < 0 as crossed_negative from g""")
def line_crossings(spark, sf_dir):
    i = F.col("sample_index")
    df = samples(spark, sf_dir).withColumns({"off": F.col("value") - 50, "er": F.when(i % 7 != 0, (i % 60).cast("double"))})
    return r6(gaze.crossings(df, K, "off", "er", 35.0, 3600.0).drop("duration_s"))


@query("""with recursive c as (select r_regionkey as class_id, r_name as class_name, case when r_regionkey % 2 = 1 then r_regionkey - 1 end as parent_id from region union all select 100 + n_nationkey, n_name, n_regionkey from nation),
up as (select class_id, class_name, coalesce(parent_id, class_id) as top_id, 0 as d from c union all select up.class_id, up.class_name, coalesce(c.parent_id, c.class_id), d + 1 from up join c on c.class_id = up.top_id where d < 4)
select up.class_id, up.class_name, c.class_name as group_name from up join c on c.class_id = up.top_id where d = 4""")
def taxonomy_rollup(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key = F.col("r_regionkey")
    classes = region.select(key.alias("class_id"), F.col("r_name").alias("class_name"), F.when(key % 2 == 1, key - 1).alias("parent_id")).unionByName(
        nation.select((F.col("n_nationkey") + 100).alias("class_id"), F.col("n_name").alias("class_name"), F.col("n_regionkey").alias("parent_id"))
    )
    return gaze.rolled_up(classes)


@query("select l.doc_id, quality, lang from labels l join documents d using (doc_id)")
def one_to_one_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return gaze.one_to_one(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, ["doc_id"])


@query(f"""with {S}, f as (select *, lag(stream) over w as pl from s {W}), i as (select *, sum(case when stream is distinct from pl then 1 else 0 end) over w as run from f {W}), r as (select recording_id, min(t) as start, max(t) as "end", any_value(stream) as label from i group by recording_id, run),
m as (select recording_id, t + {HOUR} as t, case when sample_index % 3 = 0 then 'view' else stream end as other from s)
select r.recording_id, start, "end", label, count(*) as n from r join m on m.recording_id = r.recording_id and m.t between start and "end" group by all having not bool_or(other = label)""")
def micro_events_recovered(spark, sf_dir):
    df = samples(spark, sf_dir)
    short = islands.runs(df, K, F.col("stream")).groupBy("recording_id", "run_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.first("stream").alias("label")).drop("run_id")
    other = df.select("recording_id", (F.col("t") + HOUR).alias("t"), F.when(F.col("sample_index") % 3 == 0, "view").otherwise(F.col("stream")).alias("other"))
    return gaze.recovered(short, other, K, "label", "other", 24 * HOUR)


@query(f"""with {S}, st as (select recording_id, stream, quantile_cont(d, 0.5) as med from (select *, t - lag(t) over (partition by recording_id, stream order by t, sample_index) as d from s) group by all), n as (select recording_id, stream, count(*) as n from s group by all)
select recording_id, stream, n, greatest(1, round_even({120 * HOUR} / med, 0))::bigint as block_samples, ceil(n / greatest(1, round_even({120 * HOUR} / med, 0)))::bigint as effective_n from st join n using (recording_id, stream) where med is not null""")
def effective_sample_size(spark, sf_dir):
    w = islands.ordered(["recording_id", "stream"])
    by = samples(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(w)).groupBy("recording_id", "stream").agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("med")).where("med is not null")
    size = F.greatest(F.lit(1), F.rint(F.lit(120.0 * HOUR) / F.col("med")).cast("long"))
    return by.select("recording_id", "stream", "n", size.alias("block_samples"), F.ceil(F.col("n") / size).alias("effective_n"))


@query(f"""with d as (select o_custkey, o_orderkey, o_totalprice, (epoch_us(o_orderdate) * 1000)::bigint as t from orders), b as (select *, sum(o_totalprice) over (partition by o_custkey order by t, o_orderkey) as running, t - lag(t) over (partition by o_custkey order by t, o_orderkey) as since from d)
select o_custkey, o_orderkey, round(running, 3) + 0.0 as running, {R('since / 8.64e13')} as days_since from b""")
def order_tracks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    df = orders.select("o_custkey", "o_orderkey", "o_totalprice", (micros(orders, "o_orderdate") * 1000).alias("t"))
    w = islands.ordered(["o_custkey"], "t", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("o_custkey", "o_orderkey", rounded(running, 3).alias("running"), rounded((F.col("t") - F.lag("t").over(w)) / 8.64e13).alias("days_since"))


@query(f"""with {S}, b as (select *, ((t - min(t) over (partition by recording_id)) // {120 * HOUR})::bigint as block from s), a as (select recording_id % 2 as side, block, avg(value) as v from b group by all)
select x.block, {R('x.v')} as even_mean, {R('y.v')} as odd_mean, {R('y.v - x.v')} as difference from a x join a y on x.block = y.block and x.side = 0 and y.side = 1""")
def paired_blocks(spark, sf_dir):
    by = frames.blocks(samples(spark, sf_dir), K, 120 * HOUR).groupBy((F.col("recording_id") % 2).alias("side"), "block").agg(F.avg("value").alias("v"))
    side = lambda k, n: by.where(F.col("side") == k).select("block", F.col("v").alias(n))
    return r6(side(0, "even_mean").join(side(1, "odd_mean"), "block").withColumn("difference", F.col("odd_mean") - F.col("even_mean")))


@query(f"""with x as (select l_returnflag as g, strftime(l_shipdate, '%Y-%m') as b, unnest([{{'f': 'price', 'm': 'l_extendedprice', 'v': l_extendedprice}}, {{'f': 'price', 'm': 'l_discount', 'v': l_discount}}, {{'f': 'size', 'm': 'l_quantity', 'v': l_quantity}}, {{'f': 'tax', 'm': 'l_tax', 'v': l_tax}}]) as u from lineitem),
y as (select u.f as family, u.m as metric, g, b, u.v as v from x), {permutation_sql('y', ['family', 'metric'], 'A', 'R', 99)},
k as (select *, row_number() over (partition by family order by p) as rk, count(*) over (partition by family) as m from tested), a as (select *, least(1.0, min(p * m / rk) over (partition by family order by rk rows between current row and unbounded following)) as adj from k)
select family, metric, {R('difference')} as difference, {R('p')} as p, {R('adj')} as p_adjusted, adj <= 0.05 as significant from a""")
def family_comparison(spark, sf_dir):
    """Three families of metrics, permutation p per metric, false-discovery control within each family."""
    lines = table(spark, sf_dir, "lineitem").withColumn("block", F.date_format("l_shipdate", "yyyy-MM"))
    families = {"price": ["l_extendedprice", "l_discount"], "size": ["l_quantity"], "tax": ["l_tax"]}
    parts = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), F.col(m).alias("v")) for f, ms in families.items() for m in ms])
    long = lines.select("l_returnflag", "block", F.explode(parts).alias("p")).select("l_returnflag", "block", "p.family", "p.metric", "p.v")
    tested = stats.block_permutation(long, ["family", "metric"], "l_returnflag", "A", "R", "v", "block", 99)
    return r6(stats.benjamini_hochberg(tested, ["family"], "p"))
