"""Queries on aggregates, events, places, labels, statistics and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import events, islands, labels, quality, select, spatial, stats
from .base import DRAW, HOUR, KS, K, S, permutation_sql, query, r6, rounded, samples, table

R = lambda x: f"round({x}, 6) + 0.0"
W = "window w as (partition by recording_id order by t, sample_index)"


# --- aggregates


@query(f"""with {S} select stream, count(value) as n, {R('avg(value)')} as mean, {R('stddev_samp(value)')} as sd, {R('quantile_cont(value, 0.05)')} as p05, {R('quantile_cont(value, 0.25)')} as p25, {R('quantile_cont(value, 0.5)')} as median,
{R('quantile_cont(value, 0.75)')} as p75, {R('quantile_cont(value, 0.95)')} as p95, {R('min(value)')} as lowest, {R('max(value)')} as highest, {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} as iqr from s group by stream""")
def describe_values(spark, sf_dir):
    df = samples(spark, sf_dir)
    plain = df.groupBy("stream").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    at = stats.quantiles(df, ["stream"], "value", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return r6(plain.join(at, "stream").withColumn("iqr", F.col("p75") - F.col("p25")))


@query(f"""select c_nationkey, count(*) as n, {R('avg(c_acctbal)')} as mean_balance, (select m.c_mktsegment from (select c_mktsegment, count(*) k from customer x where x.c_nationkey = c.c_nationkey group by 1 order by k desc, c_mktsegment limit 1) m) as modal_segment,
avg((c_acctbal > 0)::int) >= 0.5 as mostly_positive, min(c_custkey) as first_key, count(distinct c_mktsegment) as n_segments from customer c group by c_nationkey""")
def group_modal(spark, sf_dir):
    return r6(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.avg("c_acctbal").alias("mean_balance"), F.mode("c_mktsegment", True).alias("modal_segment"), (F.avg((F.col("c_acctbal") > 0).cast("int")) >= 0.5).alias("mostly_positive"),
        F.min("c_custkey").alias("first_key"), F.count_distinct("c_mktsegment").alias("n_segments"),
    ))


@query(f"""with {S} select recording_id, {R('((degrees(atan2(avg(sin(radians(value * 0.72))), avg(cos(radians(value * 0.72))))) % 360) + 360) % 360')} as mean_heading_deg from s group by recording_id""")
def circular_mean(spark, sf_dir):
    return r6(samples(spark, sf_dir).groupBy("recording_id").agg(fn.circular_mean_deg(F.col("value") * 0.72).alias("mean_heading_deg")))


@query(f"""with {S}, p as (select (max(t) - min(t)) / 6e10 as minutes from s) select stream, count(*) as n, {R('1e3 * count(*) / any_value(minutes)')} as per_1000_minutes, {R('count(*) / sum(count(*)) over ()')} as share from s, p group by stream""")
def category_rates(spark, sf_dir):
    df = samples(spark, sf_dir)
    span = df.agg(((F.max("t") - F.min("t")) / 6e10).alias("minutes"), F.count("*").alias("total"))
    by = df.groupBy("stream").agg(F.count("*").alias("n")).join(F.broadcast(span), how="cross")
    return r6(by.select("stream", "n", (1e3 * F.col("n") / F.col("minutes")).alias("per_1000_minutes"), (F.col("n") / F.col("total")).alias("share")))


@query("""with x as (select case when n_chars < 300 then 'short' || case when lang = 'en' then '; english' else '' end when n_chars > 5000 then 'long; ' || lang else null end as reason from documents)
select trim(split_part(reason, ';', 1)) as first_reason, count(*) as n from x where reason is not null group by 1""")
def reason_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    reason = F.when(F.col("n_chars") < 300, F.concat(F.lit("short"), F.when(F.col("lang") == "en", "; english").otherwise(""))).when(F.col("n_chars") > 5000, F.concat(F.lit("long; "), "lang"))
    return docs.select(reason.alias("reason")).where("reason is not null").groupBy(F.trim(F.split("reason", ";")[0]).alias("first_reason")).agg(F.count("*").alias("n"))


@query(f"""with {S}, c as (select recording_id, stream, count(*) as c from s group by all), p as (select recording_id, c / sum(c) over (partition by recording_id) as p from c)
select recording_id, count(*) as n_present, {R('-sum(p * ln(p)) / ln(5)')} as entropy, {R('case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end')} as entropy_present from p group by recording_id""")
def label_entropy(spark, sf_dir):
    return r6(labels.label_entropy(samples(spark, sf_dir), K, "stream", 5))


@query(f"""with {S}, d as (select *, (lead(t) over w - t) / 1e9 as dt from s {W}), m as (select recording_id, quantile_cont(dt, 0.5) as md from d group by all), x as (select recording_id, stream, sum(coalesce(dt, md)) as sec from d join m using (recording_id) group by all)
select recording_id, stream, round(sec, 3) + 0.0 as seconds, {R('sec / sum(sec) over (partition by recording_id)')} as share from x""")
def time_per_label(spark, sf_dir):
    found = labels.time_per_label(samples(spark, sf_dir), K, "stream")
    return found.select(*KS, rounded(F.col("seconds"), 3).alias("seconds"), rounded(F.col("share")).alias("share"))


@query(f"""select l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)')} as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 as icept, {R('regr_r2(l_extendedprice, l_quantity)')} as r2, {R('corr(l_extendedprice, l_quantity)')} as pearson from lineitem group by l_returnflag""")
def linear_fit(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*stats.linear_fit("l_extendedprice", "l_quantity"))
    return found.select("l_returnflag", rounded(F.col("slope")).alias("slope"), rounded(F.col("icept"), 4).alias("icept"), rounded(F.col("r2")).alias("r2"), rounded(F.col("pearson")).alias("pearson"))


@query(f"""with x as (select o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey)::double as rx, row_number() over (partition by o_orderpriority order by o_custkey, o_orderkey)::double as ry from orders)
select o_orderpriority, {R('corr(rx, ry)')} as spearman, count(*) as n from x group by o_orderpriority""")
def spearman_ordinal(spark, sf_dir):
    return r6(stats.spearman(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey", "o_orderkey"))


@query(f"""with {S}, y as (select *, value * (sample_index % 7) as other, row_number() over w as rn from s {W}), l as (select unnest(range(-3, 4))::int as lag), p as (select a.recording_id, lag, a.value as x, b.other as z from y a cross join l join y b on b.recording_id = a.recording_id and b.rn = a.rn + lag),
c as (select recording_id, lag, corr(x, z) as r, count(*) as n from p group by all having count(*) >= 8), k as (select *, row_number() over (partition by recording_id order by abs(r) desc, lag) as rk from c) select recording_id, lag, {R('r')} as r from k where rk = 1""")
def cross_correlation(spark, sf_dir):
    return r6(stats.cross_correlation(samples(spark, sf_dir).withColumn("other", F.col("value") * (F.col("sample_index") % 7)), K, "value", "other", 3))


@query(f"""with {S}, x as (select recording_id, value, lag(value) over w as pv from s {W}) select recording_id, {R('corr(value, pv)')} as autocorrelation, case when count(value) >= 60 then {R('avg(value)')} end as guarded_mean,
{R('sqrt(avg((value - pv) * (value - pv)))')} as rmssd, {R('(count(*) filter (value > pv) - count(*) filter (value < pv)) / count(pv)::double')} as asymmetry, {R('exp(avg(ln(value)))')} as geometric_mean from x group by recording_id""")
def sequence_bundle(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("pv", F.lag("value").over(islands.ordered(K)))
    up, down = F.count_if(F.col("value") > F.col("pv")), F.count_if(F.col("value") < F.col("pv"))
    return r6(df.groupBy("recording_id").agg(
        F.corr("value", "pv").alias("autocorrelation"), stats.mean_if_enough("value", 60).alias("guarded_mean"), F.sqrt(F.avg(F.pow(F.col("value") - F.col("pv"), 2))).alias("rmssd"),
        fn.ratio(up - down, F.count("pv")).alias("asymmetry"), stats.geometric_mean("value").alias("geometric_mean"),
    ))


@query(f"""with q as (select p_brand, quantile_cont(p_size, 0.05) as sl, quantile_cont(p_size, 0.95) as sh, quantile_cont(p_retailprice, 0.05) as rl, quantile_cont(p_retailprice, 0.95) as rh from part group by all)
select p_brand, p_partkey, {R('((case when sh - sl <= 1e-12 then 0.5 else least(1, greatest(0, (p_size - sl) / (sh - sl))) end) + (case when rh - rl <= 1e-12 then 0.5 else least(1, greatest(0, (p_retailprice - rl) / (rh - rl))) end)) / 2')} as index_value, 1.0::double as completeness from part join q using (p_brand)""")
def robust_index(spark, sf_dir):
    return r6(stats.robust_index(table(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"], ["p_partkey"]))


@query(f"""with m as (select o_orderstatus, date_trunc('month', o_orderdate) as mo, avg(o_totalprice) as v from orders group by all), b as (select o_orderstatus, arg_min(v, mo) as base from m group by all)
select m.o_orderstatus, strftime(mo, '%Y-%m') as mo, {R('v - base')} as difference, {R('100 * (v - base) / abs(base)')} as percent from m join b using (o_orderstatus)""")
def percent_of_baseline(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("mo")).agg(F.avg("o_totalprice").alias("v"))
    base = F.min_by("v", "mo").over(Window.partitionBy("o_orderstatus"))
    return r6(m.withColumn("base", base).select("o_orderstatus", "mo", (F.col("v") - F.col("base")).alias("difference"), fn.percent_of(F.col("v"), F.col("base")).alias("percent")))


# --- joins by key and reshaping


@query(f"""with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) select c_custkey, o_orderkey, {R('o_totalprice')} as first_price from customer left join o on o_custkey = c_custkey and rn = 1""")
def left_join_first(spark, sf_dir):
    first = select.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 1).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("first_price"))
    return r6(table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left"))


@query(f"""with a as (select date_trunc('month', o_orderdate) as m, avg(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), b as (select date_trunc('month', o_orderdate) as m, avg(o_totalprice) as v from orders where o_orderstatus = 'P' group by 1)
select strftime(coalesce(a.m, b.m), '%Y-%m') as block, {R('a.v')} as f_mean, {R('b.v')} as p_mean from a full join b on a.m = b.m""")
def full_join_blocks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("block", F.date_format("o_orderdate", "yyyy-MM"))
    side = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("block").agg(F.avg("o_totalprice").alias(f"{s.lower()}_mean"))
    return r6(side("F").join(side("P"), "block", "full"))


@query(f"""select p_brand, {R("avg(l_quantity) filter (l_returnflag = 'A')")} as a, {R("avg(l_quantity) filter (l_returnflag = 'N')")} as n, {R("avg(l_quantity) filter (l_returnflag = 'R')")} as r from lineitem join part on l_partkey = p_partkey group by p_brand""")
def pivot_wide(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return r6(joined.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")).withColumnsRenamed({"A": "a", "N": "n", "R": "r"}))


@query(f"""with x as (select p_brand, {R('avg(p_size)')} as mean_size, {R('avg(p_retailprice)')} as mean_price from part group by p_brand) unpivot x on mean_size, mean_price into name metric value amount""")
def unpivot_long(spark, sf_dir):
    wide = r6(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mean_size"), F.avg("p_retailprice").alias("mean_price")))
    return wide.unpivot(["p_brand"], ["mean_size", "mean_price"], "metric", "amount")


@query("select c_nationkey as k, 'customer' as side from customer union all select s_nationkey, 'supplier' from supplier")
def set_union_all(spark, sf_dir):
    side = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(t).alias("side"))
    return side("customer", "c_nationkey").unionByName(side("supplier", "s_nationkey"))


@query("select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'")
def set_intersection(spark, sf_dir):
    keys = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("P"))


@query("select o_custkey as k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O'")
def set_difference(spark, sf_dir):
    keys = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").subtract(keys("O"))


@query("with x as (select doc_id, text, first_value(doc_id) over (partition by md5(text) order by doc_id) as first_of, row_number() over (partition by md5(text) order by doc_id) as rn from documents) select doc_id, first_of from x where rn > 1")
def duplicate_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return quality.duplicates(docs, "digest", "doc_id").select("doc_id", "first_of")


# --- events and windows


EVENTS = f"""f as (select *, value > 100 as hi, value < 2 as lo from s), g as (select *, lag(hi) over w as phi, lag(lo) over w as plo from f {W}),
i as (select *, sum(case when hi is distinct from phi then 1 else 0 end) over w as rh, sum(case when lo is distinct from plo then 1 else 0 end) over w as rl from g {W}),
u as (select recording_id, 'high' as kind, min(t) as start, max(t) as end, count(*) as n_samples from i where hi group by recording_id, rh union all select recording_id, 'low', min(t), max(t), count(*) from i where lo group by recording_id, rl),
ev as (select *, kind || '_' || lpad((row_number() over (partition by recording_id, kind order by start))::varchar, 3, '0') as event_name from u)"""


def _events(spark, sf_dir):
    return events.detect(samples(spark, sf_dir), K, {"high": F.col("value") > 100, "low": F.col("value") < 2})


@query(f"""with {S}, {EVENTS} select recording_id, kind, start, "end", n_samples, {R('("end" - start) / 1e9')} as duration_s, event_name from ev""")
def event_detection(spark, sf_dir):
    return r6(_events(spark, sf_dir))


#: Window names with offsets in hours, as the oracle has them.
SPEC = [("before", -48.0, -6.0), ("approach", -6.0, 0.0), ("event", 0.0, 0.0), ("after", 0.0, 36.0)]
SPEC_SQL = "sp as (select * from (values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPEC) + ") v(win, fh, th))"
LAID = f"""with {S}, {EVENTS}, {SPEC_SQL}, sn as (select recording_id, min(t) as start0, max(t) as end0 from s group by all),
l as (select ev.recording_id, event_name, kind, win, ev.start as es, ev."end" as ee, start0, end0, (case when fh >= 0 and win <> 'event' then ev."end" else ev.start end) as anchor, fh, th from ev cross join sp join sn using (recording_id)),
q as (select *, (anchor + fh * {HOUR})::bigint as wa, (anchor + th * {HOUR})::bigint as wb from l), q2 as (select *, greatest(wa, start0) as a, least(wb, end0) as b from q),
tr as (select q2.recording_id, q2.event_name, q2.win, max(case when o."end" > a and o."end" <= es and o.start < b then o."end" end) as ta, min(case when o.start >= ee and o."end" > a and o.start < b then o.start end) as tb
from q2 join ev o on o.recording_id = q2.recording_id and o.kind = 'high' and o.kind <> q2.kind group by all),
z as (select q2.*, ta, tb, greatest(a, ta) as a2, least(b, tb) as b2 from q2 left join tr using (recording_id, event_name, win)), win as (select recording_id, event_name, kind, win as window, a2 as start, greatest(a2, b2) as "end", a2 <> wa or greatest(a2, b2) <> wb as clipped, nullif(concat_ws('; ', case when start0 > wa then 'recording starts later' end, case when end0 < wb then 'recording ends earlier' end, case when ta > greatest(wa, start0) then 'event of another kind before' end, case when tb < least(wb, end0) then 'event of another kind after' end), '') as why from z)"""


def _windows(spark, sf_dir, reasons=False):
    df = samples(spark, sf_dir)
    spans = df.groupBy(*K).agg(F.min("t").alias("start0"), F.max("t").alias("end0"))
    spec = spark.createDataFrame([(n, 3600 * a, 3600 * b) for n, a, b in SPEC], "name string, from_s double, to_s double")
    return events.windows(_events(spark, sf_dir), spec, spans, K, "event_name", ["high"], 24 * HOUR, reasons)


@query(f'{LAID} select recording_id, event_name, "window", why as clip_reason from win')
def window_clip_reasons(spark, sf_dir):
    return _windows(spark, sf_dir, True).select("recording_id", "event_name", "window", "clip_reason")


@query(f"{LAID} select * exclude (why) from win")
def event_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


SUMMARY = f"""{LAID}, sm as (select win.*, count(s.value) as n, case when count(s.value) >= 2 then avg(s.value) end as mean_value from win left join s on s.recording_id = win.recording_id and s.t between win.start and win."end" group by all)"""


@query(f"{SUMMARY} select * exclude (mean_value, why), {R('mean_value')} as mean_value from sm")
def event_window_means(spark, sf_dir):
    return r6(events.summarise(_windows(spark, sf_dir), samples(spark, sf_dir), K, "event_name", "value", 24 * HOUR))


@query(f"""{SUMMARY}, w as (select recording_id, event_name, kind, max(mean_value) filter ("window" = 'before') as before, max(mean_value) filter ("window" = 'approach') as approach, max(mean_value) filter ("window" = 'after') as after from sm group by all)
select recording_id, event_name, kind, {R('before')} as before, {R('approach')} as approach, {R('after')} as after, {R('approach - before')} as approach_delta, {R('after - before')} as after_delta from w""")
def event_response(spark, sf_dir):
    summary = events.summarise(_windows(spark, sf_dir), samples(spark, sf_dir), K, "event_name", "value", 24 * HOUR)
    return r6(events.response(summary, K, "event_name", ["before", "approach", "after"], "before"))


@query(f"""with {S}, {EVENTS}, p as (select recording_id, event_name, 'pre' as phase, start - {24 * HOUR} as a, start as b from ev union all select recording_id, event_name, 'event', start, "end" from ev union all select recording_id, event_name, 'post', "end", "end" + {24 * HOUR} from ev)
select p.recording_id, event_name, phase, count(*) as n, {R('avg(value)')} as mean_value from p join s on s.recording_id = p.recording_id and s.t >= a and s.t < b group by all""")
def event_phases(spark, sf_dir):
    return r6(events.phases(_events(spark, sf_dir), samples(spark, sf_dir), K, "event_name", "value", 24 * HOUR, 24 * HOUR))


@query(f"""with {S}, f as (select *, value > 60 as flag, lag(value > 60) over w as pf, lead(t) over w - t as dt from s {W}), i as (select *, sum(case when flag is distinct from pf then 1 else 0 end) over w as run from f {W}), st as (select recording_id, quantile_cont(dt, 0.5) as step from f group by all),
l as (select i.recording_id, flag, run, count(*) as n, case when count(*) = 1 then any_value(step) else max(t) - min(t) end as len from i join st using (recording_id) group by i.recording_id, flag, run),
b as (select recording_id, coalesce(sum(n) filter (flag), 0) as n_true, sum(n) as n, quantile_cont(len, 0.5) filter (flag) as lt, quantile_cont(len, 0.5) filter (not flag) as lf from l group by all)
select recording_id, n::bigint as n, n_true::bigint as n_true, case when n_true / n <= 0.35 and lt < lf then 'true' when 1 - n_true / n <= 0.35 and lf < lt then 'false' else 'undecided' end as closed_value from b""")
def flag_polarity(spark, sf_dir):
    return events.polarity(samples(spark, sf_dir).withColumn("flag", F.col("value") > 60), K, "flag")


# --- places: a plane from keys


FIX = f"fx as (select recording_id, sample_index, t, value, 45 + value / 1000 as latitude, 7 + (sample_index % 100) / 1000.0 as longitude, case when sample_index % 11 = 0 then null else (sample_index % 80)::double end as accuracy from s)"


def _fixes(spark, sf_dir):
    i = F.col("sample_index")
    return samples(spark, sf_dir).select("recording_id", "sample_index", "t", "value", (45 + F.col("value") / 1000).alias("latitude"), (7 + (i % 100) / 1000.0).alias("longitude"), F.when(i % 11 != 0, (i % 80).cast("double")).alias("accuracy"))


@query(f"with {S}, {FIX} select recording_id, count(*) as n, count(accuracy) as n_known from fx where accuracy is null or accuracy <= 50 group by recording_id")
def valid_fixes(spark, sf_dir):
    return spatial.valid_fix(_fixes(spark, sf_dir)).groupBy("recording_id").agg(F.count("*").alias("n"), F.count("accuracy").alias("n_known"))


@query(f"""with {S}, {FIX}, p as (select recording_id, sample_index, latitude as la, longitude as lo, lag(latitude) over w as lb, lag(longitude) over w as lc from fx {W})
select recording_id, sample_index, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(la - lb) / 2), 2) + cos(radians(lb)) * cos(radians(la)) * pow(sin(radians(lo - lc) / 2), 2)))), 3) + 0.0 as step_m,
round(((degrees(atan2(sin(radians(lo - lc)) * cos(radians(la)), cos(radians(lb)) * sin(radians(la)) - sin(radians(lb)) * cos(radians(la)) * cos(radians(lo - lc)))) % 360) + 360) % 360, 4) + 0.0 as bearing_deg from p where lb is not null""")
def step_distance_bearing(spark, sf_dir):
    w = islands.ordered(K)
    df = _fixes(spark, sf_dir).withColumns({"lb": F.lag("latitude").over(w), "lc": F.lag("longitude").over(w)}).where("lb is not null")
    args = (F.col("lb"), F.col("lc"), F.col("latitude"), F.col("longitude"))
    return df.select("recording_id", "sample_index", rounded(fn.haversine_m(*args), 3).alias("step_m"), rounded(fn.bearing_deg(*args), 4).alias("bearing_deg"))


XY = f"xy as (select recording_id, sample_index, t, value as x, (sample_index % 100)::double as y from s)"


def _plane(spark, sf_dir):
    return samples(spark, sf_dir).select("recording_id", "sample_index", "t", F.col("value").alias("x"), (F.col("sample_index") % 100).cast("double").alias("y"))


TRACK = f"""st as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step_m from xy {W}), tk as (select *, sum(step_m) over w as distance_m, sum(step_m) over (partition by recording_id) as total from st {W})"""


@query(f"with {S}, {XY}, {TRACK} select recording_id, sample_index, {R('distance_m')} as distance_m, {R('distance_m / total')} as progress, step_m < 20 as is_stopped from tk")
def track_progress(spark, sf_dir):
    return r6(spatial.track(_plane(spark, sf_dir), K, "x", "y", stopped_m=20.0).select("recording_id", "sample_index", "distance_m", "progress", "is_stopped"))


@query(f"with {S}, {XY}, {TRACK} select recording_id, sample_index, {R('distance_m - 500')} as distance_m from tk where total > 1000 and distance_m between 500 and total - 500")
def redacted_track(spark, sf_dir):
    return r6(spatial.redact_ends(spatial.track(_plane(spark, sf_dir), K, "x", "y").select("recording_id", "sample_index", "distance_m"), K, "distance_m", 500.0))


@query(f"""with {S}, {XY}, c as (select *, lag(x) over w as ax, lag(y) over w as ay, lead(x) over w as cx, lead(y) over w as cy from xy {W}), m as (select *, case when ax is not null and cx is not null then
coalesce(2 * abs((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / nullif(sqrt(pow(x - ax, 2) + pow(y - ay, 2)) * sqrt(pow(cx - x, 2) + pow(cy - y, 2)) * sqrt(pow(cx - ax, 2) + pow(cy - ay, 2)), 0), 0) end as k from c)
select recording_id, sample_index, round(coalesce(k, lead(k) over w, lag(k) over w), 5) + 0.0 as curvature from m {W}""")
def track_curvature(spark, sf_dir):
    found = spatial.curvature(_plane(spark, sf_dir), K, "x", "y")
    return found.select("recording_id", "sample_index", rounded(F.col("curvature"), 5).alias("curvature"))


BINS = f"""bn as (select recording_id % 2 as side, 'w' || (sample_index % 5) || '_b' || floor(x / 25)::int || '_' || case when y > 50 then 'B' else 'A' end as bin_key, count(*) as n_samples, ((degrees(atan2(avg(sin(radians(y * 3.6))), avg(cos(radians(y * 3.6))))) % 360) + 360) % 360 as hd, avg(1 - y / 200) as q, avg(x) as off from xy group by all)"""


def _bins(spark, sf_dir, side):
    df = _plane(spark, sf_dir).where(F.col("recording_id") % 2 == side).withColumns({"way": F.col("sample_index") % 5, "heading": F.col("y") * 3.6, "back": F.col("y") > 50, "quality": 1 - F.col("y") / 200})
    return spatial.bins(df, [], "way", "x", 25.0, "heading", "back", "quality")


@query(f"""with {S}, {XY}, {BINS} select bin_key, n_samples, round(hd, 3) + 0.0 as mean_heading_deg, {R('q')} as mean_quality, {R('off')} as mean_offset_m from bn where side = 0""")
def route_bins(spark, sf_dir):
    b = _bins(spark, sf_dir, 0)
    return b.select("bin_key", "n_samples", rounded(F.col("mean_heading_deg"), 3).alias("mean_heading_deg"), rounded(F.col("mean_quality")).alias("mean_quality"), rounded(F.col("mean_offset_m")).alias("mean_offset_m"))


@query(f"""with {S}, {XY}, {BINS}, j as (select a.bin_key, a.n_samples as na, b.n_samples as nb, abs(a.off - b.off) as d, abs((((a.hd - b.hd + 180) % 360) + 360) % 360 - 180) as h, least(a.q, b.q) as lq, sqrt(a.q * b.q) as pq from bn a join bn b using (bin_key) where a.side = 0 and b.side = 1),
r as (select *, nullif(concat_ws('; ', case when least(na, nb) < 3 then 'too few samples' end, case when d > 4 then 'too far apart' end, case when h > 25 then 'headings differ' end, case when lq < 0.6 then 'low quality' end), '') as rejection_reason from j)
select bin_key, rejection_reason, rejection_reason is null as paired, {R('pq')} as pair_quality from r""")
def paired_bins(spark, sf_dir):
    found = spatial.pair_bins(_bins(spark, sf_dir, 0), _bins(spark, sf_dir, 1), 3, 4.0, 25.0, 0.6)
    return r6(found.select("bin_key", "rejection_reason", "paired", "pair_quality"))


@query(f"""with pt as (select c_custkey, c_acctbal / 10 as x, (c_custkey % 997)::double as y from customer), pl as (select s_suppkey, s_acctbal / 10 as x, (s_suppkey * 37 % 997)::double as y from supplier),
d as (select c_custkey, s_suppkey, sqrt(pow(pt.x - pl.x, 2) + pow(pt.y - pl.y, 2)) as d from pt cross join pl), m as (select *, row_number() over (partition by c_custkey order by d, s_suppkey) as rn from d where d <= 40)
select pt.c_custkey, s_suppkey, case when d is null then -1.0 else {R('d')} end as distance from pt left join m on m.c_custkey = pt.c_custkey and rn = 1""")
def nearest_place(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    places = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") * 37 % 997).cast("double").alias("y"))
    found = spatial.nearest_place(points, places, "c_custkey", "x", "y", "s_suppkey", 40.0)
    return found.select("c_custkey", "s_suppkey", F.when(F.col("distance") == float("inf"), -1.0).otherwise(rounded(F.col("distance"))).alias("distance"))


# --- labels


@query("select quality as truth, toxic as predicted, count(*) as n from labels where quality is not null and toxic is not null group by all")
def label_confusion(spark, sf_dir):
    return labels.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""with c as (select quality as a, toxic as b, count(*) as n from labels group by all), l as (select distinct unnest([a, b]) as label from c),
x as (select label, sum(n) filter (a = label and b = label) as tp, sum(n) filter (a = label) as t, sum(n) filter (b = label) as p from l cross join c group by label)
select label, coalesce(tp, 0)::bigint as tp, (coalesce(p, 0) - coalesce(tp, 0))::bigint as fp, (coalesce(t, 0) - coalesce(tp, 0))::bigint as fn, {R('coalesce(tp, 0) / nullif(p, 0)')} as precision, {R('coalesce(tp, 0) / nullif(t, 0)')} as recall, {R('coalesce(tp, 0) / nullif(coalesce(t, 0) + coalesce(p, 0) - coalesce(tp, 0), 0)')} as iou from x""")
def class_scores(spark, sf_dir):
    return r6(labels.class_scores(labels.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))


@query(f"""with j as (select d.lang, source, quality, toxic from documents d join labels l using (doc_id)) select lang, count(*) as n, count(*) filter (source <> 'src0' and quality is not null) as n_both, {R("count(*) filter (source <> 'src0' and quality is not null and quality = toxic) / nullif(count(*) filter (source <> 'src0' and quality is not null), 0)")} as agreement from j group by lang""")
def label_agreement(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return r6(labels.agreement(df, "quality", "toxic", F.col("source") != "src0", F.col("quality").isNotNull(), ["lang"]))


@query(f"""with v as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as a from embeddings), p as (select vec_id, list_transform(a, lambda x: x / list_sum(a)) as p from v), m as (select vec_id, p, list_max(p) as top, list_position(p, list_max(p)) as pos from p)
select vec_id, (pos - 1)::int as top_class, round(top, 9) + 0.0 as top_p, round(top - list_sort(p, 'desc')[2], 9) + 0.0 as margin, {R('list_sum(list_transform(p, lambda x: case when x > 0 then -x * ln(x) else 0 end)) / ln(64)')} as entropy,
(case when top < 0.05 then 1 else 0 end) | (case when top - list_sort(p, 'desc')[2] < 0.002 then 2 else 0 end) as reasons from m""")
def probability_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", labels.normalised(F.col("embedding").cast("array<double>")).alias("p"))
    at, top, _, margin = labels.top_two(F.col("p"))
    bits = fn.reason_bits([top < 0.05, margin < 0.002])
    return v.select("vec_id", at.alias("top_class"), rounded(top, 9).alias("top_p"), rounded(margin, 9).alias("margin"), rounded(fn.entropy(F.col("p"), F.lit(64))).alias("entropy"), bits.alias("reasons"))


@query(f"""with x as (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_extendedprice::float desc, l_linenumber) as rn from lineitem) select l_orderkey, l_linenumber, {R('l_quantity')} as l_quantity from x where rn = 1""")
def overlap_resolution(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return r6(labels.resolve_overlap(lines, ["l_orderkey"], "l_quantity", "l_extendedprice", "l_linenumber").drop("l_extendedprice"))


@query("""with recursive o as (select p_brand, p_partkey as box_id, p_retailprice as score, (p_partkey % 50)::double as x0, (p_partkey % 37)::double as y0, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part),
g as (select distinct p_brand, 0::bigint as i, []::struct(x double, y double, id bigint)[] as kept from part union all
  select o.p_brand, o.rn, case when len(list_filter(kept, lambda k: greatest(0, 10 - abs(k.x - x0)) * greatest(0, 10 - abs(k.y - y0)) > 0.5 * (200 - greatest(0, 10 - abs(k.x - x0)) * greatest(0, 10 - abs(k.y - y0))))) > 0 then kept else list_append(kept, {'x': x0, 'y': y0, 'id': box_id}) end
  from g join o on o.p_brand = g.p_brand and o.rn = g.i + 1),
l as (select p_brand, max(i) as i from g group by p_brand), k as (select g.p_brand, unnest(kept).id as box_id from g join l using (p_brand, i))
select p_brand, box_id, score, x0, y0, x0 + 10 as x1, y0 + 10 as y1 from o join k using (p_brand, box_id)""")
def box_suppression(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("box_id"), F.col("p_retailprice").alias("score"), (F.col("p_partkey") % 50).cast("double").alias("x0"), (F.col("p_partkey") % 37).cast("double").alias("y0"))
    return labels.nms(p.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10}), ["p_brand"], 0.5)


VOCAB = [("metal", "steel"), ("metal", "brass plated"), ("light", "pale almond"), ("dark", "midnight black"), ("warm", "red rose"), ("warm", "hot orange")]


TOKENS = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""with vo(class_name, phrase) as (values {', '.join(map(str, VOCAB))}), v as (select class_name, list_distinct({TOKENS('phrase')}) as vt, array_to_string({TOKENS('phrase')}, ' ') as vk from vo),
n as (select count(*) as big from vo), w as (select tok, ln((any_value(big) + 1) / (count(*) + 0.5)) + 0.1 as w from (select unnest(vt) as tok from v), n group by tok),
own as (select p_partkey, list_distinct({TOKENS('p_name')}) as pt, array_to_string({TOKENS('p_name')}, ' ') as pk from part), mine as (select p_partkey, tok, coalesce(w, ln(big + 1) + 0.8) as w from (select p_partkey, unnest(pt) as tok from own) left join w using (tok), n),
mt as (select p_partkey, sum(w) as mine from mine group by 1), th as (select class_name, vk, tok, w from (select class_name, vk, unnest(vt) as tok from v) join w using (tok)), tt as (select class_name, vk, sum(w) as theirs from th group by all),
sh as (select p_partkey, class_name, vk, sum(mine.w) as shared from mine join th using (tok) group by all),
sc as (select p_partkey, class_name, max(case when pk = vk then 1.0::double else least(0.99, shared / (mine + theirs - shared)) end) as score from sh join mt using (p_partkey) join tt using (class_name, vk) join own using (p_partkey) group by all),
rk as (select *, row_number() over x as rn, lead(score) over x as nxt from sc window x as (partition by p_partkey order by score desc, class_name))
select p_partkey, case when coalesce(score, 0) >= 0.5 then class_name end as class_name, {R('coalesce(score, 0)')} as score, case when coalesce(score, 0) < 0.5 then 'none' when score < 1 and score - coalesce(nxt, 0) < 0.06 then 'ambiguous' else 'mapped' end as verdict from own left join (select * from rk where rn = 1) using (p_partkey)""")
def phrase_mapping(spark, sf_dir):
    vocabulary = spark.createDataFrame(VOCAB, "class_name string, phrase string")
    return r6(labels.map_phrases(table(spark, sf_dir, "part"), "p_partkey", "p_name", vocabulary))


# --- statistics


@query(f"""with x as (select o_orderpriority, o_orderstatus, o_totalprice from orders), c as (select a.o_orderpriority, sum(case when a.o_totalprice > b.o_totalprice then 1 when a.o_totalprice < b.o_totalprice then -1 else 0 end) as sc from x a join x b on a.o_orderpriority = b.o_orderpriority and a.o_orderstatus = 'F' and b.o_orderstatus = 'P' group by 1),
n as (select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_a, count(*) filter (o_orderstatus = 'P') as n_b from x group by 1) select o_orderpriority, n_a, n_b, {R('sc / (n_a * n_b)')} as cliffs_delta from c join n using (o_orderpriority)""")
def cliffs_delta(spark, sf_dir):
    return r6(stats.cliffs_delta(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "P", "o_totalprice"))


@query(f"""with m as (select p_brand, avg(l_extendedprice) filter (l_returnflag = 'A') as a, avg(l_extendedprice) filter (l_returnflag = 'R') as b from lineitem join part on l_partkey = p_partkey group by 1) select count(*) as n_pairs, {R('median(a - b)')} as median_difference from m where a is not null and b is not null""")
def paired_median_difference(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    m = joined.groupBy("p_brand").agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("b"))
    return r6(m.where("a is not null and b is not null").agg(F.count("*").alias("n_pairs"), F.percentile(F.col("a") - F.col("b"), 0.5).alias("median_difference")))


@query(f"""with p as (select p_brand as family, p_partkey, case when p_partkey % 13 = 0 then null else (p_partkey * 7919 % 1000) / 1000.0 end as p from part), k as (select *, row_number() over (partition by family, p is not null order by p) as rk, count(p) over (partition by family) as m from p),
a as (select *, case when p is not null then least(1.0, min(p * m / rk) over (partition by family, p is not null order by rk rows between current row and unbounded following)) end as adj from k) select family, p_partkey, {R('adj')} as p_adjusted, coalesce(adj <= 0.05, false) as significant from a""")
def benjamini_hochberg(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), "p_partkey", F.when(key % 13 != 0, (key * 7919 % 1000) / 1000.0).alias("p"))
    return r6(stats.benjamini_hochberg(p, ["family"], "p").select("family", "p_partkey", "p_adjusted", "significant"))


R3 = lambda x: f"round({x}, 3) + 0.0"


@query(f"""with s as (select o_orderpriority, strftime(o_orderdate, '%Y-%m') as b, sum(o_totalprice) as s, count(o_totalprice) as c from orders where o_totalprice is not null group by all), t as (select *, row_number() over (partition by o_orderpriority order by b) - 1 as slot, count(*) over (partition by o_orderpriority) as k from s),
d as (select o_orderpriority, rep, {DRAW(1, 'rep', 'slot')} % k as slot from t, range(200) r(rep)), m as (select o_orderpriority, rep, sum(s) / sum(c) as m from d join t using (o_orderpriority, slot) group by all), q as (select o_orderpriority, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1)
select o_orderpriority, {R3('sum(s) / sum(c)')} as estimate, count(*) as n_blocks, case when count(*) >= 3 then {R3('any_value(lo)')} end as ci_low, case when count(*) >= 3 then {R3('any_value(hi)')} end as ci_high from t join q using (o_orderpriority) group by 1""")
def block_bootstrap(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").withColumn("block", F.date_format("o_orderdate", "yyyy-MM"))
    return r6(stats.block_bootstrap(lines, ["o_orderpriority"], "o_totalprice", "block"), 3)


@query(f"""with x as (select o_orderpriority, o_orderstatus as g, strftime(o_orderdate, '%Y-%m') as b, o_totalprice as v from orders), {permutation_sql('x', ['o_orderpriority'], 'F', 'P', 200)} select o_orderpriority, {R3('difference')} as difference, {R3('p')} as p from tested""")
def block_permutation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("block", F.date_format("o_orderdate", "yyyy-MM"))
    return r6(stats.block_permutation(orders, ["o_orderpriority"], "o_orderstatus", "F", "P", "o_totalprice", "block"), 3)


# --- selection


@query(f"with x as (select c_nationkey, c_custkey, {R('c_acctbal')} as c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey)::int as rank from customer) select * from x where rank <= 5")
def top_per_group(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return r6(select.top_k(customers, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5))


@query(f"""with recursive {S}, g as (select distinct recording_id, 0 as step, []::bigint[] as taken, []::bigint[] as ids from s union all
  select recording_id, step + 1, list_append(taken, t), list_append(ids, sample_index) from (select g.*, s.t, s.sample_index, row_number() over (partition by g.recording_id order by s.value desc, s.sample_index) as rn
    from g join s on s.recording_id = g.recording_id where step < 5 and len(list_filter(taken, lambda x: abs(x - s.t) < {48 * HOUR})) = 0) where rn = 1),
l as (select recording_id, max(step) as step from g group by 1) select s.recording_id, s.sample_index, s.t, {R('s.value')} as value from (select recording_id, unnest(ids) as sample_index from g join l using (recording_id, step)) join s using (recording_id, sample_index)""")
def spaced_top(spark, sf_dir):
    df = samples(spark, sf_dir).select("recording_id", "sample_index", "t", "value")
    return r6(select.spaced_top_k(df, K, "value", "t", 48 * HOUR, 5, "sample_index"))


@query("""with recursive p as (select lang, doc_id, n_chars::double as priority, list_filter(['source:' || source, 'quality:' || quality, case when n_chars > 5000 then 'long' end], lambda x: x is not null) as strata from documents join labels using (doc_id)),
g as (select distinct lang, 0 as step, []::varchar[] as covered, []::bigint[] as ids from p union all
  select lang, step + 1, list_concat(covered, strata), list_append(ids, doc_id) from (select g.*, p.doc_id, p.strata, row_number() over (partition by g.lang order by len(list_filter(p.strata, lambda x: not list_contains(covered, x))) desc, priority desc, p.doc_id) as rn, len(list_filter(p.strata, lambda x: not list_contains(covered, x))) as new
    from g join p on p.lang is not distinct from g.lang where step < 30) where rn = 1 and new > 0),
l as (select lang, max(step) as step from g group by 1) select k.lang, doc_id, priority, strata from (select g.lang, unnest(ids) as doc_id from g join l on g.lang is not distinct from l.lang and g.step = l.step) k join p using (doc_id)""")
def greedy_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    strata = F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.when(F.col("n_chars") > 5000, F.lit("long"))))
    pool = docs.select("lang", "doc_id", F.col("n_chars").cast("double").alias("priority"), strata.alias("strata"))
    return r6(select.coverage(pool, ["lang"], "strata", "priority", "doc_id", 30))


@query("with x as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as rn from documents) select lang, count(*) filter (rn <= 120) as n_taken, 120 - count(*) filter (rn <= 120) as shortfall from x group by lang")
def quota_shortfall(spark, sf_dir):
    return select.quota(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 120)


@query(f"with {S}, x as (select recording_id, sample_index, row_number() over (partition by recording_id order by sample_index) - 1 as rn from s) select recording_id, sample_index from x where rn % 10 = 0 and rn < 50")
def every_nth(spark, sf_dir):
    return select.every_nth(samples(spark, sf_dir).select("recording_id", "sample_index"), K, 10, "sample_index", 5)


@query(f"with {S} select recording_id, sample_index, ((row_number() over (partition by recording_id order by sample_index) - 1) % 4)::int as shard from s")
def round_robin_shards(spark, sf_dir):
    return select.shards(samples(spark, sf_dir).select("recording_id", "sample_index"), K, "sample_index", 4)


@query(f"""with m as (select min(p_size) as a, max(p_size) as b, min(p_retailprice) as c, max(p_retailprice) as d from part) select p_partkey, {R('0.7 * coalesce((p_size - a) / nullif(b - a, 0), 0) + 0.3 * coalesce((p_retailprice - c) / nullif(d - c, 0), 0)')} as score from part, m""")
def weighted_score(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    # Least and largest come from one aggregate: a window without keys would put all rows in one task.
    bounds = part.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.min("p_retailprice").alias("c"), F.max("p_retailprice").alias("d"))
    scaled = lambda x, lo, hi: F.coalesce(fn.ratio(F.col(x) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
    return r6(part.join(F.broadcast(bounds), how="cross").select("p_partkey", (0.7 * scaled("p_size", "a", "b") + 0.3 * scaled("p_retailprice", "c", "d")).alias("score")))


@query(f"""with x as (select doc_id, source, {DRAW(0, 'source')} % 1000000 / 1000000 as place from documents) select doc_id, source, case when place < 0.8 then 'train' when place < 0.9 then 'val' else 'test' end as part from x""")
def split_by_group(spark, sf_dir):
    return select.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("with x as (select source, doc_id, row_number() over (partition by source order by doc_id)::int as rank from documents) select source, doc_id, rank from x where rank <= 10")
def balanced_sample(spark, sf_dir):
    return select.balanced(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", F.col("doc_id"), 10)


# --- causal state


@query(f"""with recursive {S}, o as (select *, row_number() over (partition by recording_id order by t, sample_index) as rn from s),
g as (select distinct recording_id, 0::bigint as rn, null::bigint as t, null::bigint as sample_index, false as "on", 0 as age, 0 as reset from s union all
  select recording_id, rn, t, sample_index, on1 and age1 <= 3, age1, reset from (select *, case when value >= 100 then true when value < 20 then false else on0 end as on1, case when value >= 100 then 0 when value < 20 then age0 else age0 + 1 end as age1
    from (select *, case when reset > 0 then false else was end as on0, case when reset > 0 then 0 else held end as age0 from (select o.*, g."on" as was, g.age as held, case when g.t is null then 1 when o.t <= g.t then 4 when o.t - g.t > {24 * HOUR} then 5 else 0 end as reset from g join o on o.recording_id = g.recording_id and o.rn = g.rn + 1))))
select recording_id, t, sample_index, "on", age, reset from g where rn > 0""")
def causal_state(spark, sf_dir):
    from ..streaming.machine import state_machine

    return state_machine(samples(spark, sf_dir), 100.0, 20.0, 24 * HOUR, 3)
