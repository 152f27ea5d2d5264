"""Queries on class maps, frames and evidence: part keys stand for places, order keys for frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, frameset
from .base import HOUR, K, S, query, r6, rounded, samples, table

R = lambda x: f"round({x}, 6) + 0.0"
W = "window w as (partition by recording_id order by t, sample_index)"

PX = "px as (select p_size % 2 as g, (p_partkey % 97)::double as px, (p_partkey % 89)::double as py, p_brand as label, 0.5 + p_size / 100.0 as confidence from part), gz as (select c_custkey % 2 as g, c_custkey as sample_index, (c_custkey % 101)::double as u, (c_custkey % 83)::double as v from customer)"


@query(f"""with {PX}, m as (select gz.g, sample_index, label, sum(exp(-(pow(u - px, 2) + pow(v - py, 2)) / 50.0) * confidence) as m from gz join px on gz.g = px.g and pow(u - px, 2) + pow(v - py, 2) <= 144 group by all),
p as (select *, m / sum(m) over (partition by g, sample_index) as p from m), r as (select *, row_number() over (partition by g, sample_index order by p desc, label) as rk from p),
t as (select g, sample_index, max(label) filter (rk = 1) as top1, max(p) filter (rk = 1) as p1, coalesce(max(p) filter (rk = 2), 0) as p2, -sum(case when p > 0 then p * ln(p) else 0 end) / ln(25) as entropy from r group by all)
select gz.g, sample_index, top1, {R('p1')} as p1, {R('p1 - p2')} as margin, {R('entropy')} as entropy from gz left join t using (g, sample_index)""")
def foveal_sampling(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    pixels = part.select((F.col("p_size") % 2).cast("long").alias("g"), (F.col("p_partkey") % 97).cast("double").alias("px"), (F.col("p_partkey") % 89).cast("double").alias("py"), F.col("p_brand").alias("label"), (0.5 + F.col("p_size") / 100.0).alias("confidence"))
    gaze = customer.select((F.col("c_custkey") % 2).alias("g"), F.col("c_custkey").alias("sample_index"), (F.col("c_custkey") % 101).cast("double").alias("u"), (F.col("c_custkey") % 83).cast("double").alias("v"))
    return r6(frameset.foveal(gaze, pixels, ["g"], 5.0, 12.0, 25).select("g", "sample_index", "top1", "p1", "margin", "entropy"))


@query(f"select l_shipdate::date::varchar as day, l_returnflag as label, count(*) as n, {R('count(*) / sum(count(*)) over (partition by l_shipdate::date)')} as share from lineitem group by l_shipdate::date, l_returnflag")
def class_histogram(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_returnflag").alias("label"))
    return r6(frameset.histogram(lines, ["day"]))


@query(f"with a as (select l_linenumber, l_returnflag, lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_returnflag) as b from lineitem) select l_linenumber, count(*) as n, {R('avg((l_returnflag <> b)::int)')} as flicker from a where b is not null group by 1")
def pixel_flicker(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return r6(frameset.pixel_flicker(lines, ["l_orderkey"], "l_linenumber", "l_returnflag"))


@query("select c_custkey, case when c_custkey % 11 = 0 then 'mirror' when c_acctbal > 0 then c_mktsegment when c_custkey % 3 = 0 then 'cockpit' when c_custkey % 2 = 0 then 'glass' else 'none' end as target from customer")
def layered_target(spark, sf_dir):
    k = F.col("c_custkey")
    target = frameset.layered(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.when(k % 3 == 0, F.lit("cockpit")), F.when(k % 2 == 0, F.lit("glass")), F.when(k % 11 == 0, F.lit("mirror")))
    return table(spark, sf_dir, "customer").select("c_custkey", target.alias("target"))


@query(f"""with a as (select l_orderkey, l_shipmode, l_tax - 0.25 * l_discount + l_quantity / 1000 as score from (select l_orderkey, l_linenumber::varchar as l_shipmode, l_tax, l_discount, l_quantity from lineitem)),
b as (select *, row_number() over w as rk, score - lead(score) over w as lead_by from a window w as (partition by l_orderkey order by score desc, l_shipmode)) select l_orderkey, l_shipmode as label, {R('score')} as score, {R('lead_by')} as lead_by from b where rk = 1""")
def evidence_fusion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("label"), "l_tax", "l_discount", "l_quantity")
    return r6(frameset.fused(lines, ["l_orderkey"], "label", "l_tax", "l_discount", "l_quantity"))


BANDS = """cl as (select p_brand as g, p_partkey % 200 as c, max(p_size) as s from part group by all), on_ as (select *, coalesce((c - lag(c) over w > 1)::int, 1) as nw from cl where s > 20 window w as (partition by g order by c)),
bd as (select *, sum(nw) over (partition by g order by c) as band from on_), bb as (select g, band::bigint as band, min(c) as first, max(c) as last, (min(c) + max(c)) / 2 as centre, max(c) - min(c) + 1 as width from bd group by g, band having max(c) - min(c) + 1 >= 2)"""


def _bands(spark, sf_dir):
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("g"), (F.col("p_partkey") % 200).alias("c")).agg(F.max("p_size").alias("s"))
    return frameset.lane_bands(cells, ["g"], "c", F.col("s") > 20, 2)


@query(f"with {BANDS} select g, band, first, last, {R('centre')} as centre, width from bb")
def lane_bands(spark, sf_dir):
    return r6(_bands(spark, sf_dir))


@query(f"""with {BANDS}, p as (select g, centre as l, lead(centre) over (partition by g order by centre) as r from bb), q as (select *, row_number() over (partition by g order by abs((l + r) / 2 - 100), l, r) as rk from p where r is not null)
select g, {R('l')} as left, {R('r')} as right, {R('(100 - (l + r) / 2) / nullif((r - l) / 2, 0)')} as offset from q where rk = 1""")
def lane_offset(spark, sf_dir):
    return r6(frameset.lane_offset(_bands(spark, sf_dir), ["g"], 100.0))


FAIL = f"""fq as (select l_returnflag, quantile_cont(l_quantity, 0.1) as b, quantile_cont(l_tax, 0.08) as d, quantile_cont(l_tax, 0.92) as g, quantile_cont(l_extendedprice, 0.9) as c from lineitem group by all),
fl as (select l.*, nullif(concat_ws('; ', case when l_quantity < b then 'blurred' end, case when l_tax < d then 'dark' end, case when l_tax > g then 'glare' end, case when l_extendedprice > c then 'sudden change' end), '') as modes, least(1, greatest(0, (l_extendedprice - c) / c)) as severity from lineitem l join fq using (l_returnflag))"""


def _failures(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    return frameset.failures(lines, ["l_returnflag"], "l_quantity", "l_tax", "l_extendedprice")


@query(f"with {FAIL} select l_returnflag, l_orderkey, l_linenumber, modes, {R('severity')} as severity from fl where modes is not null")
def frame_failures(spark, sf_dir):
    return r6(_failures(spark, sf_dir).select("l_returnflag", "l_orderkey", "l_linenumber", "modes", "severity"))


#: Fractions and components of seven classes by the frame's number.
LABELS = ["road_surface", "mirror", "instrument_display", "control_and_ego_vehicle", "vehicle", "two_wheeler", "pedestrian"]
NAMED = " union all ".join(f"select {i} as j, '{name}' as label" for i, name in enumerate(LABELS))


@query(f"""with {S}, fr as (select recording_id, sample_index as frame, t, value / 100 as entropy, 1 - value % 50 / 50 as confidence, value % 13 / 13 as fallback, value % 7 / 7 as conflict, value % 3 / 30 as geometric, value % 9 / 9 as dense_fill, value % 17 as blur, value % 19 as change, sample_index % 3 = 0 as visible, sample_index % 5 > 0 as mask from s),
cl as (select recording_id, frame, label, case when frame * (j + 3) % 11 < 3 then 0 else frame * (j + 7) % 100 / 100 end as fraction, frame * (j + 5) % 30 as parts from fr cross join ({NAMED})),
fd as (select *, t - lag(t) over (partition by recording_id order by frame) as dt from fr), lim as (select recording_id, (case when median(dt) > 0 then greatest(1, round_even(259200 * (1e9 / median(dt)), 0)) else 5 end)::bigint as k, quantile_cont(entropy, 0.9) as qe, quantile_cont(confidence, 0.1) as qc, quantile_cont(fallback, 0.9) as qf, quantile_cont(blur, 0.15) as qb, quantile_cont(change, 0.9) as qm from fd group by 1),
sh as (select recording_id, frame, sum(fraction) filter (label = 'road_surface') as road, sum(fraction) filter (label in ('mirror', 'instrument_display', 'control_and_ego_vehicle')) as cockpit, sum(fraction) filter (label = 'mirror') as mirror, sum(fraction) filter (label = 'instrument_display') as display from cl group by all),
a as (select *, row_number() over w as n, mask and not visible as wrong from fr join sh using (recording_id, frame) join lim using (recording_id) window w as (partition by recording_id order by frame)), b as (select *, n - coalesce(max(case when not wrong then n end) over (partition by recording_id order by frame), 0) as held from a),
lp as (select recording_id, label, quantile_cont(parts, 0.92) as qp from cl group by all), c as (select cl.*, k, qp, row_number() over w as n, lag(fraction) over w as was, lead(fraction) over w as will from cl join lim using (recording_id) join lp using (recording_id, label) window w as (partition by recording_id, label order by frame)),
tr as (select x.recording_id, x.label, x.frame from c x join c y on x.recording_id = y.recording_id and x.label = y.label and y.n between x.n - x.k and x.n where x.n > x.k and x.label in ('vehicle', 'two_wheeler', 'pedestrian') group by all having max(y.fraction) filter (y.n = x.n - x.k) > 0.01 and min(y.fraction) filter (y.n > x.n - x.k) > 0 and max(y.fraction) filter (y.n > x.n - x.k) < 0.4 * max(y.fraction) filter (y.n = x.n - x.k)),
e as (select recording_id, frame, 'missing_external_segmentation' as mode, null as label, dense_fill as s from b where road < 0.02 and dense_fill > 0.15 union all select recording_id, frame, 'high_entropy', null, (entropy - qe) / greatest(qe, 1e-6) from b where entropy > qe union all select recording_id, frame, 'anomalous_confidence', null, (qc - confidence) / greatest(qc, 1e-6) from b where confidence < qc
union all select recording_id, frame, 'excessive_fallback', null, fallback from b where fallback > qf and fallback > 0.05 union all select recording_id, frame, 'internal_external_fusion_error', null, conflict from b where conflict > 0.5 union all select recording_id, frame, 'cockpit_absorbed_by_external', null, 1 - cockpit * 100 from b where cockpit < 0.005 and geometric < 0.01
union all select recording_id, frame, 'mirror_not_detected', null, 0.5 from b where mirror <= 0 union all select recording_id, frame, 'instrument_display_not_detected', null, 0.5 from b where display <= 0 union all select recording_id, frame, 'blur_related_failure', null, 0.6 from b where blur < qb and (entropy > qe or confidence < qc)
union all select recording_id, frame, 'vibration_related_failure', null, 0.6 from b where change > qm and entropy > qe union all select recording_id, frame, 'visible_hand_not_proposed', null, 0.6 from b where visible and not mask union all select recording_id, frame, 'false_hand', null, 0.7 from b where wrong union all select recording_id, frame, 'hand_mask_propagated_after_disappearance', null, 0.8 from b where wrong and held >= k
union all select recording_id, frame, 'fragmentation', label, parts / 40 from c where parts >= 8 and parts > qp union all select recording_id, frame, 'flicker', label, 0.5 from c where was > 0.002 and will > 0.002 and fraction <= 0 union all select recording_id, frame, 'temporal_trail', label, 0.5 from tr)
select recording_id, frame, mode, label, {R('least(1, greatest(0, s::double))')} as severity from e""")
def failure_modes(spark, sf_dir):
    i, v = F.col("sample_index"), F.col("value")
    frames = samples(spark, sf_dir).select(
        "recording_id", i.alias("frame"), "t", (v / 100).alias("entropy"), (1 - v % 50 / 50).alias("confidence"), (v % 13 / 13).alias("fallback"), (v % 7 / 7).alias("conflict"), (v % 3 / 30).alias("geometric"),
        (v % 9 / 9).alias("dense_fill"), (v % 17).alias("blur"), (v % 19).alias("change"), (i % 3 == 0).alias("hand_visible"), (i % 5 > 0).alias("hand_mask"))
    f, j = F.col("frame"), F.col("j")
    labels = F.explode(F.array(*[F.struct(F.lit(k).alias("j"), F.lit(name).alias("label")) for k, name in enumerate(LABELS)]))
    rows = frames.select("recording_id", "frame", labels.alias("l")).select("recording_id", "frame", "l.*")
    classes = rows.select("recording_id", "frame", "label", F.when(f * (j + 3) % 11 < 3, 0.0).otherwise(f * (j + 7) % 100 / 100).alias("fraction"), (f * (j + 5) % 30).alias("components"))
    return r6(frameset.failure_modes(frames, classes, ["recording_id"], 259_200.0))


@query(f"""with {FAIL}, f as (select distinct l_returnflag, l_orderkey from fl where modes is not null), n as (select *, coalesce((l_orderkey - lag(l_orderkey) over w > 1)::int, 1) as nw from f window w as (partition by l_returnflag order by l_orderkey)),
r as (select *, sum(nw) over (partition by l_returnflag order by l_orderkey) as run from n), g as (select l_returnflag, run, min(l_orderkey) as first, max(l_orderkey) as last, count(*) as n from r group by all), k as (select *, row_number() over (partition by l_returnflag order by n desc, first)::int as rank from g)
select l_returnflag, first, last, n, rank from k where rank <= 5""")
def worst_frame_runs(spark, sf_dir):
    return frameset.worst_runs(_failures(spark, sf_dir).select("l_returnflag", "l_orderkey").distinct(), ["l_returnflag"], "l_orderkey", 5)


@query(f"select lang, count(*) as n, {R('sum(case when quality = 1 - toxic then exp(-n_chars / 5000.0) else 0 end) / sum(exp(-n_chars / 5000.0))')} as accuracy from documents join labels using (doc_id) where quality is not null and toxic is not null group by lang")
def weighted_accuracy(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("said", 1 - F.col("toxic"))
    return r6(frameset.weighted_accuracy(df, ["lang"], "quality", "said", F.exp(-F.col("n_chars") / 5000.0)))


@query(f"""with a as (select o_orderkey, (case when o_orderstatus = 'F' then 0.5::double else 0 end) + (case when o_totalprice > 150000 then 0.3 else 0 end) + (case when o_orderpriority like '1%' then 0.4 else 0 end) - (case when o_totalprice < 20000 then 0.5 else 0 end) as s, * exclude (o_orderkey) from orders)
select o_orderkey, case when s >= 0.6 then 'yes' when s <= 0 then 'no' else 'unclear' end as state, {R('least(1, abs(s))')} as confidence, nullif(concat_ws('; ', case when o_orderstatus = 'F' then 'finished' end, case when o_totalprice > 150000 then 'large' end, case when o_orderpriority like '1%' then 'urgent' end, case when o_totalprice < 20000 then 'small' end), '') as reasons from a""")
def evidence_decision(spark, sf_dir):
    price = F.col("o_totalprice")
    votes = {"finished": (F.col("o_orderstatus") == "F", 0.5), "large": (price > 150_000, 0.3), "urgent": (F.col("o_orderpriority").startswith("1"), 0.4), "small": (price < 20_000, -0.5)}
    state, confidence, reasons = frameset.evidence_state(votes, 0.6, 0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), rounded(confidence).alias("confidence"), reasons.alias("reasons"))


@query(f"""with {S}, a as (select *, row_number() over w - 1 as rn from s {W}), b as (select *, last_value(case when rn % 4 = 0 then stream end ignore nulls) over w as kept from a {W}) select recording_id, count(*) as n, {R('count(*) filter (stream = kept) / count(*)')} as agreement from b group by recording_id""")
def reuse_agreement(spark, sf_dir):
    return r6(frameset.reuse_agreement(samples(spark, sf_dir), K, "stream", 4, "sample_index"))


@query(f"""with {S}, f as (select *, value < 40 as o, lag(value < 40) over w as po from s {W}), i as (select *, sum(case when o is distinct from po then 1 else 0 end) over w as run from f {W}) select recording_id, min(t) as start, max(t) as "end", count(*) as n from i where o group by recording_id, run having (max(t) - min(t)) / 1e9 >= 86400""")
def stop_events(spark, sf_dir):
    return frameset.stops(samples(spark, sf_dir), K, "value", 40.0, 86_400.0)


@query(f"""with {S}, fr as (select unnest([12, 24, 48]) as step_h), p as (select recording_id, step_h, unnest(range(min(t), max(t) + 1, step_h * {HOUR})) as g from s cross join fr group by recording_id, step_h),
j as (select p.*, abs(s.t - g) as d, sample_index, row_number() over (partition by p.recording_id, step_h, g order by abs(s.t - g), s.t, sample_index) as rn from p join s using (recording_id))
select step_h, count(*) as n_points, count(*) filter (d <= {6 * HOUR}) as n_covered, count(distinct sample_index) filter (d <= {6 * HOUR}) as n_frames, {R('count(*) filter (d <= ' + str(6 * HOUR) + ') / count(*)')} as coverage from j where rn = 1 group by step_h""")
def frequency_ablation(spark, sf_dir):
    out = None
    df = samples(spark, sf_dir)
    for step in (12, 24, 48):
        points = asof.grid(df, K, step * HOUR, 1 << 62)
        near = F.abs("dt_ns") <= 6 * HOUR
        one = points.agg(F.count("*").alias("n_points"), F.count_if(near).alias("n_covered"), F.count_distinct(F.when(near, F.col("sample_index"))).alias("n_frames")).withColumn("step_h", F.lit(step))
        out = one if out is None else out.unionByName(one)
    return r6(out.withColumn("coverage", F.col("n_covered") / F.col("n_points")))
