"""Rules that the driver's tables don't exercise, on small tables made here."""

import hashlib
import itertools
import math
import threading
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns as fn
from strandline.operators import asof, events, frames, frameset, interval, islands, labels, mapmatch, quality, select, spatial, stats
from strandline.plans.queries import ORACLE_SQL, QUERIES
from strandline.sources import tables
from strandline.streaming import machine

SEC = 1_000_000_000
K = ["recording_id"]


def series(spark, times, values=None, key=1):
    rows = [(key, i, int(round(t * SEC)), None if values is None or values[i] is None else float(values[i])) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "recording_id long, sample_index long, t long, value double")


@pytest.mark.parametrize("fps", [7.5, 10, 15, 20, 30])
def test_regular_rate(spark, fps):
    r = quality.rates(series(spark, [i / fps for i in range(int(20 * fps))]), K).first()
    assert math.isclose(r.median_rate_hz, fps, rel_tol=1e-6) and math.isclose(r.span_rate_hz, fps, rel_tol=1e-6) and r.n_not_increasing == 0


def test_pause_lowers_the_span_rate_only(spark):
    times = [i / 15 + (3 if i > 75 else 0) for i in range(150)]
    r = quality.rates(series(spark, times), K).first()
    assert round(r.median_rate_hz, 3) == 15 and r.span_rate_hz < 14


def test_disorder_is_counted_in_storage_order(spark):
    df = series(spark, [0, 100, 100, 300, 200, 400])
    r = quality.rates(df, K).first()
    assert (r.n_duplicate, r.n_not_increasing) == (1, 2)
    assert quality.reordered(df, K).first().n_reordered == 2


def test_one_lost_frame_is_one_gap(spark):
    gaps = quality.gaps(series(spark, [i / 15 for i in range(60) if i != 30]), K, 250_000_000).collect()
    assert len(gaps) == 1 and round(gaps[0].periods, 3) == 2 and gaps[0].missing == 1 and not gaps[0].over_absolute


def test_slow_streams_have_no_absolute_rule(spark):
    assert quality.gaps(series(spark, range(60)), K, 250_000_000).count() == 0
    gaps = quality.gaps(series(spark, [0, 1, 2, 4]), K, 250_000_000).collect()
    assert len(gaps) == 1 and not gaps[0].over_absolute


def test_two_segments(spark):
    times = [i / 15 for i in range(60)] + [6 + i / 15 for i in range(60)]
    found = quality.segments(series(spark, times), K, 250_000_000).orderBy("segment").collect()
    assert [s.n for s in found] == [60, 60]


def test_degenerate_streams(spark):
    assert quality.rates(series(spark, []), K).count() == 0
    one = quality.rates(series(spark, [5]), K).first()
    assert one.n == 1 and one.span_rate_hz is None and one.median_rate_hz is None


def brute_nearest(times, t):
    if not times:
        return None
    left = next((i for i, x in enumerate(times) if x >= t), len(times))
    if left == 0:
        return 0
    if left == len(times):
        return left - 1
    return left - 1 if t - times[left - 1] <= times[left] - t else left


def test_nearest_ties_and_duplicates(spark):
    target = [0, 1, 1, 3, 3, 5, 9, 9]
    reference = [0, 0.5, 1, 2, 3, 4, 6, 7, 8, 9, 12, -1]
    right = series(spark, target).withColumn("i", F.col("sample_index"))
    found = asof.nearest(series(spark, reference), right, K, values=["i"]).orderBy("sample_index").collect()
    for row, t in zip(found, reference):
        assert row.i == brute_nearest(target, t), (t, row.i)
    alone = asof.nearest(series(spark, [1], key=2), right, K, values=["i"]).first()
    assert alone.i is None and alone.dt_ns is None
    flagged = asof.flagged(asof.nearest(series(spark, [20.0]), right, K), SEC).first()
    assert flagged.target_t == 9 * SEC and not flagged.valid and flagged.quality == 0


def test_interpolation_reasons(spark):
    target = series(spark, [0, 2, 10], [0.0, 4.0, 8.0])
    found = asof.interpolated(series(spark, [0, 1, 3, 6, 30]).drop("value"), target, K, "value", 2 * SEC)
    rows = found.orderBy("sample_index").collect()
    assert [r.reason for r in rows] == ["exact", "bracketed", "nearest", "too far", "too far"]
    assert [r.value for r in rows] == [0.0, 2.0, 4.0, None, None]


def test_intervals_hold_their_ends_or_not(spark):
    points = series(spark, [0, 1, 2, 3])
    spans = spark.createDataFrame([(1, 1 * SEC, 2 * SEC), (1, 3 * SEC, 2 * SEC)], "recording_id long, start long, end long")
    assert interval.within(points, spans, K, SEC).count() == 2
    assert interval.within(points, spans, K, SEC, closed=False).count() == 1


def test_missing_values_are_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r.x for r in fn.with_finite(df).collect()] == [None, None, 1.0, None]
    assert spark.range(1).select(fn.clip(F.lit(None).cast("double"), 0, 1).alias("c")).first().c is None
    assert [r.n for r in spark.createDataFrame([(2.5,), (3.5,)], "s double").select(fn.seconds_to_samples(F.col("s"), F.lit(1.0)).alias("n")).collect()] == [2, 4]


def test_text_rules(spark):
    speeds = spark.createDataFrame([("50",), ("30 mph",), ("walk",), (None,)], "v string").select(fn.max_speed_kph(F.col("v")).alias("k")).collect()
    assert [None if r.k is None else round(r.k, 3) for r in speeds] == [50.0, 48.28, None, None]
    with pytest.raises(ValueError):
        fn.assert_public(spark.range(1).withColumn("GPS_Latitude", F.lit(1)))


def brute_fixations(times, slow, gap):
    groups, last = [], None
    for i, (t, s) in enumerate(zip(times, slow)):
        if not s:
            continue
        if last is None or (not slow[i - 1] and times[i - 1] - times[last] > gap):
            groups.append([])
        groups[-1].append(i)
        last = i
    return [(times[g[0]], times[g[-1]]) for g in groups if len(g) >= 2]


def test_fixations_bridge_short_excursions(spark):
    import random

    draw = random.Random(4)
    for key in range(3):
        times = sorted(draw.sample(range(200), 60))
        slow = [draw.random() < 0.6 for _ in times]
        df = series(spark, times, slow)
        found = islands.fixations(df, K, F.col("value") > 0, 6 * SEC, 0).orderBy("start").collect()
        assert [(r.start // SEC, r.end // SEC) for r in found] == brute_fixations(times, slow, 6)
        assert [r.fixation_id for r in found] == list(range(len(found)))


def test_event_windows_are_clipped_to_the_recording(spark):
    ev = spark.createDataFrame([(1, "e", "curve", 5 * SEC, 9 * SEC)], "recording_id long, event_name string, kind string, start long, end long")
    spec = spark.createDataFrame([("base", -30.0, -10.0), ("immediate", 0.0, 10.0)], "name string, from_s double, to_s double")
    spans = spark.createDataFrame([(1, 0, 60 * SEC)], "recording_id long, start0 long, end0 long")
    found = {r.window: r for r in events.windows(ev, spec, spans, K, "event_name").collect()}
    assert found["base"].clipped and found["base"].start == 0
    assert (found["immediate"].start, found["immediate"].end, found["immediate"].clipped) == (9 * SEC, 19 * SEC, False)


def test_gradient_equals_the_formula_for_uneven_steps(spark):
    import numpy as np

    t, v = [0, 1, 3, 4, 8], [1.0, 4.0, 2.0, 7.0, 7.5]
    found = [r.g for r in frames.gradient(series(spark, t, v), K, "value", "g").orderBy("t").collect()]
    assert np.allclose(found, np.gradient(v, t))


def test_boxes_are_suppressed_greedily(spark):
    boxes = [(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 2, 0.7, 20.0, 20.0, 30.0, 30.0), (1, 3, 0.9, 40.0, 0.0, 50.0, 10.0), (1, 4, 0.9, 40.0, 0.0, 50.0, 10.0)]
    df = spark.createDataFrame(boxes, "g long, box_id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in labels.nms(df, ["g"], 0.5).collect()) == [0, 2, 3]


def test_phrases(spark):
    vocab = spark.createDataFrame([("car", "motor car"), ("car", "automobile"), ("bike", "motor bike"), ("sky", "blue sky")], "class_name string, phrase string")
    asked = spark.createDataFrame([(0, "Motor car!"), (1, "motor"), (2, "blue sky above"), (3, "zebra"), (4, None)], "id long, phrase string")
    found = {r.id: r for r in labels.map_phrases(asked, "id", "phrase", vocab, least=0.3).collect()}
    assert (found[0].class_name, found[0].score, found[0].verdict) == ("car", 1.0, "mapped")
    assert found[1].verdict == "ambiguous" and found[1].class_name == "bike"
    assert found[2].class_name == "sky" and found[3].verdict == "none" and found[3].class_name is None and len(found) == 5


def test_viterbi_is_the_best_of_all_sequences(spark):
    rows = [(1, i, i * SEC, float(x), 0.0, w, 0, float(d), float(a)) for i, x in enumerate([0, 10, 20, 30]) for w, d, a in ((1, 5 + 3 * i, x), (2, 6, x + 4 * i))]
    df = spark.createDataFrame(rows, "recording_id long, sample_index long, t long, x double, y double, way_id long, seg int, distance_m double, along_m double")
    found = [r.way_id for r in mapmatch.decode(df, K).orderBy("sample_index").collect()]
    frames_ = [[r for r in rows if r[1] == i] for i in range(4)]

    def score(path):
        s = sum(-0.5 * (p[7] / 8) ** 2 for p in path)
        for a, b in zip(path, path[1:]):
            straight = abs(a[3] - b[3])
            s -= abs((abs(a[8] - b[8]) if a[5] == b[5] else straight + 60) - straight) / 15
        return s

    assert found == [p[5] for p in max(itertools.product(*frames_), key=score)]


def test_viterbi_counts_shared_nodes_and_each_fix_s_accuracy(spark):
    shared = {1: [7], 2: [7, 8], 3: None}
    rows = [(1, i, i * SEC, 10.0 * i, 0.0, w, 0, float(d), 10.0 * i, acc, shared[w]) for i, acc in enumerate((5.0, 30.0, None, 12.0)) for w, d in ((1, 2 + 9 * i), (2, 14 - 4 * i), (3, 15 + i))]
    df = spark.createDataFrame(rows, "recording_id long, sample_index long, t long, x double, y double, way_id long, seg int, distance_m double, along_m double, accuracy_m double, shared array<long>")
    found = [r.way_id for r in mapmatch.decode(df, K, accuracy="accuracy_m").orderBy("sample_index").collect()]

    def score(path):
        s = sum(-0.5 * (p[7] / max(8, p[9] or 8)) ** 2 for p in path)
        for a, b in zip(path, path[1:]):
            extra = 5 if set(a[10] or ()) & set(b[10] or ()) else 60
            s -= abs((abs(a[8] - b[8]) if a[5] == b[5] else 10 + extra) - 10) / 15
        return s

    best = max(itertools.product(*[[r for r in rows if r[1] == i] for i in range(4)]), key=score)
    assert found == [p[5] for p in best] and len(set(found)) > 1


def test_match_gates_and_follows_the_road(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 100.0, 100.0), (3, 0.0, 40.0), (4, 100.0, 40.0)], "node_id long, x double, y double")
    ways = spark.createDataFrame([(10, [0, 1], True, "main"), (11, [1, 2], False, "side"), (12, [3, 4], False, "other")], "way_id long, nodes array<long>, oneway boolean, road_class string")
    there = [(10.0 * i, 3.0) for i in range(10)] + [(103.0, 10.0 + 10 * i) for i in range(5)] + [(500.0, 500.0)]
    back = [(x, y) for x, y in there[9::-1]]
    rows = [(k, i, i * SEC, x, y, 10.0, None if i % 2 else 6.0) for k, path in ((1, there), (2, back)) for i, (x, y) in enumerate(path)]
    # A poor fix looks farther, but what is beyond the radius isn't matched; a track without any road stays.
    rows += [(3, 0, 0, 50.0, -45.0, 10.0, 30.0), (4, 0, 0, -900.0, 0.0, None, None), (5, 0, 0, None, None, None, None)]
    fixes = spark.createDataFrame(rows, "recording_id long, sample_index long, t long, x double, y double, speed_mps double, accuracy_m double")
    found = {(r.recording_id, r.sample_index): r for r in mapmatch.match(fixes, ways, nodes, K).collect()}
    assert len(found) == len(rows)
    assert [found[1, i].way_id for i in range(15)] == [10] * 10 + [11] * 5 and found[1, 14].road_class == "side" and found[1, 0].curvature is None
    assert found[1, 15].reason == "no road near" and found[1, 15].way_id is None and found[1, 15].match_quality == 0
    assert math.isclose(found[1, 9].route_progress_m, 90) and math.isclose(found[1, 10].route_progress_m, 95 + math.hypot(10, 10)) and found[1, 15].route_progress_m is None
    assert not any(found[1, i].against_oneway for i in range(15)) and all(found[2, i].against_oneway for i in range(10)) and "against one way" in found[2, 0].warnings
    assert (found[3, 0].reason, found[4, 0].reason, found[5, 0].reason) == ("too far from the road", "no road near", "no road near")
    across = spark.createDataFrame([(1, i, i * SEC, 50.0, 5.0 * i, speed, 5.0) for i, speed in enumerate((10.0, 1.0))], fixes.schema)
    assert [r.reason for r in mapmatch.match(across, ways.where("way_id = 10"), nodes, K).orderBy("sample_index").collect()] == ["turned from the road", "ok"]
    assert mapmatch.match(fixes.limit(0), ways, nodes, K).isEmpty()


def test_road_events_on_a_short_drive(spark):
    rows = [(1, i, i * SEC, 2.0 * i, 7, c, bool(r), k, v, d) for i, (c, r, k, v, d) in enumerate([("a", 0, 0.0, 5.0, 50.0), ("a", 1, 0.05, 5.0, 20.0), (None, 1, 0.09, 0.1, 8.0), ("b", 1, 0.05, 5.0, 8.0), ("b", 0, None, 0.2, None)])]
    df = spark.createDataFrame(rows, "recording_id long, sample_index long, t long, route_progress_m double, way_id long, road_class string, is_roundabout boolean, curvature double, speed_mps double, distance_to_junction_m double")
    near = [("distance_to_junction_m", "junction_crossing", 30.0)]
    found = {(r.kind, r.start // SEC, r.end // SEC, r.peak // SEC) for r in events.road_events(df, K, near=near).collect()}
    assert found == {
        ("roundabout_traverse", 1, 4, 2), ("roundabout_entry", 1, 2, 1), ("roundabout_exit", 3, 4, 3), ("junction_crossing", 1, 4, 2), ("junction_approach", 1, 2, 1),
        ("curve", 1, 4, 2), ("stop", 2, 3, 2), ("restart", 2, 4, 3), ("stop", 4, 4, 4), ("road_class_change", 2, 4, 3),
    }
    assert events.road_events(df.limit(0), K, near=near).isEmpty()


def test_mean_bootstrap_broadcasts_no_draws(spark, tmp_path):
    """A small file, whose draws are 200 times its rows."""
    spark.range(600).selectExpr("id % 3 as k", "id", "(id * 37 % 101) / 4.0D as v").write.parquet(str(tmp_path / "in"))
    found = stats.mean_bootstrap(spark.read.parquet(str(tmp_path / "in")), ["k"], "v", "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined, sides = plan.count("Join [k"), [line for line in plan.splitlines() if "Join [k" in line and "_slot" in line]
    assert joined == 2 and len(sides) == 1 and "BuildRight" in sides[0] and "Broadcast" not in sides[0]
    for r in found.collect():
        values = [i * 37 % 101 / 4 for i in range(r.k, 600, 3)]
        draw = lambda rep, slot: int(hashlib.md5(f"1|{rep}|{slot}".encode()).hexdigest()[:15], 16) % 200
        means = sorted(sum(values[draw(rep, slot)] for slot in range(1, 201)) / 200 for rep in range(200))
        assert r.n == 200 and math.isclose(r.ci_low, means[4] + (means[5] - means[4]) * 0.975) and math.isclose(r.ci_high, means[194] + (means[195] - means[194]) * 0.025)


def test_geometric_mean_of_zeros_and_negatives(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (1, None), (2, 0.0), (2, 5.0), (3, -1.0), (3, 4.0), (4, None)], "k long, v double")
    found = {r.k: r.m for r in df.groupBy("k").agg(stats.geometric_mean("v").alias("m")).collect()}
    assert math.isclose(found[1], 4.0) and found[2] == 0.0 and found[3] is None and found[4] is None


def test_sequence_bundle_equals_its_sql_where_values_are_zero(spark, tmp_path):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"copy (select i as event_id, timestamp '2024-01-01' + interval (i) minute as ts, i % 2 as user_id, 'view' as event_type, (i % 7)::double / 4 + i % 2 as value from range(20) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    columns = ["recording_id", "autocorrelation", "rmssd", "asymmetry", "geometric_mean"]
    want = sorted(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL['sequence_bundle']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["sequence_bundle"](spark, str(tmp_path)).select(*columns).collect()) == want and want[0][-1] == 0.0


def test_foveal_sampling_counts_places_once(spark):
    """Point by pixel these would be 4e10 pairs."""
    points = spark.range(200_000).selectExpr("0L as g", "id as sample_index", "id % 2 * 100.0D as u", "1.0D as v")
    pixels = spark.range(200_000).selectExpr("0L as g", "1.0D as px", "2.0D as py", "if(id % 4 = 0, 'a', 'b') as label", "0.5D as confidence")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        found = frameset.foveal(points, pixels, ["g"], 5.0, 12.0, 2).groupBy("u", "top1", "top2", F.round("p1", 9).alias("p1"), F.round("margin", 9).alias("margin")).count().collect()
    finally:
        late.cancel()
    assert {tuple(r) for r in found} == {(0.0, "b", "a", 0.75, 0.5, 100_000), (100.0, None, None, None, None, 100_000)}


def test_failure_modes_stand_on_the_run_s_own_limits(spark):
    schema = "k long, frame long, t long, entropy double, confidence double, fallback double, conflict double, geometric double, dense_fill double, blur double, change double, hand_visible boolean, hand_mask boolean"
    rows = [(1, i, i * SEC, 0.9 if i == 7 else 0.1 + i / 100, 0.5, 0.0, 0.6 if i == 3 else 0.0, 0.5, 0.0, 10.0 + i, None, i == 0, 5 <= i < 8) for i in range(10)]
    shares = {"road_surface": [0.5] * 10, "mirror": [0.1] * 4 + [0.0] + [0.1] * 5, "instrument_display": [0.1] * 10, "vehicle": [0.0, 0.0, 0.3, 0.1, 0.05, 0.02, 0.2, 0.2, 0.2, 0.2]}
    classes = [(1, i, name, f[i], 20 if name == "vehicle" and i == 8 else 1) for name, f in shares.items() for i in range(10)]
    frames_ = spark.createDataFrame(rows, schema)
    labels_ = spark.createDataFrame(classes, "k long, frame long, label string, fraction double, components long")
    found = {(r["mode"], r.frame, r.label) for r in frameset.failure_modes(frames_, labels_, ["k"], 3.0).collect()}
    assert found == {
        ("high_entropy", 7, None), ("internal_external_fusion_error", 3, None), ("mirror_not_detected", 4, None), ("visible_hand_not_proposed", 0, None), ("false_hand", 5, None), ("false_hand", 6, None),
        ("false_hand", 7, None), ("hand_mask_propagated_after_disappearance", 7, None), ("fragmentation", 8, "vehicle"), ("flicker", 4, "mirror"), ("temporal_trail", 5, "vehicle"),
    }
    assert frameset.failure_modes(frames_.limit(0), labels_.limit(0), ["k"]).isEmpty()


def test_failure_modes_take_neighbouring_doubles_as_the_sql_does(spark):
    low, high = 0.076923, math.nextafter(0.076923, 1)
    schema = "k long, frame long, t long, entropy double, confidence double, fallback double, conflict double, geometric double, dense_fill double, blur double, change double, hand_visible boolean, hand_mask boolean"
    frames_ = spark.createDataFrame([(1, i, i * SEC, None, None, high if i == 2 else low, None, None, None, None, None, None, None) for i in range(5)], schema)
    labels_ = spark.createDataFrame([(1, i, name, 0.5, 1) for i in range(5) for name in ("mirror", "instrument_display")], "k long, frame long, label string, fraction double, components long")
    found = [(r["mode"], r.frame) for r in frameset.failure_modes(frames_, labels_, ["k"]).collect()]
    limit = duckdb.sql(f"select quantile_cont(x, 0.9) from (select unnest({[low] * 4 + [high]}::double[]) as x)").fetchall()[0][0]
    assert high > limit and found == [("excessive_fallback", 2)]


def test_interpolated_quantiles_equal_the_sql_to_the_last_bit(spark):
    rows = [(k, 0.1 + k / 7 + (i * (k + 3) % 5) * 2.0**-53) for k in range(200) for i in range(2 + k % 23)] + [(900, None), (901, 3.0)]
    for q in (0.1, 0.15, 0.9):
        around = F.struct(*[c.alias(n) for c, n in zip(stats.sorted_quantile("v", q), ("low", "high", "weight"))]).alias("q")
        found = spark.createDataFrame(rows, "k long, v double").groupBy("k").agg(around).select("k", stats.interpolated(F.col("q.low"), F.col("q.high"), F.col("q.weight")).alias("q")).collect()
        con = duckdb.connect()
        con.sql("create table t (k bigint, v double)")
        con.executemany("insert into t values (?, ?)", rows)
        assert sorted(map(tuple, found)) == sorted(con.sql(f"select k, quantile_cont(v, {q}) from t group by k").fetchall())


def test_cliffs_delta_and_permutation(spark):
    df = spark.createDataFrame([(1, g, float(v), b) for g, vs in (("a", [1, 2, 2, 5]), ("b", [1, 2, 3])) for b, v in enumerate(vs)], "k long, g string, v double, block long")
    want = sum((x > y) - (x < y) for x in (1, 2, 2, 5) for y in (1, 2, 3)) / 12
    assert math.isclose(stats.cliffs_delta(df, ["k"], "g", "a", "b", "v").first().cliffs_delta, want)
    p = stats.block_permutation(df, ["k"], "g", "a", "b", "v", "block", 99).first()
    assert 0 < p.p <= 1 and math.isclose(p.difference, 0.5)
    boot = stats.block_bootstrap(df, ["k"], "v", "block", 100).first()
    assert boot.ci_low <= boot.estimate <= boot.ci_high


def test_spaced_and_covering_picks(spark):
    df = series(spark, [0, 1, 2, 10, 11], [5, 9, 8, 1, 2])
    assert sorted(r.sample_index for r in select.spaced_top_k(df, K, "value", "t", 2 * SEC, 3, "sample_index").collect()) == [1, 4]
    pool = spark.createDataFrame([(1, 0, 1.0, ["a"]), (1, 1, 0.5, ["a", "b"]), (1, 2, 0.1, ["c"]), (1, 3, 0.9, [])], "g long, i long, p double, s array<string>")
    assert [r.i for r in select.coverage(pool, ["g"], "s", "p", "i", 5).collect()] == [1, 2]
    split = select.group_split(spark.range(100).withColumn("g", F.col("id") % 10), "g", {"train": 0.5, "test": 0.5})
    assert select.leaks(split, "g").isEmpty()


def test_tracks(spark):
    fixes = spark.createDataFrame([(0.0, 0.0, None), (45.0, 7.0, 10.0), (45.0, 7.0, None), (45.0, 7.0, 80.0), (91.0, 7.0, 1.0), (None, 7.0, 1.0)], "latitude double, longitude double, accuracy double")
    assert spatial.valid_fix(fixes).count() == 2
    line = spark.createDataFrame([(1, i, i, float(i), 0.0) for i in range(11)], "recording_id long, sample_index long, t long, x double, y double")
    track = spatial.track(line, K, "x", "y")
    assert track.where("t = 10").first().heading_deg == 90.0
    kept = spatial.redact_ends(track, K, "distance_m", 2.0)
    assert [r.distance_m for r in kept.orderBy("t").collect()] == [float(i) for i in range(7)]
    assert spatial.redact_ends(track, K, "distance_m", 5.0).count() == 0
    box = spatial.bounding_box(fixes.where("latitude = 45"), [], 1000.0).first()
    assert box.south < 45 < box.north and box.east - box.west > box.north - box.south


def test_state_machine_is_causal_and_streams_alike(spark, tmp_path):
    import random

    draw = random.Random(6)
    rows = [(k, i, int(i * SEC + (30 * SEC if i > 40 else 0)), None if draw.random() < 0.2 else draw.uniform(0, 200)) for k in range(3) for i in range(80)]
    schema = "recording_id long, sample_index long, t long, value double"
    batch = machine.state_machine(spark.createDataFrame(rows, schema), 120.0, 40.0, 10 * SEC, 3)
    want = sorted(map(tuple, batch.collect()))
    assert {r[5] for r in want} == {0, machine.FIRST, machine.GAP}
    for a, b in ((0, 30), (30, 55), (55, 80)):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = machine.state_machine_stream(stream, 120.0, 40.0, 10 * SEC, 3)
    run = out.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("states").collect())) == want


def test_windows_and_sessions_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1) + timedelta(minutes=m), 1.0) for m in (0, 1, 2, 30, 31, 200)]
    spark.createDataFrame(rows, "k long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, want in (
        ("tumbled", lambda s: machine.tumbling(s, "ts", ["k"], "10 minutes", "5 minutes", "value"), [2, 3]), ("sessions", lambda s: machine.sessions(s, "ts", ["k"], "10 minutes", "5 minutes"), [2, 3]),
    ):
        stream = spark.readStream.schema("k long, ts timestamp, value double").parquet(str(tmp_path / "in"))
        run = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        assert sorted(r.n for r in spark.table(name).collect()) == want


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 45.0), (2, "b", 46.0)], "id long, name string, latitude double")
    tables.write_both(df, str(tmp_path / "out"), ["id", "name"])
    assert tables.read_csv(spark, str(tmp_path / "out/csv"), "id long, name string").count() == 2
    tables.append_jsonl(df, str(tmp_path / "log"))
    tables.append_jsonl(df, str(tmp_path / "log"))
    assert tables.read_jsonl(spark, str(tmp_path / "log"), "id long, name string").count() == 4
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/f1.json").write_text('{"frame": 7}')
    assert tables.read_metadata(spark, str(tmp_path / "meta"), "frame long").first().file_name == "f1.json"
    found = tables.inventory(spark, str(tmp_path / "meta")).first()
    assert (found.kind, found.size, found.file_id) == ("document", 12, f"document_{found.sha256[:12]}")
    built = []
    make = lambda: built.append(1) or df
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert tables.stage(spark, str(tmp_path / "stage"), config, make).count() == 2
    assert len(built) == 2
    assert tables.remaining(df.select("id"), df.where("id = 1"), ["id"]).first().id == 2
    assert tables.dotted(tables.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}), "a.b") == 3
    assert tables.stable_hash({"b": 1, "a": 2}) == tables.stable_hash({"a": 2, "b": 1})


def test_only_changed_files_are_hashed_again(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "two")):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_text(text)
    empty = spark.createDataFrame([], "path string, size long, modified long, sha256 string")
    first = tables.hashed(spark, str(tmp_path / "files"), empty)
    first.write.parquet(str(tmp_path / "cache"))
    marked = spark.read.parquet(str(tmp_path / "cache")).withColumn("sha256", F.lit("known"))
    (tmp_path / "files" / "b.txt").write_text("three")
    found = {r.path[-5:]: r.sha256 for r in tables.hashed(spark, str(tmp_path / "files"), marked).collect()}
    assert found["a.txt"] == "known" and found["b.txt"] == __import__("hashlib").sha256(b"three").hexdigest()
    assert tables.hashed(spark, str(tmp_path / "files"), first).count() == 2


def test_checksums_tell_what_changed_and_small_files_are_whole(spark, tmp_path):
    root = tmp_path / "package"
    for name in ("keep", "change", "remove"):
        tables.write_text(spark, str(root / f"{name}.txt"), name)
    tables.checksums(spark, str(root)).write.parquet(str(tmp_path / "manifest"))
    tables.write_text(spark, str(root / "change.txt"), "other")
    tables.write_text(spark, str(root / "sub" / "new.txt"), "new")
    (root / "remove.txt").unlink()
    (root / ".remove.txt.crc").unlink(missing_ok=True)
    assert (root / "change.txt").read_text() == "other" and not list(root.glob("*.tmp"))
    found = {r.name: r.what for r in tables.changed_files(tables.checksums(spark, str(root)), spark.read.parquet(str(tmp_path / "manifest"))).collect()}
    assert found == {"change.txt": "changed", "remove.txt": "removed", "sub/new.txt": "added"}


def test_a_saved_state_goes_on_where_it_ended(spark, tmp_path):
    rows = [(k, i, i * 10**9, float((i * 7 + k) % 23)) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "recording_id long, sample_index long, t long, value double")
    options = {"up": 15.0, "down": 5.0, "gap_ns": 5 * 10**9, "ttl": 3}
    whole = sorted(map(tuple, machine.state_machine(df, **options).collect()))
    out, state = machine.advance(df.where("sample_index < 25 and recording_id < 3"), None, **options)
    machine.save_state(state, str(tmp_path / "state"), options)
    again = machine.load_state(spark, str(tmp_path / "state"), options)
    rest, _ = machine.advance(df.where("sample_index >= 25 or recording_id = 3"), again, **options)
    assert sorted(map(tuple, out.collect() + rest.collect())) == whole
    with pytest.raises(ValueError, match="other settings"):
        machine.load_state(spark, str(tmp_path / "state"), options | {"ttl": 4})


def test_operators_can_be_added_by_name(spark):
    @machine.register("doubled")
    def doubled(df, by):
        return df.withColumn("id", F.col("id") * by)

    assert [r.id for r in machine.apply("doubled", spark.range(3), by=2).orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError, match="taken"):
        machine.register("doubled")(doubled)
    with pytest.raises(ValueError, match="no operator"):
        machine.apply("nothing", spark.range(1))
    del machine.PLUGINS["doubled"]


def test_windows_of_rows_and_grids_check_their_arguments(spark):
    df = spark.createDataFrame([(1, i, i * 10**9) for i in range(10)] + [(2, i, (100 + i) * 10**9) for i in range(10)], "k long, sample_index long, t long")
    ids = lambda **window: sorted(r.t // 10**9 for r in select.time_window(df, ["k"], "t", **window).collect())
    assert ids(start_s=2.0, end_s=4.0) == [2, 3, 4, 102, 103, 104]
    assert ids(start_ns=8 * 10**9, start_s=0.0, end_s=1.0) == [100, 101]  # an absolute start wins
    assert len(ids()) == 20
    for wrong in ({"start_ns": 5, "end_ns": 4}, {"start_s": -1.0}):
        with pytest.raises(ValueError):
            ids(**wrong)
    assert asof.grid_frames(df, ["k"], None).count() == 20
    assert sorted(r.sample_index for r in asof.grid_frames(df.where("k = 1"), ["k"], 4 * 10**9).collect()) == [0, 4, 8]
    with pytest.raises(Exception, match="rise strictly"):
        asof.grid_frames(df.unionByName(df), ["k"], 10**9).collect()


def test_quantiles_and_ranks_without_whole_keys(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(draw.integers(0, 3, 3000), np.round(draw.lognormal(0, 2, 3000), 1))] + [(7, 1.5), (8, None)]
    found = {r.k: r for r in stats.quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}).collect()}
    assert set(found) == {0, 1, 2, 7}
    for k, r in found.items():
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], np.quantile([v for q, v in rows if q == k], [0, 0.25, 0.5, 0.99, 1]))
