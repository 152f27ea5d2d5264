"""Map matching: road network tables from node and way lists, candidate segments, Viterbi decoding, gates and attributes."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_reasons, clip, first_reason, menger, segment_projection, turn_deg
from .islands import ordered
from .spatial import heading


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways(way_id, nodes ARRAY<LONG>) and nodes(node_id, x, y) to one row per segment.

    way_id, seg, from_node, to_node, ax, ay, bx, by, length_m, offset_m (distance along the way to
    the segment's start).
    """
    steps = ways.select("way_id", F.posexplode("nodes").alias("seg", "from_node"), "nodes").withColumn("to_node", F.get("nodes", F.col("seg") + 1)).where("to_node is not null").drop("nodes")
    end = lambda side, a, b: nodes.select(F.col("node_id").alias(side), F.col("x").alias(a), F.col("y").alias(b))
    rows = steps.join(end("from_node", "ax", "ay"), "from_node").join(end("to_node", "bx", "by"), "to_node").withColumn("length_m", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = Window.partitionBy("way_id").orderBy("seg")
    return rows.withColumn("offset_m", F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length_m"))


def junctions(ways: DataFrame, roundabouts: DataFrame | None = None) -> DataFrame:
    """Nodes in two ways or more that are on no roundabout way."""
    uses = ways.select("way_id", F.explode("nodes").alias("node_id")).distinct()
    found = uses.groupBy("node_id").agg(F.count_distinct("way_id").alias("n_ways")).where("n_ways >= 2")
    if roundabouts is not None:
        found = found.join(uses.join(roundabouts.select("way_id"), "way_id").select("node_id").distinct(), "node_id", "left_anti")
    return found


def described(roads: DataFrame) -> DataFrame:
    """Segments with their heading and the way's curvature at both ends; the way's ends take their neighbour's, a way of one segment has none."""
    w = Window.partitionBy("way_id").orderBy("seg")
    rows = roads.withColumn("road_heading_deg", F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(360.0)))
    rows = rows.withColumn("_to", menger(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.lead("bx").over(w), F.lead("by").over(w))).withColumn("_from", F.lag("_to").over(w))
    return rows.withColumns({"curve_from": F.coalesce("_from", "_to"), "curve_to": F.coalesce("_to", "_from")}).drop("_from", "_to")


def shared_nodes(ways: DataFrame) -> DataFrame:
    """Per way the nodes that other ways have too: way_id, shared. Ways that touch nothing are left out."""
    uses = ways.select("way_id", F.explode("nodes").alias("node_id")).distinct()
    many = uses.groupBy("node_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("node_id")
    return uses.join(many, "node_id").groupBy("way_id").agg(F.sort_array(F.collect_list("node_id")).alias("shared"))


def fix_sigma(accuracy: Column, sigma: float = 8.0) -> Column:
    """A fix's spread in metres: its reported accuracy, ``sigma`` at least."""
    return F.greatest(F.lit(sigma), F.coalesce(accuracy.cast("double"), F.lit(sigma)))


def candidates(fixes: DataFrame, roads: DataFrame, keys: list[str], radius: float, most: int = 24, order: str = "sample_index", accuracy: str | None = None) -> DataFrame:
    """Segments within radius of each fix(x, y): the nearest of each way, the ``most`` nearest ways.

    Segments are laid into the cells of a grid of ``radius`` that their box, widened by radius,
    touches; a fix looks into its own cell only. With ``accuracy`` a poor fix looks as far as twice
    its spread, so into more cells; leave out useless fixes before (``spatial.valid_fix``). Segments
    from ``described`` give the place on the road, its heading and curvature too.
    """
    cell = lambda c: F.floor(c / radius)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - radius), cell(F.greatest(a, b) + radius)))
    laid = roads.withColumn("_cx", span(F.col("ax"), F.col("bx"))).withColumn("_cy", span(F.col("ay"), F.col("by")))
    far = F.lit(float(radius)) if accuracy is None else F.greatest(F.lit(float(radius)), 2 * fix_sigma(F.col(accuracy)))
    more = far - radius
    about = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("_more")), cell(F.col(c) + F.col("_more"))))
    seen = fixes.withColumn("_more", more)
    if accuracy is None:
        seen = seen.withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    else:
        seen = seen.where("x is not null and y is not null").withColumn("_cx", about("x")).withColumn("_cy", about("y"))
    near = seen.join(laid, ["_cx", "_cy"])
    distance, t = segment_projection(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    near = near.withColumns({"distance_m": distance, "along_m": F.col("offset_m") + t * F.col("length_m")}).where(F.col("distance_m") <= F.col("_more") + radius)
    way = Window.partitionBy(*keys, order, "way_id").orderBy("distance_m", "seg")
    place = Window.partitionBy(*keys, order).orderBy("distance_m", "way_id")
    best = near.withColumn("_w", F.row_number().over(way)).where("_w = 1")
    told = ["x", "y", "way_id", "seg", "distance_m", "along_m"] + ([accuracy] if accuracy else [])
    if "road_heading_deg" in roads.columns:
        best = best.withColumn("_t", F.coalesce(F.try_divide(F.col("along_m") - F.col("offset_m"), F.col("length_m")), F.lit(0.0)))
        on = lambda a, b: F.col(a) + F.col("_t") * (F.col(b) - F.col(a))
        best = best.withColumns({"road_x": on("ax", "bx"), "road_y": on("ay", "by"), "curvature": F.when(F.col("_t") <= 0.5, F.col("curve_from")).otherwise(F.col("curve_to"))})
        told += ["road_x", "road_y", "road_heading_deg", "curvature"]
    return best.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= most).select(*keys, order, "t", *told)


def decode(found: DataFrame, keys: list[str], sigma: float = 8.0, scale: float = 15.0, detour: float = 60.0, order: str = "sample_index", touching: float = 5.0, accuracy: str | None = None) -> DataFrame:
    """The likeliest sequence of candidates per key.

    A candidate costs half its squared distance over the spread (``sigma``, or the fix's accuracy if
    that is worse); a step costs the difference of the way along the road and straight over ``scale``.
    Where it changes ways it is ``detour`` metres longer, ``touching`` where both ways have a node in
    common by the column ``shared``. Of equals the nearer one, then the lower way. Sequential by
    nature, so a track goes to one pandas call; memory is one track's candidates.
    """
    touch = "shared" in found.columns
    gone = {"t", "x", "y", "seg", "shared", accuracy}
    kept = [c for c in found.columns if c not in gone]

    def viterbi(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "distance_m", "way_id"], kind="stable").reset_index(drop=True)
        starts = np.flatnonzero(np.r_[True, rows[order].to_numpy()[1:] != rows[order].to_numpy()[:-1]])
        ends = np.r_[starts[1:], len(rows)]
        d, way, along = rows["distance_m"].to_numpy(), rows["way_id"].to_numpy(), rows["along_m"].to_numpy()
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        spread = np.fmax(rows[accuracy].to_numpy(float), sigma) if accuracy else sigma
        emission = -0.5 * (d / spread) ** 2
        nodes = {w: frozenset(s) if s is not None else frozenset() for w, s in zip(way, rows["shared"])} if touch else {}

        @functools.lru_cache(1024)
        def change(a: tuple, b: tuple) -> np.ndarray:
            return np.array([[touching if nodes[p] & nodes[q] else detour for q in b] for p in a])

        score = emission[: ends[0]]
        back = []
        for a, b, c in zip(starts[:-1], starts[1:], ends[1:]):
            straight = math.hypot(x[b] - x[a], y[b] - y[a])
            same = way[a:b, None] == way[None, b:c]
            extra = change(tuple(way[a:b]), tuple(way[b:c])) if touch else detour
            road = np.where(same, np.abs(along[a:b, None] - along[None, b:c]), straight + extra)
            total = score[:, None] - np.abs(road - straight) / scale
            pick = total.argmax(0)
            back.append(pick)
            score = total[pick, np.arange(c - b)] + emission[b:c]
        at = int(score.argmax())
        chosen = [starts[-1] + at]
        for pick, a in zip(reversed(back), reversed(starts[:-1])):
            at = int(pick[at])
            chosen.append(a + at)
        return rows.loc[chosen[::-1], kept]

    kinds = ", ".join(f"{c} {dict(found.dtypes)[c]}" for c in kept)
    return found.groupBy(*keys).applyInPandas(viterbi, kinds)


def assessed(fixes: DataFrame, chosen: DataFrame, ways: DataFrame, keys: list[str], radius: float = 30.0, most_turn: float = 60.0, least_speed: float = 2.0, order: str = "sample_index") -> DataFrame:
    """Every fix with its place on the road, or the reason why it has none.

    ``fixes`` have heading_deg, speed_mps and accuracy_m (any of them may be NULL), ``chosen`` what
    ``decode`` gives of candidates on ``described`` segments, ``ways`` a boolean ``oneway`` and any
    other attributes, which follow the matched way. A place farther than ``radius`` or turned by more
    than ``most_turn`` from the road, either way round, isn't matched; below ``least_speed`` headings
    are noise and don't count. match_quality is the cube root of the shares left of distance, turn
    (one half without a heading) and accuracy. route_progress_m adds up steps between matched fixes.
    """
    rows = fixes.join(chosen, [*keys, order], "left")
    ahead = turn_deg(F.col("heading_deg"), F.col("road_heading_deg"))
    rows = rows.withColumns({"_ahead": ahead, "heading_error_deg": F.least(ahead, 180 - ahead), "travel_reversed": F.coalesce(180 - ahead < ahead, F.lit(False))})
    trusted = F.col("heading_deg").isNotNull() & (F.col("speed_mps").isNull() | (F.col("speed_mps") >= least_speed))
    gates = [(F.col("way_id").isNull(), "no road near"), (F.col("distance_m") > radius, "too far from the road"), (F.col("_trusted") & (F.col("heading_error_deg") > most_turn), "turned from the road")]
    rows = rows.withColumn("_trusted", trusted).withColumn("reason", first_reason(gates, "ok")).withColumn("matched", F.col("reason") == "ok")
    placed = ["way_id", "distance_m", "along_m", "road_x", "road_y", "road_heading_deg", "curvature", "heading_error_deg"]
    rows = rows.withColumns({c: F.when(F.col("matched"), F.col(c)) for c in placed} | {"travel_reversed": F.col("travel_reversed") & F.col("matched")})
    # A way's attributes are joined to matched fixes only: the others have no way.
    rows = rows.join(ways.drop("nodes").join(shared_nodes(ways), "way_id", "left"), "way_id", "left")
    rows = rows.withColumn("against_oneway", F.coalesce(F.col("oneway") & F.col("travel_reversed"), F.lit(False)))
    warnings = [(~F.col("_trusted"), "heading not trusted"), (F.col("accuracy_m").isNull(), "accuracy unreported"), (F.col("accuracy_m") > 25, "poor accuracy"), (F.col("distance_m") > 0.5 * radius, "far from the road"), (F.col("against_oneway"), "against one way")]
    turned = F.when(F.col("_trusted"), clip(1 - F.col("heading_error_deg") / most_turn, 0, 1)).otherwise(0.5)
    quality = F.cbrt(clip(1 - F.col("distance_m") / radius, 0, 1) * turned * (8.0 / fix_sigma(F.col("accuracy_m"))))
    rows = rows.withColumns({"warnings": F.when(F.col("matched"), all_reasons(warnings)), "match_quality": F.when(F.col("matched"), quality).otherwise(0.0)})
    w = ordered(keys, "t", order)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("matched"), F.struct(F.col("way_id").alias("w"), F.col("along_m").alias("a"), F.col("road_x").alias("x"), F.col("road_y").alias("y"), F.col("shared").alias("s")))
    rows = rows.withColumn("_p", F.last(here, ignorenulls=True).over(so_far))
    straight = F.hypot(F.col("road_x") - F.col("_p.x"), F.col("road_y") - F.col("_p.y"))
    apart = straight + F.when(F.arrays_overlap("shared", "_p.s"), 5.0).otherwise(60.0)
    step = F.when(F.col("way_id") == F.col("_p.w"), F.abs(F.col("along_m") - F.col("_p.a"))).otherwise(apart)
    rows = rows.withColumn("_step", F.when(F.col("matched"), F.coalesce(step, F.lit(0.0))))
    progress = F.when(F.col("matched"), F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("route_progress_m", progress).drop("_ahead", "_trusted", "_p", "_step", "shared")


def match(fixes: DataFrame, ways: DataFrame, nodes: DataFrame, keys: list[str], radius: float = 30.0, most_turn: float = 60.0, order: str = "sample_index") -> DataFrame:
    """Map matching from fixes(t, x, y, speed_mps, accuracy_m) to ``assessed`` rows."""
    found = candidates(fixes, described(segments(ways, nodes)), keys, radius, order=order, accuracy="accuracy_m").join(shared_nodes(ways), "way_id", "left")
    chosen = decode(found, keys, order=order, accuracy="accuracy_m")
    return assessed(heading(fixes, keys, "x", "y", order=order), chosen, ways, keys, radius, most_turn, order=order)
