"""Class maps as long tables (frame, y, x, class): foveal sampling, histograms, flicker, evidence fusion, lanes; and frame failure flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_reasons, clip, first_reason, ratio, seconds_to_samples
from .islands import runs
from .stats import interpolated, sorted_quantile


def foveal(gaze: DataFrame, pixels: DataFrame, keys: list[str], sigma: float, reach: float, n_classes: int, x: str = "u", y: str = "v") -> DataFrame:
    """Gaussian-weighted class shares around each gaze point, times confidence: top two, margin, entropy over ln(n).

    pixels(keys, px, py, label, confidence) and points meet in cells of ``reach``, beyond which
    weights are left out. A place's pixels of one class weigh the same, so their confidences are added
    first, and points at one place are worked out once. Points without a pixel in reach get NULLs.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = gaze.select(*keys, x, y).distinct().select(*keys, x, y, F.explode(steps).alias("_s")).withColumns({"_cx": cell(x) + F.col("_s.i"), "_cy": cell(y) + F.col("_s.j")}).drop("_s")
    classes = pixels.groupBy(*keys, "px", "py", "label").agg(F.sum("confidence").alias("_c"))
    places = classes.groupBy(*keys, "px", "py").agg(F.collect_list(F.struct("label", "_c")).alias("_of")).withColumns({"_cx": cell("px"), "_cy": cell("py")})
    # Spark's estimate doesn't see the nine copies, so it may not broadcast them.
    near = spread.hint("merge").join(places, [*keys, "_cx", "_cy"])
    d2 = F.pow(F.col(x) - F.col("px"), 2) + F.pow(F.col(y) - F.col("py"), 2)
    weighed = near.where(d2 <= reach * reach).select(*keys, x, y, F.exp(-d2 / (2 * sigma * sigma)).alias("_w"), F.explode("_of").alias("_l"))
    mass = weighed.select(*keys, x, y, "_l.label", (F.col("_w") * F.col("_l._c")).alias("_m")).groupBy(*keys, x, y, "label").agg(F.sum("_m").alias("m"))
    whole = Window.partitionBy(*keys, x, y)
    shares = mass.withColumn("p", F.try_divide(F.col("m"), F.sum("m").over(whole))).withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("p"), "label")))
    top = shares.groupBy(*keys, x, y).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("label"))).alias("top1"), F.max(F.when(F.col("_rank") == 1, F.col("p"))).alias("p1"), F.max(F.when(F.col("_rank") == 2, F.col("label"))).alias("top2"),
        F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("p"))), F.lit(0.0)).alias("p2"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)) / F.ln(F.lit(n_classes))).alias("entropy"),
    )
    return gaze.join(top, [*keys, x, y], "left").withColumn("margin", F.col("p1") - F.col("p2"))


def histogram(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Pixels and share per class and frame."""
    counts = pixels.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def pixel_flicker(pixels: DataFrame, place: list[str], frame: str, label: str = "label") -> DataFrame:
    """Share of pixels per frame whose class differs from the frame before at the same place."""
    w = Window.partitionBy(*place).orderBy(frame, label)
    rows = pixels.withColumn("_b", F.lag(label).over(w)).where("_b is not null")
    return rows.groupBy(frame).agg(F.count("*").alias("n"), F.avg((F.col(label) != F.col("_b")).cast("int")).alias("flicker"))


def layered(outside: Column, inside: Column, glass: Column, mirror: Column) -> Column:
    """What a look goes to: mirror, then what is outside, then the cockpit, then plain glass."""
    return F.when(mirror.isNotNull(), mirror).when(outside.isNotNull(), outside).when(inside.isNotNull(), inside).when(glass.isNotNull(), glass).otherwise(F.lit("none"))


def fused(df: DataFrame, keys: list[str], label: str, confidence: str, entropy: str, priority: str, penalty: float = 0.25) -> DataFrame:
    """The evidence with the highest confidence - penalty * entropy + priority / 1000 per key, and the runner-up's distance."""
    score = F.col(confidence) - penalty * F.col(entropy) + F.col(priority) / 1000
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), label)
    ranked = df.withColumn("score", score).withColumns({"_rank": F.row_number().over(w), "lead_by": F.col("score") - F.lead("score").over(w)})
    return ranked.where("_rank = 1").select(*keys, label, "score", "lead_by")


def lane_bands(columns: DataFrame, keys: list[str], place: str, on: Column, least: int, most_gap: int = 1) -> DataFrame:
    """Runs of neighbouring image columns where a marking is present, at least ``least`` wide: centre and width."""
    rows = columns.where(F.coalesce(on, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(place)
    rows = rows.withColumn("_new", F.coalesce((F.col(place) - F.lag(place).over(w) > most_gap).cast("int"), F.lit(1))).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "band").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("last") - F.col("first") + 1 >= least).withColumns({"centre": (F.col("first") + F.col("last")) / 2, "width": F.col("last") - F.col("first") + 1})


def lane_offset(bands: DataFrame, keys: list[str], axis: float) -> DataFrame:
    """Offset of the axis between the neighbouring pair of bands whose middle is nearest to it, in half widths."""
    w = Window.partitionBy(*keys).orderBy("centre")
    pairs = bands.withColumn("_right", F.lead("centre").over(w)).where("_right is not null").withColumn("_mid", (F.col("centre") + F.col("_right")) / 2)
    best = pairs.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("_mid") - axis).alias("d"), F.col("centre").alias("left"), F.col("_right").alias("right"))).alias("b"))
    mid, half = (F.col("b.left") + F.col("b.right")) / 2, (F.col("b.right") - F.col("b.left")) / 2
    return best.select(*keys, F.col("b.left").alias("left"), F.col("b.right").alias("right"), F.try_divide(F.lit(axis) - mid, half).alias("offset"))


def failures(df: DataFrame, keys: list[str], blur: str, light: str, change: str) -> DataFrame:
    """Frames with blur in the lowest, light in the lowest or highest and change in the highest part of their own run."""
    q = df.groupBy(*keys).agg(F.percentile(blur, 0.1).alias("_b"), F.percentile(light, F.lit(0.08)).alias("_d"), F.percentile(light, F.lit(0.92)).alias("_g"), F.percentile(change, 0.9).alias("_c"))
    rows = df.join(q, keys)
    reason = all_reasons([(F.col(blur) < F.col("_b"), "blurred"), (F.col(light) < F.col("_d"), "dark"), (F.col(light) > F.col("_g"), "glare"), (F.col(change) > F.col("_c"), "sudden change")])
    severity = clip(F.try_divide(F.col(change) - F.col("_c"), F.col("_c")), 0, 1)
    return rows.withColumns({"modes": reason, "severity": F.coalesce(severity, F.lit(0.0))}).where("modes is not null").drop("_b", "_d", "_g", "_c")


#: The classes that the modes speak of.
COCKPIT = ["mirror", "instrument_display", "control_and_ego_vehicle"]
MOVING = ["vehicle", "two_wheeler", "pedestrian"]


def failure_modes(frames: DataFrame, classes: DataFrame, keys: list[str], trail_s: float = 0.7, frame: str = "frame", time: str = "t") -> DataFrame:
    """Candidate failures of a labelled run: frame, time, mode, label (NULL where no class is meant) and severity, 0 to 1.

    ``frames`` has entropy, confidence, fallback, conflict, geometric, dense_fill, blur and change, and
    whether a hand_visible and a hand_mask are there; ``classes`` a row for each frame and class with
    its fraction and components, zeros included. Limits on entropy, confidence, fallback, blur, change
    and components are the run's own quantiles. A trail is a moving class that shrinks below 0.4 of what
    it was trail_s before, by the run's median rate, and doesn't go. NULL finds nothing.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    step = F.percentile("_dt", 0.5)
    steps = F.when(step > 0, seconds_to_samples(F.lit(trail_s), 1e9 / step)).otherwise(F.lit(5))
    at = {"_entropy": ("entropy", 0.9), "_confidence": ("confidence", 0.1), "_fallback": ("fallback", 0.9), "_blur": ("blur", 0.15), "_change": ("change", 0.9)}
    around = [F.struct(*[part.alias(n) for part, n in zip(sorted_quantile(c, q), ("low", "high", "weight"))]).alias(name) for name, (c, q) in at.items()]
    limits = frames.withColumn("_dt", F.col(time) - F.lag(time).over(w)).groupBy(*keys).agg(steps.alias("_k"), *around)
    limits = limits.select(*keys, "_k", *[interpolated(F.col(f"{name}.low"), F.col(f"{name}.high"), F.col(f"{name}.weight")).alias(name) for name in at])
    share = lambda *names: F.coalesce(F.sum(F.when(F.col("label").isin(*names), F.col("fraction"))), F.lit(0.0))
    shares = classes.groupBy(*keys, frame).agg(share("road_surface").alias("_road"), share(*COCKPIT).alias("_cockpit"), share("mirror").alias("_mirror"), share("instrument_display").alias("_display"))
    whole = frames.join(shares, [*keys, frame], "left").fillna(0.0, ["_road", "_cockpit", "_mirror", "_display"]).join(limits, keys)

    visible, mask = F.coalesce("hand_visible", F.lit(False)), F.coalesce("hand_mask", F.lit(False))
    whole = whole.withColumns({"_n": F.row_number().over(w), "_false": mask & ~visible})
    whole = whole.withColumn("_held", F.col("_n") - F.coalesce(F.last(F.when(~F.col("_false"), F.col("_n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    c = F.col
    unsure, shaky = c("entropy") > c("_entropy"), c("confidence") < c("_confidence")
    beyond = lambda value, limit, by: (value - limit) / F.greatest(by, F.lit(1e-6))
    rules = [
        ("missing_external_segmentation", (c("_road") < 0.02) & (c("dense_fill") > 0.15), c("dense_fill")),
        ("high_entropy", unsure, beyond(c("entropy"), c("_entropy"), c("_entropy"))),
        ("anomalous_confidence", shaky, beyond(c("_confidence"), c("confidence"), c("_confidence"))),
        ("excessive_fallback", (c("fallback") > c("_fallback")) & (c("fallback") > 0.05), c("fallback")),
        ("internal_external_fusion_error", c("conflict") > 0.5, c("conflict")),
        ("cockpit_absorbed_by_external", (c("_cockpit") < 0.005) & (c("geometric") < 0.01), 1 - c("_cockpit") * 100),
        ("mirror_not_detected", c("_mirror") <= 0, 0.5),
        ("instrument_display_not_detected", c("_display") <= 0, 0.5),
        ("blur_related_failure", (c("blur") < c("_blur")) & (F.coalesce(unsure, F.lit(False)) | F.coalesce(shaky, F.lit(False))), 0.6),
        ("vibration_related_failure", (c("change") > c("_change")) & unsure, 0.6),
        ("visible_hand_not_proposed", visible & ~mask, 0.6),
        ("false_hand", c("_false"), 0.7),
        ("hand_mask_propagated_after_disappearance", c("_false") & (c("_held") >= c("_k")), 0.8),
    ]
    none = F.lit(None).cast("string")

    v = Window.partitionBy(*keys, "label").orderBy(frame)
    # A trail is ``unit`` long whatever its rows, so one range frame serves every rate.
    unit, slack = 1 << 36, 1 << 16
    past = Window.partitionBy(*keys, "label").orderBy("_u")
    per = classes.join(classes.groupBy(*keys, "label").agg(F.percentile("components", 0.92).alias("_parts")), [*keys, "label"]).join(limits.select(*keys, "_k"), keys)
    per = per.withColumns({"_n": F.row_number().over(v), "_was": F.lag("fraction").over(v), "_will": F.lead("fraction").over(v)}).withColumn("_u", F.expr(f"_n * {unit}L div _k"))
    since = past.rangeBetween(slack - unit, 0)
    per = per.withColumns({"_start": F.first("fraction").over(past.rangeBetween(-slack - unit, 0)), "_least": F.min("fraction").over(since), "_most": F.max("fraction").over(since)})
    trail = c("label").isin(MOVING) & (c("_n") > c("_k")) & (c("_start") > 0.01) & (c("_least") > 0) & (c("_most") < 0.4 * c("_start"))
    of_class = [
        ("fragmentation", (c("components") >= 8) & (c("components") > c("_parts")), c("components") / 40),
        ("flicker", (c("_was") > 0.002) & (c("_will") > 0.002) & (c("fraction") <= 0), 0.5),
        ("temporal_trail", trail, 0.5),
    ]

    def raised(df: DataFrame, found: list, label: Column) -> DataFrame:
        each = F.array(*[F.when(holds, F.struct(F.lit(mode).alias("mode"), label.alias("label"), clip(F.lit(s) if isinstance(s, float) else s, 0.0, 1.0).cast("double").alias("severity"))) for mode, holds, s in found])
        return df.select(*keys, frame, F.explode(F.array_compact(each)).alias("_e")).select(*keys, frame, "_e.*")

    return raised(whole, rules, none).unionByName(raised(per, of_class, c("label")))


def worst_runs(flagged: DataFrame, keys: list[str], frame: str, k: int) -> DataFrame:
    """The k longest runs of neighbouring flagged frames per key."""
    w = Window.partitionBy(*keys).orderBy(frame)
    rows = flagged.withColumn("_new", F.coalesce((F.col(frame) - F.lag(frame).over(w) > 1).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    table = rows.groupBy(*keys, "run").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return table.withColumn("rank", rank).where(F.col("rank") <= k).drop("run")


def weighted_accuracy(df: DataFrame, keys: list[str], truth: str, said: str, weight: Column) -> DataFrame:
    some = df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).withColumn("_w", weight)
    return some.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.when(F.col(truth) == F.col(said), F.col("_w")).otherwise(0.0)), F.sum("_w")).alias("accuracy"))


def evidence_state(votes: dict[str, tuple[Column, float]], yes: float, no: float) -> tuple[Column, Column, Column]:
    """(state, confidence, reasons) from weighted votes: sum of the weights that hold against two limits."""
    total = None
    for holds, weight in votes.values():
        part = F.when(holds, float(weight)).otherwise(0.0)
        total = part if total is None else total + part
    state = first_reason([(total >= yes, "yes"), (total <= no, "no")], "unclear")
    return state, clip(F.abs(total), 0, 1), all_reasons([(holds, name) for name, (holds, _) in votes.items()])


def reuse_agreement(df: DataFrame, keys: list[str], label: str, every: int, order: str) -> DataFrame:
    """Agreement of each row's label with the last of every ``every`` rows that was kept."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_kept", F.last(F.when(F.col("_rn") % every == 0, F.col(label)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.count_if(F.col(label) == F.col("_kept")), F.count("*")).alias("agreement"))


def stops(df: DataFrame, keys: list[str], speed: str, slow: float, least_s: float, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Runs below ``slow`` of at least least_s."""
    marked = runs(df.withColumn("_s", F.coalesce(F.col(speed) < slow, F.lit(False))), keys, F.col("_s"), time, order).where("_s")
    table = marked.groupBy(*keys, "run_id").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return table.where((F.col("end") - F.col("start")) / 1e9 >= least_s).drop("run_id")
