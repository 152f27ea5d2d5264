"""Label tables: agreement, confusion, probability vectors, overlap resolution, phrase mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, ids: list | None = None) -> DataFrame:
    """(truth, predicted, n); pairs with an end outside ``ids`` or NULL are left out."""
    some = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    if ids is not None:
        some = some.where(F.col(truth).isin(ids) & F.col(predicted).isin(ids))
    return some.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Per class of a confusion table: tp, fp, fn, precision, recall, iou; NULL where nothing to divide by."""
    side = lambda c, tp: matrix.select(F.col(c).alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias(tp))
    truth = side("truth", "n_true").groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("n_true").alias("n_true"))
    said = side("predicted", "n_said").groupBy("label").agg(F.sum("n_said").alias("n_said"))
    both = truth.join(said, "label", "full").fillna(0, ["tp", "n_true", "n_said"])
    r = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, t, s = F.col("tp"), F.col("n_true"), F.col("n_said")
    return both.select("label", tp, (s - tp).alias("fp"), (t - tp).alias("fn"), r(tp, s).alias("precision"), r(tp, t).alias("recall"), r(tp, t + s - tp).alias("iou"))


def agreement(df: DataFrame, a: str, b: str, valid_a: Column, valid_b: Column, keys: list[str]) -> DataFrame:
    """Share of equal labels where both are valid, and the share of rows where both are."""
    both = valid_a & valid_b
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(both).alias("n_both"), F.try_divide(F.count_if(both & (F.col(a) == F.col(b))).cast("double"), F.count_if(both).cast("double")).alias("agreement")
    )


def time_per_label(df: DataFrame, keys: list[str], label: str, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Seconds per label by the step to the next sample (the last takes the median step), and its share."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    steps = df.withColumn("_dt", (F.lead(time).over(w) - F.col(time)) / 1e9)
    median = steps.groupBy(*keys).agg(F.percentile("_dt", 0.5).alias("_m"))
    timed = steps.join(median, keys).withColumn("_dt", F.coalesce("_dt", "_m")).groupBy(*keys, label).agg(F.sum("_dt").alias("seconds"))
    return timed.withColumn("share", F.try_divide(F.col("seconds"), F.sum("seconds").over(Window.partitionBy(*keys))))


def label_entropy(df: DataFrame, keys: list[str], label: str, n_labels: int) -> DataFrame:
    """Entropy of a label's shares over ln(n_labels), and over ln of the labels that occur."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    raw = counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("raw"), F.count("*").alias("n_present"))
    over = lambda n: F.when(n > 1, F.col("raw") / F.ln(n)).otherwise(0.0)
    return raw.select(*keys, "n_present", over(F.lit(n_labels)).alias("entropy"), over(F.col("n_present")).alias("entropy_present"))


def top_two(vector: Column) -> tuple[Column, Column, Column, Column]:
    """(index of the largest, its value, the second's value, their margin) of an ARRAY<DOUBLE>; first of ties."""
    largest = F.array_max(vector)
    at = F.array_position(vector, largest)
    rest = F.filter(vector, lambda x, i: i + 1 != at)
    second = F.coalesce(F.array_max(rest), F.lit(0.0))
    return (at - 1).cast("int"), largest, second, largest - second


def normalised(vector: Column) -> Column:
    """Shares of absolute values; zeros stay zeros."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(F.abs(x).cast("double"), total), F.lit(0.0)))


def resolve_overlap(df: DataFrame, keys: list[str], priority: str, score: str, order: str) -> DataFrame:
    """One row per place: higher priority, then strictly higher single-precision score, then the first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(priority), F.desc(F.col(score).cast("float")), order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def nms(df: DataFrame, keys: list[str], most_iou: float, score: str = "score", order: str = "box_id") -> DataFrame:
    """Greedy suppression of boxes x0, y0, x1, y1 per key by score; sequential, so in pandas per key, a box against all kept at once."""

    def keep(boxes: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.sort_values([score, order], ascending=[False, True], kind="stable")
        corner = boxes[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (corner[:, 2:] - corner[:, :2]).prod(1)
        left, kept = np.arange(len(boxes)), []
        while len(left):
            best, left = left[0], left[1:]
            kept.append(best)
            sides = np.minimum(corner[best, 2:], corner[left, 2:]) - np.maximum(corner[best, :2], corner[left, :2])
            inter = np.maximum(sides, 0).prod(1)
            union = area[best] + area[left] - inter
            left = left[~((union > 0) & (inter > most_iou * union))]
        return boxes.iloc[kept]

    return df.groupBy(*keys).applyInPandas(keep, df.schema)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def map_phrases(df: DataFrame, phrase_id: str, phrase: str, vocabulary: DataFrame, margin: float = 0.06, least: float = 0.5) -> DataFrame:
    """Phrases to classes by weighted token overlap, from vocabulary(class_name, phrase).

    A phrase equal to a vocabulary phrase gets its class with score 1. Otherwise the score is the
    weight of shared tokens over the weight of all tokens of either; weights are
    ln((N + 1) / (df + 0.5)) + 0.1 over the vocabulary. Below ``least`` there is no class; closer
    than ``margin`` to another class it is ambiguous. Ties go by name.
    """
    vocab = vocabulary.select("class_name", F.array_distinct(tokens(F.col("phrase"))).alias("vt"), F.array_join(tokens(F.col("phrase")), " ").alias("vk"))
    n = vocabulary.select(F.count("*").alias("big_n"))
    weights = vocab.select(F.explode("vt").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).join(F.broadcast(n), how="cross")
    weights = weights.select("tok", (F.ln((F.col("big_n") + 1) / (F.col("df") + 0.5)) + 0.1).alias("w"))
    own = df.select(phrase_id, F.array_distinct(tokens(F.col(phrase))).alias("pt"), F.array_join(tokens(F.col(phrase)), " ").alias("pk"))
    unknown = F.ln(F.col("big_n") + 1) + 0.8
    mine = own.select(phrase_id, F.explode("pt").alias("tok")).join(weights, "tok", "left").join(F.broadcast(n), how="cross").withColumn("w", F.coalesce("w", unknown))
    mine_total = mine.groupBy(phrase_id).agg(F.sum("w").alias("mine"))
    theirs = vocab.select("class_name", "vk", F.explode("vt").alias("tok")).join(weights, "tok")
    theirs_total = theirs.groupBy("class_name", "vk").agg(F.sum("w").alias("theirs"))
    shared = mine.select(phrase_id, "tok", "w").join(theirs.select("class_name", "vk", "tok"), "tok").groupBy(phrase_id, "class_name", "vk").agg(F.sum("w").alias("shared"))
    scored = shared.join(mine_total, phrase_id).join(theirs_total, ["class_name", "vk"]).join(own.select(phrase_id, "pk"), phrase_id)
    score = F.when(F.col("pk") == F.col("vk"), 1.0).otherwise(F.least(F.lit(0.99), F.col("shared") / (F.col("mine") + F.col("theirs") - F.col("shared"))))
    best = scored.groupBy(phrase_id, "class_name").agg(F.max(score).alias("score"))
    w = Window.partitionBy(phrase_id).orderBy(F.desc("score"), "class_name")
    ranked = best.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank = 1")
    verdict = F.when(F.coalesce("score", F.lit(0.0)) < least, "none").when((F.col("score") < 1) & (F.col("score") - F.coalesce("next", F.lit(0.0)) < margin), "ambiguous").otherwise("mapped")
    out = own.select(phrase_id).join(ranked, phrase_id, "left")
    return out.select(phrase_id, F.when(F.coalesce("score", F.lit(0.0)) >= least, F.col("class_name")).alias("class_name"), F.coalesce("score", F.lit(0.0)).alias("score"), verdict.alias("verdict"))


def class_agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two methods' labels of the same places: per class intersection, union and their ratio, and agreement where both have one."""
    pair = F.array_distinct(F.array_compact(F.array(a, b)))
    by = df.withColumn("class_name", F.explode(pair)).groupBy(*keys, "class_name").agg(F.count_if(F.col(a) == F.col(b)).alias("intersection"), F.count("*").alias("union"))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    whole = df.groupBy(*keys).agg(F.count_if(both).alias("n_common"), F.try_divide(F.count_if(both & (F.col(a) == F.col(b))), F.count_if(both)).alias("agreement"))
    return by.join(whole, keys).withColumn("iou", F.try_divide("intersection", "union"))


def coverage_metrics(df: DataFrame, frame: str, label: str) -> DataFrame:
    """Over frames: mean share of labelled places, of unlabelled ones, and classes in a frame."""
    by = df.groupBy(frame).agg(F.avg(F.col(label).isNotNull().cast("double")).alias("_c"), F.count_distinct(label).alias("_n"))
    return by.agg(F.count("*").alias("n_frames"), F.avg("_c").alias("coverage"), F.avg(1 - F.col("_c")).alias("unknown"), F.avg("_n").alias("classes_per_frame"))


def best_presence(df: DataFrame, keys: list[str], frame: str, label: str, of: list) -> DataFrame:
    """Share of a key's frames that hold the one of these classes which is in most of them."""
    whole = df.groupBy(*keys).agg(F.count_distinct(frame).alias("n"), *[F.count_distinct(F.when(F.col(label) == c, F.col(frame))).alias(f"_c{i}") for i, c in enumerate(of)])
    return whole.select(*keys, (F.greatest(F.lit(0).cast("long"), *[F.col(f"_c{i}") for i in range(len(of))]) / F.col("n")).alias("continuity"))


def dominant_near(points: DataFrame, places: DataFrame, keys: list[str], point_id: str, radius: int, label: str = "label") -> DataFrame:
    """The commonest label above 0 in the square of ``radius`` whole steps around each point(u, v), ties to the least, and its share.

    Places(x, y, label) meet points by the cell they stand in, so the join has equal keys.
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    near = points.select(*keys, point_id, F.explode(F.transform(reach, lambda d: F.round("u").cast("long") + d)).alias("x"), F.round("v").cast("long").alias("_v"))
    near = near.withColumn("y", F.explode(F.transform(reach, lambda d: F.col("_v") + d)))
    counts = near.join(places.where(F.col(label) > 0), [*keys, "x", "y"]).groupBy(*keys, point_id, label).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys, point_id).agg(F.max_by(F.struct(F.col(label).alias("l"), F.col("_n").alias("n")), F.struct("_n", -F.col(label))).alias("_b"), F.sum("_n").alias("_t"))
    found = points.select(*keys, point_id).join(best, [*keys, point_id], "left")
    return found.select(*keys, point_id, F.coalesce("_b.l", F.lit(0)).alias("label"), F.coalesce(F.col("_b.n") / F.col("_t"), F.lit(0.0)).alias("share"))


def aggregated_masks(queries: DataFrame, keys: list[str], classes: str, mask: str, n_classes: int) -> DataFrame:
    """Scores of queries(classes ARRAY, mask ARRAY): per cell the sum over queries of class chance times mask chance.

    Returns per key and cell the best class (ties to the first), its share of the cell's sum as confidence, and the entropy over ln of the classes.
    """
    cells = queries.select(*keys, classes, F.posexplode(mask).alias("cell", "_m"))
    scores = cells.select(*keys, "cell", F.posexplode(F.transform(classes, lambda c: c * F.col("_m"))).alias("class_id", "_s")).groupBy(*keys, "cell", "class_id").agg(F.sum("_s").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(*keys, "cell"))
    shares = scores.withColumn("_p", F.try_divide("_s", total))
    spread = -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0))
    return shares.groupBy(*keys, "cell").agg(F.max_by("class_id", F.struct("_p", -F.col("class_id"))).alias("class_id"), F.max("_p").alias("confidence"), (spread / F.ln(F.lit(float(n_classes)))).alias("entropy"))


def zone_candidate(u: Column, v: Column, zone: tuple[float, float, float, float], confidence: Column, least: float, entropy: Column, most: float) -> Column:
    """True in the zone (u0, v0, u1, v1) where the label is doubtful: little confidence or much entropy. NULL counts as no."""
    inside = u.between(zone[0], zone[2]) & v.between(zone[1], zone[3])
    return F.coalesce(inside & ((confidence < least) | (entropy > most)), F.lit(False))
