"""Descriptive and inferential statistics per group, from aggregates and ranks; no all-pairs joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(value: str) -> list[Column]:
    """n, mean, sd (n-1), p05, p25, median, p75, p95, min, max, iqr; quantiles interpolate linearly."""
    q = lambda p: F.percentile(value, p)
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.05).alias("p05"), q(0.25).alias("p25"), q(0.5).alias("median"),
        q(0.75).alias("p75"), q(0.95).alias("p95"), F.min(value).alias("lowest"), F.max(value).alias("highest"), (q(0.75) - q(0.25)).alias("iqr"),
    ]


def mean_if_enough(value: str, least: int = 2) -> Column:
    return F.when(F.count(value) >= least, F.avg(value))


def linear_fit(y: str, x: str, least: int = 32) -> list[Column]:
    """Slope, intercept, r2 and r; all NULL below ``least`` pairs or where x hardly varies."""
    ok = (F.regr_count(y, x) >= least) & (F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) >= 1e-6)
    return [F.when(ok, f).alias(n) for f, n in ((F.regr_slope(y, x), "slope"), (F.regr_intercept(y, x), "icept"), (F.regr_r2(y, x), "r2"), (F.corr(y, x), "pearson"))]


def geometric_mean(value: str) -> Column:
    """exp of the mean logarithm: 0 where a value is 0, NULL where one is below."""
    v = F.col(value)
    logs = F.when(v == 0, F.lit(float("-inf"))).otherwise(F.ln(v))
    return F.when(F.count_if(v < 0) == 0, F.exp(F.avg(logs)))


def sorted_quantile(value: str, q: float) -> tuple[Column, Column, Column]:
    """The two sorted values around a quantile, and the upper one's weight; an aggregate that sorts a whole key's values."""
    rows = F.sort_array(F.collect_list(F.col(value).cast("double")))
    spot = (F.size(rows) - 1) * F.lit(float(q))
    return F.get(rows, F.floor(spot).cast("int")), F.get(rows, F.ceil(spot).cast("int")), spot - F.floor(spot)


def interpolated(low: Column, high: Column, weight: Column) -> Column:
    """low * (1 - weight) + high * weight with the first product unrounded, as DuckDB has it: of neighbouring
    doubles, that decides which ones lie above the quantile."""
    exact = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - weight, high * weight).cast("double")
    return F.when(weight == 0, low).when(low.isNotNull(), exact)


#: Parts that a key's values are cut into, so that no task sorts a whole key.
PARTS = 32


def joined_on(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys are equal."""
    other = b.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    return a.join(other, same, how).drop(*[f"_other_{c}" for c in on])


def cut_up(df: DataFrame, keys: list[str], value: str, seen: DataFrame | None = None) -> DataFrame:
    """df with ``_part``: 0 to PARTS - 1, rising with the value; equal values share a part.

    Any cuts give right results; that the parts are about equal comes from quantiles of one row in
    ten of ``seen`` (df). The cuts of up to 10,000 keys are broadcast; with more keys no key needs it.
    """
    cuts = (seen if seen is not None else df).sample(0.1, 7).groupBy(*keys).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 10 * PARTS).alias("_cuts"))
    few = cuts.limit(10_001).collect()
    if len(few) <= 10_000:
        cuts = F.broadcast(df.sparkSession.createDataFrame(few, cuts.schema))
    placed = joined_on(df, cuts, keys, "left")
    return placed.withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")


def before(parts: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """(keys, _part, _before, _total): the amount in all lower parts, and in all, from at most PARTS sums a key."""
    sums = parts.groupBy(*keys, "_part").agg(amount.alias("_sum"))
    w = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, "_part", below.alias("_before"), F.sum("_sum").over(w).alias("_total"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, interpolated linearly, without a whole key's values in one task.

    Counts of the parts tell which of them hold the ranks; only these are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    placed = cut_up(rows, keys, "_v")
    spot = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(spot(q)).cast("long") for q in at.values() for f in (F.floor, F.ceil)]))
    known = before(placed, keys, F.count("*")).select(*keys, "_part", "_before", "_total", ranks.alias("_ranks"))
    within = Window.partitionBy(*keys, "_part").orderBy("_v")
    size = F.lead("_before", 1).over(Window.partitionBy(*keys).orderBy("_part"))
    known = known.withColumn("_end", F.coalesce(size, F.col("_total"))).withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_end")))).where(F.size("_ranks") > 0)
    hit = joined_on(placed, known, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1).where(F.array_contains("_ranks", F.col("_rank")))
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"), F.first("_total").alias("_total"))
    value_at = lambda f, q: F.try_element_at("_of", f(spot(q)).cast("long"))
    return found.select(*keys, *[(value_at(F.floor, q) + (value_at(F.ceil, q) - value_at(F.floor, q)) * (spot(q) - F.floor(spot(q)))).alias(name) for name, q in at.items()])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, order: str) -> DataFrame:
    """Correlation of ordinal ranks: ties are ranked in ``order``. Ranks count within parts of a key's values, and the parts below."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y, order)
    for c, name in ((x, "_rx"), (y, "_ry")):
        placed = cut_up(some, keys, c)
        inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(c, order))
        some = joined_on(placed.withColumn("_inside", inside), before(placed, keys, F.count("*")), [*keys, "_part"])
        some = some.withColumn(name, (F.col("_before") + F.col("_inside")).cast("double")).drop("_part", "_inside", "_before", "_total")
    return some.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def cross_correlation(df: DataFrame, keys: list[str], x: str, y: str, most_lag: int, least: int = 8, time: str = "t", order: str = "sample_index") -> DataFrame:
    """Pearson r of x against y shifted by each lag in rows, and the lag with the largest |r|."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    lags = range(-most_lag, most_lag + 1)
    wide = df.withColumns({f"_s{i}": F.lead(y, k).over(w) if k >= 0 else F.lag(y, -k).over(w) for i, k in enumerate(lags)})
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{i}").alias("shifted")) for i, k in enumerate(lags)])
    long = wide.select(*keys, F.col(x).alias("_x"), F.explode(pairs).alias("_l")).select(*keys, "_x", "_l.lag", "_l.shifted")
    r = long.groupBy(*keys, "lag").agg(F.corr("_x", "shifted").alias("r"), F.regr_count("_x", "shifted").alias("n")).where(F.col("n") >= least)
    return r.groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("best")).select(*keys, F.col("best.lag").alias("lag"), F.col("best.r").alias("r"))


def cliffs_delta(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """(#a>b - #a<b) / (n m), from counts of smaller and equal values: sorts of a key's parts instead of all pairs."""
    some = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    at = some.groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    placed = cut_up(at, keys, value, some)
    w = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("nb").over(w), F.lit(0))
    counted = joined_on(placed, before(placed, keys, F.sum("nb")), [*keys, "_part"])
    won = counted.select(*keys, "na", "nb", (F.col("na") * (below - (F.col("_total") - below - F.col("nb")))).alias("score"))
    return won.groupBy(*keys).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.try_divide(F.sum("score").cast("double"), (F.sum("na") * F.sum("nb")).cast("double")).alias("cliffs_delta"))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Adjusted p within each family; NULL p stay NULL and don't count."""
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*family, some)
    rank, m = F.row_number().over(w.orderBy(p)), F.count(p).over(w)
    rows = df.withColumn("_scaled", F.when(some, F.col(p) * m / rank)).withColumn("_rank", rank)
    adjusted = F.least(F.lit(1.0), F.min("_scaled").over(w.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)))
    return rows.withColumn("p_adjusted", F.when(some, adjusted)).withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False))).drop("_scaled", "_rank")


def drawn(*parts) -> Column:
    """A number below 2**60 from the parts' MD5: the same draw on any cluster and in any engine."""
    spelt = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(spelt.cast("binary")), 1, 15), 16, 10).cast("long")


def block_bootstrap(df: DataFrame, keys: list[str], value: str, block: str, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over blocks drawn with replacement.

    Draws come from a hash of (seed, replicate, slot). Blocks
    are reduced to sums before, so a replicate moves blocks, never samples. NULL below 3 blocks.
    """
    w = Window.partitionBy(*keys)
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, block).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    sums = sums.withColumns({"slot": F.row_number().over(w.orderBy(block)) - 1, "k": F.count("*").over(w)})
    slots = sums.select(*keys, "k", F.col("slot").alias("place")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = F.pmod(drawn(seed, "rep", "place"), F.col("k")).cast("int")
    placed = slots.withColumn("slot", draw).join(sums.select(*keys, "slot", "s", "c"), [*keys, "slot"])
    means = placed.groupBy(*keys, "rep", "k").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = (1 - level) / 2
    bound = lambda q: F.when(F.first("k") >= 3, F.percentile("m", q))
    whole = sums.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("estimate"), F.count("*").alias("n_blocks"))
    return whole.join(means.groupBy(*keys).agg(bound(tail).alias("ci_low"), bound(1 - tail).alias("ci_high")), keys)


def block_permutation(df: DataFrame, keys: list[str], group: str, a, b, value: str, block: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Two-sided p of the difference of block means when the blocks' groups are dealt anew: (c + 1) / (n + 1)."""
    w = Window.partitionBy(*keys)
    means = df.where(F.col(group).isin(a, b)).groupBy(*keys, group, block).agg(F.avg(value).alias("m")).where("m is not null")
    means = means.withColumn("n_a", F.count_if(F.col(group) == a).over(w))
    dealt = means.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("place", F.when(F.col("rep") == 0, F.when(F.col(group) == a, -1).otherwise(1)).otherwise(drawn(seed, "rep", group, block)))
    ranked = dealt.withColumn("first", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("place", group, block)) <= F.col("n_a"))
    diff = ranked.groupBy(*keys, "rep").agg((F.avg(F.when(F.col("first"), F.col("m"))) - F.avg(F.when(~F.col("first"), F.col("m")))).alias("d"))
    seen = diff.withColumn("d0", F.max(F.when(F.col("rep") == 0, F.col("d"))).over(w)).where("rep > 0")
    return seen.groupBy(*keys).agg(F.first("d0").alias("difference"), ((F.count_if(F.abs("d") >= F.abs("d0") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def robust_index(df: DataFrame, keys: list[str], components: list[str], order: list[str]) -> DataFrame:
    """Each component from its 5th to its 95th percentile to [0, 1] (0.5 where constant), then the mean of those there are."""
    q = df.groupBy(*keys).agg(*[F.percentile(c, F.lit(p)).alias(f"_{c}_{n}") for c in components for p, n in ((0.05, "lo"), (0.95, "hi"))])
    rows = df.join(q, keys)
    scaled = {}
    for c in components:
        lo, hi = F.col(f"_{c}_lo"), F.col(f"_{c}_hi")
        scaled[f"_{c}_s"] = F.when(F.col(c).isNull(), None).when(hi - lo <= 1e-12, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col(c) - lo, hi - lo))))
    rows = rows.withColumns(scaled)
    there = F.array_compact(F.array(*scaled))
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there).cast("double"))
    return rows.select(*keys, *order, mean.alias("index_value"), (F.size(there) / len(components)).alias("completeness"))


#: Fewer units than this give an interval with a caveat.
MIN_UNITS = 8

#: Parts that rows are dealt to before each is drawn many times, as few rows would all stay in one task.
DEALT = 64


def mean_bootstrap(df: DataFrame, keys: list[str], value: str, order: str, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean when single rows are drawn with replacement.

    A draw is a place among the key's rows: a replicate of n draws costs n rows, so this is for keys
    of bounded size; block_bootstrap is for the others. Draws outnumber the rows by ``replicates``,
    which Spark's estimate doesn't see: they look their values up in the rows, dealt by place.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.row_number().over(w.orderBy(order)).alias("_slot"), F.count("*").over(w).alias("_n"))
    # A draw is never NULL; said so, it isn't worked out a second time to filter by it.
    place = F.coalesce((F.pmod(drawn(seed, "rep", "_slot"), F.col("_n")) + 1).cast("int"), F.lit(0))
    dealt = rows.repartition(DEALT, *keys, "_slot").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(*keys, "rep", place.alias("_slot"))
    means = dealt.join(rows.drop("_n").hint("shuffle_hash"), [*keys, "_slot"]).groupBy(*keys, "rep").agg(F.avg("_v").alias("_m"))
    tail = (1 - level) / 2
    return df.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count(value).alias("n")).join(means.groupBy(*keys).agg(F.percentile("_m", tail).alias("ci_low"), F.percentile("_m", 1 - tail).alias("ci_high")), keys)


def _resampled(units: DataFrame, keys: list[str], value: str, order: str, size: int, replicates: int, seed: int) -> DataFrame:
    """(keys, rep, value) of drawn runs of ``size`` neighbouring units, as many runs as there are, cut to the number of units."""
    w = Window.partitionBy(*keys)
    rows = units.withColumns({"_at": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    rows = rows.select(*keys, F.col(value).alias("_v"), F.floor(F.col("_at") / size).alias("_block"), (F.col("_at") % size).alias("_in"), "_n", F.ceil(F.col("_n") / size).alias("_blocks"))
    slots = rows.where("_in = 0").select(*keys, F.col("_block").alias("_slot"), "_blocks").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn_blocks = slots.select(*keys, "rep", "_slot", F.pmod(drawn(seed, "rep", "_slot"), F.col("_blocks")).alias("_block"))
    # The last run may be short, so a unit's place in the replicate counts the units before it.
    placed = drawn_blocks.join(rows, [*keys, "_block"]).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("_slot", "_in")))
    return placed.where(F.col("_place") <= F.col("_n")).select(*keys, "rep", F.col("_v").alias(value))


def paired_bootstrap(pairs: DataFrame, keys: list[str], a: str, b: str, order: str, size: int = 4, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Median of a - b over units that have both, with an interval from runs of neighbouring units, and a caveat where they are few."""
    units = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, order, (F.col(a) - F.col(b)).alias("_d"))
    medians = _resampled(units, keys, "_d", order, size, replicates, seed).groupBy(*keys, "rep").agg(F.percentile("_d", 0.5).alias("_m"))
    tail = (1 - level) / 2
    interval = medians.groupBy(*keys).agg(F.percentile("_m", tail).alias("ci_low"), F.percentile("_m", 1 - tail).alias("ci_high"))
    whole = units.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("difference"), F.count("*").alias("n_units"))
    return whole.join(interval, keys).withColumn("few_units", F.col("n_units") < MIN_UNITS)


def two_sample_bootstrap(df: DataFrame, keys: list[str], group: str, a, b, value: str, order: str, size: int = 4, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Difference of the groups' medians; each group is drawn by itself, as nothing pairs them. No row below 3 units in either."""
    units = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(*keys, group, order, value)
    medians = _resampled(units, [*keys, group], value, order, size, replicates, seed).groupBy(*keys, "rep", group).agg(F.percentile(value, 0.5).alias("_m"))
    of = lambda g, m: F.max(F.when(F.col(group) == g, F.col(m)))
    tail = (1 - level) / 2
    apart = medians.groupBy(*keys, "rep").agg((of(a, "_m") - of(b, "_m")).alias("_d"))
    interval = apart.groupBy(*keys).agg(F.percentile("_d", tail).alias("ci_low"), F.percentile("_d", 1 - tail).alias("ci_high"))
    each = units.groupBy(*keys, group).agg(F.percentile(value, 0.5).alias("_m"), F.count("*").alias("_n"))
    whole = each.groupBy(*keys).agg((of(a, "_m") - of(b, "_m")).alias("difference"), of(a, "_n").alias("n_a"), of(b, "_n").alias("n_b")).where("n_a >= 3 and n_b >= 3")
    return whole.join(interval, keys).withColumn("few_units", F.least("n_a", "n_b") < MIN_UNITS)


def events_per_block(df: DataFrame, keys: list[str], time: str, order: str, block_s: float) -> DataFrame:
    """How many events a window of ``block_s`` holds: its length over the median gap, 1 at least."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    gap = F.percentile((F.col(time) - F.col("_before")) / 1e9, 0.5)
    per = F.when(gap > 0, F.greatest(F.lit(1), F.rint(block_s / gap).cast("int"))).otherwise(F.lit(1))
    return df.withColumn("_before", F.lag(time).over(w)).groupBy(*keys).agg(per.alias("events_per_block"))


#: Components of the named indices; a missing one lowers the completeness.
INDICES = {
    "road_complexity": ("curvature", "junction_density", "lanes", "vehicle_density", "pedestrian_density", "sign_density", "boundary_density", "signal_density", "scene_change"),
    "visual_demand": ("gaze_switching", "gaze_entropy", "short_fixation_rate", "scanpath_length", "head_motion", "semantic_density"),
    "traffic_interaction": ("vehicle_count", "vehicle_pixel_share", "gaze_on_vehicles", "speed_variation", "braking_rate"),
}


def named_index(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """robust_index of the name's components that df has; completeness is their share of all it could have."""
    there = [c for c in INDICES[name] if c in df.columns]
    if not there:
        raise ValueError(f"df has no component of {name}: {', '.join(INDICES[name])}")
    found = robust_index(df, keys, there, order)
    return found.withColumn("completeness", F.col("completeness") * len(there) / len(INDICES[name])).withColumn("index_name", F.lit(name))


def apply_statistic(df: DataFrame, keys: list[str], value: str, statistic, out: str = "statistic") -> DataFrame:
    """A caller's own statistic of a numpy array, per key; a key's values must fit in a task."""

    @F.pandas_udf("double")
    def applied(values: pd.Series) -> float:
        return float(statistic(values.to_numpy()))

    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(applied(F.col(value).cast("double")).alias(out))
