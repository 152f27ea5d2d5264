"""Selection: top-k, spaced top-k, coverage, quotas, splits, samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stats import drawn


def top_k(df: DataFrame, keys: list[str], by: list[Column], k: int) -> DataFrame:
    """The first k rows per key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)


def spaced_top_k(df: DataFrame, keys: list[str], score: str, time: str, gap_ns: int, k: int, order: str) -> DataFrame:
    """Greedy by score: a row nearer than gap_ns to one taken before is passed over.

    Greedy picks depend on each other, so a key's rows go to one pandas call; choose keys that
    bound them (a recording, a day).
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, order], ascending=[False, True], kind="stable")
        taken, kept = [], []
        for i, t in enumerate(rows[time].tolist()):
            if all(abs(t - other) >= gap_ns for other in taken):
                taken.append(t)
                kept.append(i)
                if len(kept) == k:
                    break
        return rows.iloc[kept]

    return df.groupBy(*keys).applyInPandas(pick, df.schema)


def coverage(df: DataFrame, keys: list[str], strata: str, priority: str, order: str, k: int) -> DataFrame:
    """Greedy cover: each step takes the row that adds most new strata, then the higher priority, then the first.

    ``strata`` is an ARRAY<STRING>. Stops at k rows or when nothing new is left. Of rows with equal
    strata only the first can ever be taken, so one of each goes to a key's pandas call.
    """
    same = Window.partitionBy(*keys, F.array_sort(F.array_distinct(F.coalesce(strata, F.array().cast(df.schema[strata].dataType))))).orderBy(F.desc(priority), order)
    df = df.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([priority, order], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets = [frozenset(s if s is not None else ()) for s in rows[strata]]
        covered: set = set()
        kept: list[int] = []
        left = set(range(len(rows)))
        while left and len(kept) < k:
            best = min(left, key=lambda i: (-len(sets[i] - covered), i))
            if not sets[best] - covered:
                break
            covered |= sets[best]
            kept.append(best)
            left.discard(best)
        out = rows.iloc[kept].copy()
        return out

    return df.groupBy(*keys).applyInPandas(pick, df.schema)


def quota(df: DataFrame, keys: list[str], by: list[Column], wanted: int) -> DataFrame:
    """Rows taken and still missing per key, for a quota."""
    ranked = top_k(df, keys, by, wanted)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_taken"), (F.lit(wanted) - F.count("*")).alias("shortfall"))


def scored(df: DataFrame, weights: dict[str, float], over: list[str] | None = None) -> Column:
    """Weighted sum of columns scaled from their least to their largest value; a constant column counts 0."""
    w = Window.partitionBy(*(over or []))
    parts = [F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)) * v for c, v in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def every_nth(df: DataFrame, keys: list[str], n: int, by: str, most: int | None = None) -> DataFrame:
    """Every n-th row per key from the first, ``most`` of them at most."""
    w = Window.partitionBy(*keys).orderBy(by)
    out = df.withColumn("_rn", F.row_number().over(w) - 1).where(F.col("_rn") % n == 0)
    if most is not None:
        out = out.where(F.col("_rn") < n * most)
    return out.drop("_rn")


def shards(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """Round-robin shard numbers: disjoint, covering, and put back in order by (by)."""
    return df.withColumn("shard", (F.row_number().over(Window.partitionBy(*keys).orderBy(by)) - 1) % n)


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Whole groups to named parts by a hash of the group, so that no group is in two."""
    place = F.pmod(drawn(seed, group), F.lit(1_000_000)) / 1_000_000
    at, part = 0.0, None
    for name, share in shares.items():
        at += share
        part = F.when(place < at, name) if part is None else part.when(place < at, name)
    last = list(shares)[-1]
    return df.withColumn("part", part.otherwise(last))


def leaks(df: DataFrame, group: str, part: str = "part") -> DataFrame:
    """Groups that are in more than one part: empty if the split is sound."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def balanced(df: DataFrame, domain: str, by: Column, per_domain: int) -> DataFrame:
    """The first per_domain rows of each domain, interleaved by rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(domain).orderBy(by))).where(F.col("rank") <= per_domain)


def time_window(df: DataFrame, keys: list[str], time: str, start_ns: int | None = None, end_ns: int | None = None, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """Rows of a window, both ends included: absolute times, or seconds from each key's first row where no absolute one is given.

    A missing end is open. Only relative ends need the key's first time, by one aggregate.
    """
    check_window(start_ns, end_ns, start_s, end_s)
    if start_ns is None and start_s is not None or end_ns is None and end_s is not None:
        first = df.groupBy(*keys).agg(F.min(time).alias("_first"))
        df = df.join(first, keys)
    else:
        df = df.withColumn("_first", F.lit(0))
    for ns, s, keep in ((start_ns, start_s, lambda x: F.col(time) >= x), (end_ns, end_s, lambda x: F.col(time) <= x)):
        if ns is not None:
            df = df.where(keep(F.lit(ns)))
        elif s is not None:
            df = df.where(keep(F.col("_first") + F.lit(round(s * 1e9))))
    return df.drop("_first")


def check_window(start_ns: int | None, end_ns: int | None, start_s: float | None, end_s: float | None) -> None:
    """An error where a window ends before it begins, or a relative time is negative."""
    for low, high in ((start_ns, end_ns), (start_s, end_s)):
        if low is not None and high is not None and low > high:
            raise ValueError(f"the window ends at {high}, before its start {low}")
    if any(s is not None and s < 0 for s in (start_s, end_s)):
        raise ValueError("relative times count from the first row and can't be negative")


def stratified(df: DataFrame, keys: list[str], low: dict[str, float], high: dict[str, float], names: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """df with ``strata``: for each column its name below the pool's ``low`` quantile, above the ``high`` one, or between.

    Quantiles are of each key's pool and comparisons strict, so a column that hardly varies has no
    extremes. A name of None between leaves the column out there; NULL values have no stratum.
    """
    bounds = [F.percentile(c, q).alias(f"_{c}_{n}") for n, qs in (("low", low), ("high", high)) for c, q in qs.items()]
    rows = df.join(df.groupBy(*keys).agg(*bounds), keys)
    parts = []
    for c, (below, above, between) in names.items():
        rules = [(F.col(c) < F.col(f"_{c}_low"), below)] if c in low else []
        rules += [(F.col(c) > F.col(f"_{c}_high"), above)] if c in high else []
        part = F.when(F.col(c).isNull(), None)
        for rule, name in rules:
            part = part.when(rule, name)
        parts.append(part.otherwise(between))
    return rows.select(*df.columns, F.array_compact(F.array(*parts)).alias("strata"))


def buckets(df: DataFrame, order: str, hardness: str, every: int, hardest: int, others: int, seed: int = 0) -> DataFrame:
    """A validation set of three buckets, each without the rows of those before: every n-th row, the hardest, and some by a draw."""
    rows = df.withColumn("_draw", drawn(seed, order))
    uniform = rows.where(F.pmod(F.col(order), F.lit(every)) == 0).withColumn("bucket", F.lit("uniform"))
    rest = rows.where(F.pmod(F.col(order), F.lit(every)) != 0)
    hard = rest.orderBy(F.desc(hardness), order).limit(hardest).withColumn("bucket", F.lit("hard"))
    left = rest.join(F.broadcast(hard.select(order)), order, "left_anti")
    return uniform.unionByName(hard).unionByName(left.orderBy("_draw", order).limit(others).withColumn("bucket", F.lit("drawn"))).drop("_draw")


def flat(df: DataFrame, between: str = "_") -> DataFrame:
    """Nested structs as plain columns, each named by its path."""

    def parts(column: Column, name: str, kind) -> list[Column]:
        if not isinstance(kind, StructType):
            return [column.alias(name)]
        return [c for f in kind.fields for c in parts(column[f.name], f"{name}{between}{f.name}", f.dataType)]

    return df.select(*[c for f in df.schema.fields for c in parts(F.col(f.name), f.name, f.dataType)])
