"""The sample view of the events table, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3600 * 1_000_000_000
K = ["recording_id"]
KS = ["recording_id", "stream"]

#: The sample view, for the oracle.
S = "s as (select user_id as recording_id, event_type as stream, event_id as sample_index, epoch_us(ts) * 1000 as t, value from events)"


#: A draw of stats.drawn, for the oracle.
DRAW = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 15))::bigint"


def permutation_sql(source: str, keys: list[str], a: str, b: str, replicates: int) -> str:
    """CTEs up to ``tested`` for stats.block_permutation over source(keys, g, b, v)."""
    k = ", ".join(keys)
    return f"""pm as (select {k}, g, b, avg(v) as m from {source} where g in ('{a}', '{b}') group by {k}, g, b having avg(v) is not null), pn as (select *, count(*) filter (g = '{a}') over (partition by {k}) as n_a from pm),
pd as (select pn.*, rep, case when rep = 0 then (case when g = '{a}' then -1 else 1 end) else {DRAW(1, 'rep', 'g', 'b')} end as place from pn, range({replicates + 1}) r(rep)),
pr as (select *, row_number() over (partition by {k}, rep order by place, g, b) <= n_a as first from pd), pf as (select {k}, rep, avg(m) filter (first) - avg(m) filter (not first) as d from pr group by {k}, rep),
ps as (select *, max(d) filter (rep = 0) over (partition by {k}) as d0 from pf), tested as (select {k}, any_value(d0) as difference, (count(*) filter (abs(d) >= abs(d0) - 1e-12) + 1) / (count(*) + 1) as p from ps where rep > 0 group by {k})"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970, reading a time without zone as UTC."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def samples(spark: SparkSession, sf_dir: str, stream: str | None = None) -> DataFrame:
    """(recording_id, stream, sample_index, t ns, value) of the events."""
    events = table(spark, sf_dir, "events")
    if stream:
        events = events.where(F.col("event_type") == stream)
    return events.select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("stream"), F.col("event_id").alias("sample_index"), (micros(events, "ts") * 1000).alias("t"), "value")


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, as the oracles have them; no negative zeros."""
    return df.withColumns({c: rounded(F.col(c), places) for c, kind in df.dtypes if kind == "double"})


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places) + F.lit(0.0)
