"""Exact top-k search by inner product with the three-phase uniform threshold.

Vectors are cut into a few dimension slices; a tile is a shard of candidates against a block of
queries, and the products of one slice in it are that slice's score list. Phase 1 gathers local lists
of the best scores of every query from a share of the candidates, dealt by hash; the k-th best of
them, merged, is a safe cutoff. Phase 2 sends the cutoffs with the queries to all tiles: a total of at
least the cutoff needs some slice with at least its uniform share, so only such entries are
collected. Phase 3 adds their remaining slices exactly. So every product of a query and a candidate
is taken once, but for the share of phase 1. A block whose queries can't reach their cutoffs by the
norms in a shard is passed over. Heads are merged up a tree of bounded fan-in.

Defined cases: rows with a null id or a vector that is null, empty or holds a null or non-finite
component take no part; candidates of another length than the query's aren't compared with it;
of repeated rows each is a row of its own, and only the query's own row is left out; scores beyond
the range of LONG are clipped to it; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, Scratch

LONG = np.iinfo(np.int64)
#: Arrays merged in one task of the merge tree.
FAN_IN = 64
HEADS = pa.schema([("q", pa.int64()), ("shard", pa.int64()), ("head", pa.list_(pa.int64()))])
FOUND = pa.schema([("q", pa.int64()), ("shard", pa.int64()), ("head", pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])))])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row_id, vec_id, v ARRAY<LONG>) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = named.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return kept.select(F.monotonically_increasing_id().alias(ROW_ID), "vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def matrix(table: pa.Table) -> np.ndarray:
    values = table["v"].combine_chunks()
    return np.asarray(values.flatten()).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), np.int64)


def exact_kind(queries: np.ndarray, rows: np.ndarray):
    """The narrowest numbers in which no sum of products rounds: by Cauchy and Schwarz none exceeds the product of the norms."""
    longest = lambda some: math.sqrt(float((some.astype(np.float64) ** 2).sum(1).max(initial=0)))
    most = longest(queries) * longest(rows) * (1 + 1e-9)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def score_lists(queries: pa.Table, rows: pa.Table, slices: int, lanes: int = 256):
    """For each length of vectors and ``lanes`` queries at a time: these queries, the candidates, and the products by slice."""
    for n in sorted(set(queries["n"].to_pylist()) & set(rows["n"].to_pylist())):
        some, against = queries.filter(pc.equal(queries["n"], n)), rows.filter(pc.equal(rows["n"], n))
        left, right = matrix(some), matrix(against)
        kind = exact_kind(left, right)
        cuts = np.array_split(np.arange(n), min(slices, n))
        columns = [np.ascontiguousarray(right[:, c].T.astype(kind)) for c in cuts]
        for at in range(0, len(left), lanes):
            yield some.slice(at, lanes), against, [left[at : at + lanes, c].astype(kind) @ col for c, col in zip(cuts, columns)]


def head_lists(at: np.ndarray, columns: list[np.ndarray], lanes: int, k: int):
    """Entries in order of (query, columns), the first k of each query, and where each query's begin."""
    order = np.lexsort((*reversed(columns), at))
    at = at[order]
    starts = np.searchsorted(at, np.arange(lanes + 1))
    keep = np.arange(len(at)) - starts[at] < k
    counts = np.minimum(np.diff(starts), k)
    return order[keep], np.r_[0, np.cumsum(counts)]


def longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(LONG.min, min(LONG.max, int(x))) for x in scores], np.int64)
    return scores.astype(np.int64)


def listed(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def shard_of(rows: pa.Table, count: int) -> pa.Array:
    return pa.array(np.full(count, rows["shard"][0].as_py(), np.int64))


def phase_one(k: int, slices: int):
    """Each query's local list: its k best scores among the tile's candidates."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for some, against, parts in score_lists(queries, rows, slices) if queries.num_rows and rows.num_rows else ():
            total = sum(parts)
            own, row_ids, lanes = np.asarray(some[ROW_ID]), np.asarray(against[ROW_ID]), some.num_rows
            best = min(k + 1, total.shape[1])
            # The query's own row may be among the best, hence one more.
            ranked = -total if total.dtype != object else np.array([[-x for x in row] for row in total], object)
            cols = np.argpartition(ranked, best - 1, axis=1)[:, :best] if total.dtype != object else np.argsort(ranked, axis=1)[:, :best]
            at, col = np.repeat(np.arange(lanes), best), cols.ravel()
            other = own[at] != row_ids[col]
            at, scores = at[other], longs(total[at[other], col[other]])
            order, offsets = head_lists(at, [-np.maximum(scores, LONG.min + 1)], lanes, k)
            out.append(pa.Table.from_arrays([pa.array(own), shard_of(rows, lanes), listed(offsets, pa.array(scores[order]))], schema=HEADS))
        return pa.concat_tables(out) if out else HEADS.empty_table()

    return run


def phase_three(k: int, slices: int):
    """Entries with a slice at or above the uniform share of the cutoff, their other slices added exactly."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            # The longest candidate can't lift a query whose norm is too small over its cutoff.
            reach = np.asarray(queries["norm"]) * pc.max(rows["norm"]).as_py() * (1 + 1e-9)
            queries = queries.filter(pa.array(~(np.asarray(queries["cutoff"].fill_null(LONG.min)).astype(float) > reach)))
        for some, against, parts in score_lists(queries, rows, slices) if queries.num_rows and rows.num_rows else ():
            own, ids, row_ids, lanes = np.asarray(some[ROW_ID]), np.asarray(against["vec_id"]), np.asarray(against[ROW_ID]), some.num_rows
            cutoff = some["cutoff"].to_pylist()
            # Without a cutoff, or with one that was clipped, everything is sufficient.
            share = np.array([-math.inf if c is None or c == LONG.min else c // len(parts) for c in cutoff], parts[0].dtype)[:, None]
            enough = parts[0] >= share
            for part in parts[1:]:
                enough |= part >= share
            at, col = np.nonzero(enough)
            total = parts[0][at, col]
            for part in parts[1:]:
                total = total + part[at, col]
            least = np.array([-math.inf if c is None or c == LONG.min else c for c in cutoff], total.dtype if total.dtype == object else float)
            kept = np.flatnonzero((total >= least[at]) & (own[at] != row_ids[col]))
            at, col, scores = at[kept], col[kept], longs(total[kept])
            negative = -np.maximum(scores, LONG.min + 1)
            order, offsets = head_lists(at, [negative, ids[col], row_ids[col]], lanes, k)
            entries = pa.StructArray.from_arrays([pa.array(negative[order]), pa.array(ids[col][order]), pa.array(row_ids[col][order])], fields=list(FOUND.field("head").type.value_type))
            out.append(pa.Table.from_arrays([pa.array(own), shard_of(rows, lanes), listed(offsets, entries)], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return run


def merged(heads: DataFrame, k: int, shards: int, ascending: bool) -> DataFrame:
    """(q, head): the best k over all shards, at most FAN_IN arrays of k in one group at a time."""
    while True:
        shards = max(1, math.ceil(shards / FAN_IN))
        gathered = F.flatten(F.collect_list("head"))
        ranked = F.sort_array(gathered, asc=ascending)
        heads = heads.groupBy("q", F.floor(F.col("shard") / FAN_IN).alias("shard")).agg(F.slice(ranked, 1, k).alias("head"))
        if shards == 1:
            return heads.select("q", "head")


def exact_top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    slices: int = 2, shard_rows: int = 8192, block_rows: int = 2048, probe: int = 32,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own; ties go to the smaller id. ``shard_rows`` and ``block_rows`` bound a tile; one
    candidate in ``probe`` gives the cutoffs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(quantised(vectors, id_col, vector_col, scale), "vectors")
    is_query, v = F.col("vec_id") % every == 0, F.col("v")
    n_rows, n_queries, low, high = rows.agg(F.count("*"), F.count_if(is_query), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    # The narrowest components that hold them all, as they go to every block of queries.
    narrow = next((name for name, bits in (("smallint", 15), ("int", 31)) if n_rows and -(1 << bits) <= low and high < 1 << bits), "bigint")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumns({"n": F.size("v"), "norm": norm, "v": v.cast(f"array<{narrow}>")})
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), ROW_ID), F.lit(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = max(1, math.ceil(n_queries / block_rows))
    # New names for the columns: both sides come from one table, and a cogroup needs them apart.
    apart = lambda some: some.select(*[(F.col(c) + 0 if c != "v" else F.slice("v", 1, F.size("v"))).alias(c) for c in some.columns])

    def tiles(some: DataFrame, against: DataFrame, shards: int):
        right = against.withColumn("shard", dealt(shards, 1)).withColumn("block", every_one(blocks))
        return apart(some.withColumn("shard", every_one(shards))).groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))

    queries = rows.where(is_query).withColumn("block", dealt(blocks, 2))
    probed, few = rows.where(dealt(probe, 3) == 0), max(1, math.ceil(n_rows / probe / shard_rows))
    heads = tiles(queries, probed, few).applyInArrow(phase_one(k, slices), "q long, shard long, head array<long>")
    cutoffs = merged(heads, k, few, ascending=False).select(F.col("q").alias(ROW_ID), F.get("head", F.lit(k - 1)).alias("cutoff"))
    informed = scratch.keep(queries.join(cutoffs, ROW_ID, "left"), "queries")
    shards = max(1, math.ceil(n_rows / shard_rows))
    found = tiles(informed, rows, shards).applyInArrow(phase_three(k, slices), "q long, shard long, head array<struct<neg:long,id:long,row:long>>")
    best = merged(found, k, shards, ascending=True).withColumnRenamed("q", ROW_ID).join(informed.select(ROW_ID, F.col("vec_id").alias("query_id")), ROW_ID)
    ranked = best.select("query_id", F.posexplode("head").alias("at", "entry"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.id").alias("vec_id"), (-F.col("entry.neg")).alias("score"))
