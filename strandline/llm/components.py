"""Connected components of a graph given as an edge table, for any size of component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a LONG, b LONG)`` that isn't its component's smallest.

    Each round every root with smaller neighbours hangs itself below the smallest of them, trees
    are flattened by pointer doubling, and the edges are rewritten to their ends' roots. Rounds
    and doublings are logarithmic in the longest chain. Only keyed joins and partial
    aggregations take part, the nodes of a giant component being dealt over the tasks; every step
    is a table in the shared folder.

    Empty input gives an empty result. Self loops, repeated edges and null ends have no effect.
    """
    live = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, name = scratch.keep(live, "edges-0"), "edges-0"
    trees, trees_name, step = None, None, 0
    while not live.isEmpty():
        step += 1
        hooks, hooks_name = scratch.keep(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"hooks-{step}-0"), f"hooks-{step}-0"
        doubling = 0
        while True:
            doubling += 1
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = lookup(hooks, above, "root").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            longer = scratch.keep(longer, f"hooks-{step}-{doubling}")
            scratch.drop(hooks_name)
            hooks, hooks_name = longer.select("node", "root"), f"hooks-{step}-{doubling}"
            if longer.where("moved").isEmpty():
                break
        if trees is None:
            grown = hooks
        else:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            grown = lookup(trees, above, "root").select("node", F.coalesce("above", "root").alias("root")).unionByName(hooks)
        grown = scratch.keep(grown, f"trees-{step}")
        up = lambda side: hooks.select(F.col("node").alias(side), F.col("root").alias(f"{side}_up"))
        a, b = F.coalesce("a_up", "a"), F.coalesce("b_up", "b")
        rest = lookup(lookup(live, up("a"), "a"), up("b"), "b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
        rest = scratch.keep(rest, f"edges-{step}")
        scratch.drop(name, hooks_name, *([trees_name] if trees_name else []))
        live, name, trees, trees_name = rest, f"edges-{step}", grown, f"trees-{step}"
    if trees is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    scratch.drop(name)
    return trees
