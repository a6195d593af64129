"""Connected components by alternating stars, on joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, release


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a stored table, and their number and the sum of their hashes, counted as they are written."""
    seen = Observation()
    hashes = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    stored = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("s")), "edges")
    return stored, (seen.get["n"], int(seen.get["s"]))


def _star(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """pairs (u, v): link each neighbour v of u, and u if keep_self, to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # by shuffle: rounds of broadcasts would pile up at the driver
    linked = pairs.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) of every node in edges; component is the smallest node reachable.

    Rounds of large stars (neighbours above a node go to the least neighbour) and small
    stars (neighbours below it do) end when the edges no longer change, after a number of
    rounds that grows with the logarithm of the nodes. Grouped minima combine before the
    shuffle, so a node with very many neighbours is no hot key in them; the joins are
    plain ones that adaptive execution can split. Null ends and self-loops are ignored.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    current, seen = _written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, keep_self=False).where("u > v").distinct()
        following, counted = _written(_star(large, keep_self=True).where("u <> v").distinct())
        release(current)
        current, before, seen = following, seen, counted
        if seen == before:
            break
    # Stars now: every edge runs from a node to the least node of its component.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
