"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_GROUPS, HOT_ROWS, join_groups, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_lowest(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Rows with the least neighbour ``m`` of their ``u`` in ``edges``, u itself included; ``n`` is the
    number of rows."""
    least = max(HOT_ROWS, n // HOT_GROUPS)
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), (F.col("n") > least).alias("hot"))
    if n <= least:  # too few rows for a hot group
        return rows.join(lowest.drop("hot"), "u")
    return join_groups(rows, stored(lowest, "lowest"), ["u"]).drop("hot")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the links; a component is named by its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a minimum by
    node, which combines before the shuffle, and an equi-join, for star centres by broadcast.  Each round is written to the shared
    folder.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = _both_ways(edges)
        n = edges.count()
        large = _with_lowest(both.where("v > u"), both, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "edges")
        joined = _with_lowest(large, large, large.count())
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
