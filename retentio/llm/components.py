"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import drop_saved, saved


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(nb: DataFrame, keep) -> DataFrame:
    """Link each neighbour of a node, where ``keep`` holds, to the least of
    the node and its neighbours. Two-sided ``nb`` (u, v)."""
    least = nb.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    e = nb.join(least, F.col("u") == F.col("c"))
    return e.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any orderable type to (node, component): the least
    node of the component; nodes without edges do not appear.

    Each step is one aggregation and one equi-join (large components are
    split by AQE's skew handling); the edges are written between rounds, and
    rounds go on until the edge set, a forest of stars, no longer changes.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(both, F.col("v") > F.col("u"))
        big = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # small star: a node's smaller neighbours and the node itself
        least = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = big.join(least, F.col("u") == F.col("c"))
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
                 .where("u <> v").distinct())
        new = saved(small, "links")
        now = _state(new)
        drop_saved(e)
        e = new
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
