"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each round is two min-aggregations and two equi-joins over narrow rows
and is written to the shared folder, so a lost executor costs one round at most.  The driver sees
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    low = table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large_star_min")
    out = table(both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large_star")
    discard(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = table(down.groupBy("a").agg(F.min("b").alias("m")), "small_star_min")
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = table(moved.union(low).distinct(), "small_star")
    discard(low)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: two long columns): root is the smallest node reachable.

    Self-loops and repeated edges do no harm; nulls are not allowed.  Nodes without an edge to another
    node don't appear.  An empty table gives an empty result.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        wide = _large_star(now)
        done, now = now, _small_star(wide)
        discard(done, wide)
        before, state = state, _state(now)
    out = now.toDF("node", "root")
    out.scratch_root = now.scratch_root
    return out
