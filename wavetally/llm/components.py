"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join back, in which
nodes with over a thousandth of all links are broadcast, so a hub needs no task of its own.
Work is cut by tables in the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_counted, written


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """edges: ``total`` rows (u, v) with v < u. Links of each node move to its smallest
    neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = join_counted(both, least, ["u"], "n", total * (1 + large))
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """edges: two long columns (u, v) in any order, repeats and loops allowed.

    Returns (node, component) for every node with a link to another; ``component`` is
    the smallest node reachable. No links: an empty table. Null ends are ignored.
    """
    a, b = edges.columns[:2]
    now = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
    before = mark(now)
    for _ in range(most_steps):
        if not before[0]:
            break
        star = written(_star(now, before[0], True), "stars")
        then = written(_star(star, before[0], False), "edges")
        drop_written(now)
        drop_written(star)
        now, after = then, mark(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
