"""Exact order statistics of groups of any size.

The rank that is sought is narrowed down by histograms: a group's rows are counted in cells
between its least and greatest value, the cell that holds the rank becomes the next range, with
the least and greatest value in it, and so on. Counts are combined before their shuffle, so a
group is never in one task, nor all its distinct values in one buffer. A subtraction, a division
and a product by the same numbers never turn the order of two values, so that cells are in
order whatever the rounding, and results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.operators.robust import finite
from wavetally.operators.rounds import kept

#: Cells of a histogram, and how often a range is narrowed before its values are counted one by one.
CELLS, TIMES = 4096, 2


#: Rows of a table that are broadcast whole, and rows of a key that are too many for one task.
FEW, HOT = 100_000, 1_000_000


def beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a table of few rows a key, which has in ``n`` the number of a key's
    rows. A small table is broadcast; of a large one its rows of hot keys, so that no key is read by
    one task."""
    table = kept(table)
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), keys)
    hot = table.where(F.col("n") > HOT)
    cool = rows.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cool.join(table.where(F.col("n") <= HOT), keys))


def _cell(v: Column, low: Column, high: Column) -> Column:
    """A halved difference cannot overflow; one value alone has cell zero."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.lit(CELLS - 1), F.floor(share * CELLS))).otherwise(F.lit(0))


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: Column) -> DataFrame:
    """keys, n, rank, v: the values at the given ranks (from 1) of each key's finite values.
    ``ranks``: an array of longs that may use ``n``, the number of those values."""
    rows = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stats = kept(stats)
    sought = stats.select(*keys, "n", F.explode(F.array_distinct(ranks)).alias("rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    order = Window.partitionBy(*keys, "rank").orderBy("_c")
    for turn in range(TIMES + 1):
        last = turn == TIMES
        if turn == 0:  # all ranks of a key share its first histogram
            seen = beside(rows, stats, keys).groupBy(*keys, _cell(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_c")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
            seen = seen.join(sought, keys)
        else:
            inside = beside(rows, sought, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            place = F.col("_v") if last else _cell(F.col("_v"), F.col("_lo"), F.col("_hi"))
            seen = inside.groupBy(*keys, "n", "rank", "_below", place.alias("_c")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = seen.withColumn("_upto", F.col("_below") + F.sum("_m").over(order))
        hit = upto.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_m") < F.col("rank")))
        sought = hit.select(*keys, "n", "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_upto") - F.col("_m")).alias("_below"))
    return sought.select(*keys, "n", "rank", F.col("_lo").alias("v"))


def quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """keys, n and one column for each level: linear between the two values around it. No keys:
    one row for all."""
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, levels).drop("_all")
    at = lambda p: (F.col("n") - 1) * float(p)
    low = lambda p: F.floor(at(p)).cast("long")
    ranks = F.array(*[r for p in levels.values() for r in (low(p) + 1, F.least(low(p) + 2, F.col("n")))])
    found = ranked_values(df, keys, value, ranks).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    part = lambda k: F.element_at("_at", k)

    def between(p: float) -> Column:
        a, b, share = part(low(p) + 1), part(F.least(low(p) + 2, F.col("n"))), at(p) - low(p)
        return F.when(share == 0, a).otherwise(a + (b - a) * share)

    return found.select(*keys, "n", *[between(p).alias(k) for k, p in levels.items()])
