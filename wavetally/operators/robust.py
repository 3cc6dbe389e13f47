"""Robust scale: median absolute deviation, trailing and exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median, of finite values, per key."""
    from wavetally.operators.orderstats import beside, quantiles

    rows = df.where(finite(F.col(value)))
    med = quantiles(rows, keys, value, {"_m": 0.5}).select(*keys, "n", "_m")
    far = beside(rows.select(*keys, value), med, keys).select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return quantiles(far, keys, "_d", {"_q": 0.5}).select(*keys, (1.4826 * F.col("_q")).alias("mad"))


def trailing_mad(df: DataFrame, keys: list[str], time: str, value: str, bin_width: int, window: int, least: int) -> DataFrame:
    """Per key and bin of ``time``: the scale of the values in the ``window`` strictly before
    the bin's start, where it holds ``least`` values. An event's own bin never counts.

    Each row is dealt to the window / bin_width bins that see it, so the join is an
    equality; the window is a multiple of the bin."""
    if window % bin_width:
        raise ValueError("the window is a multiple of the bin")
    rows = df.where(finite(F.col(value))).select(*keys, F.floor(F.col(time) / bin_width).alias("_b"), F.col(value).alias("_v"))
    bins = df.select(*keys, F.floor(F.col(time) / bin_width).alias("bin")).distinct()
    seen = rows.withColumn("bin", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + window // bin_width))).join(bins, [*keys, "bin"])
    med = seen.groupBy(*keys, "bin").agg(F.median("_v").alias("_m"), F.count("*").alias("n")).where(F.col("n") >= least)
    return seen.join(med, [*keys, "bin"]).groupBy(*keys, "bin").agg(F.first("n").alias("n"), (1.4826 * F.median(F.abs(F.col("_v") - F.col("_m")))).alias("mad"))
