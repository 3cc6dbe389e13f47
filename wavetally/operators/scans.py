"""Ordered scans of keys of any size: cells apart, one summary a cell, offsets, stitched edges.

``cell`` is a column that never falls along the order within a key (a number's floor, a text's
beginning), so that a key is as many window partitions as it has cells. What a row needs from
the rows before its cell comes from a scan over one summary a cell. Without a cell a key is
one partition. Null keys are a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_cell"


def _apart(df: DataFrame, cell: Column | None) -> DataFrame:
    return df.withColumn(CELL, F.lit(0) if cell is None else cell)


def stitched(df: DataFrame, keys: list[str], summaries: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """df (with its cells) and beside each row what its cell is given: ``summaries`` are
    aggregates of a cell, ``carried`` expressions over a key's summaries in order of cells."""
    cells = df.groupBy(*keys, CELL).agg(*[c.alias(n) for n, c in summaries.items()])
    given = cells.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate([*keys, CELL])], *[c.alias(n) for n, c in carried.items()])
    on = [df[k].eqNullSafe(given[f"_g{i}"]) for i, k in enumerate([*keys, CELL])]
    return df.join(given, on, "left").drop(*[f"_g{i}" for i in range(len(keys) + 1)])


def _cells_before(keys: list[str], descending: bool = False):
    order = F.desc(CELL) if descending else F.asc(CELL)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], cell: Column | None = None, descending: bool = False) -> DataFrame:
    """Adds the sums of each row and all before it in the order. ``descending``: the cells fall
    along the order."""
    rows = _apart(df, cell)
    w = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_x{i}": c for i, c in enumerate(sums.values())})
    before = _cells_before(keys, descending)
    rows = stitched(rows, keys, {f"_s{i}": F.sum(f"_x{i}") for i in range(len(sums))}, {f"_b{i}": F.sum(f"_s{i}").over(before) for i in range(len(sums))})
    rows = rows.withColumns({n: F.sum(f"_x{i}").over(w) + F.coalesce(F.col(f"_b{i}"), F.lit(0)) for i, n in enumerate(sums)})
    return rows.drop(CELL, *[f"_{p}{i}" for p in "xb" for i in range(len(sums))])


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, cell: Column | None = None) -> DataFrame:
    """Row numbers from 1 in the order of each key."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, cell)


def with_previous(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str, cell: Column | None = None) -> DataFrame:
    """Adds ``value`` of the row before, in whichever cell; the first row of a key has null."""
    rows = _apart(df, cell).withColumns({"_v": F.struct(value.alias("v")), "_o": F.struct(*order)})
    rows = stitched(rows, keys, {"_l": F.max_by("_v", "_o")}, {"_b": F.last("_l", True).over(_cells_before(keys))})
    before = F.lag("_v").over(Window.partitionBy(*keys, CELL).orderBy(*order))
    return rows.withColumn(name, F.coalesce(before, F.col("_b"))["v"]).drop(CELL, "_v", "_o", "_b")


def nearest_known(df: DataFrame, keys: list[str], order: str, known: Column, cell: Column | None = None) -> DataFrame:
    """Adds ``_a`` and ``_b``: ``known`` of the last row up to each and of the first row from it
    on where it is not null, in whichever cell. Rows of one place see the same cell."""
    rows = _apart(df, cell).withColumn("_k", known)
    at = F.when(F.col("_k").isNotNull(), F.struct(F.col(order).alias("t"), F.col("_k").alias("k")))
    after = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(1, Window.unboundedFollowing)
    rows = stitched(rows, keys, {"_l": F.max_by("_k", at), "_f": F.min_by("_k", at)}, {"_p": F.last("_l", True).over(_cells_before(keys)), "_n": F.first("_f", True).over(after)})
    w = Window.partitionBy(*keys, CELL).orderBy(order)
    a = F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumns({"_a": F.coalesce(a, F.col("_p")), "_b": F.coalesce(b, F.col("_n"))}).drop(CELL, "_k", "_p", "_n")


def rolling_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], width: int, cell: Column | None = None, frame: int = 4096) -> DataFrame:
    """Sums of each row and the ``width - 1`` after it; rows with a full window only. Rows are
    numbered, and frames of ``frame`` rows also get the ``width - 1`` rows behind them."""
    frame = max(frame, width)
    rows = numbered(df, keys, order, "_r", cell).withColumn("_f", F.floor((F.col("_r") - 1) / frame))
    first = (F.col("_r") - 1) % frame < width - 1
    rows = rows.withColumn("_to", F.explode(F.when(first & (F.col("_f") > 0), F.array(F.col("_f"), F.col("_f") - 1)).otherwise(F.array("_f"))))
    ahead = Window.partitionBy(*keys, "_to").orderBy("_r").rowsBetween(0, width - 1)
    rows = rows.withColumns({n: F.sum(c).over(ahead) for n, c in sums.items()}).withColumn("_n", F.count("*").over(ahead))
    return rows.where((F.col("_f") == F.col("_to")) & (F.col("_n") == width)).drop("_r", "_f", "_to", "_n")
