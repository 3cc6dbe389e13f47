"""Half-open sample intervals: rasterising, merging, erosion, exposure, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_sample(seconds: Column, rate: float) -> Column:
    return F.ceil(seconds * rate - 1e-10).cast("long")


def from_annotations(notes: DataFrame, rate: float, n_samples: Column, label: str, key: str = "record_id") -> DataFrame:
    """Annotations of one label as clipped, merged intervals."""
    rows = notes.where(F.col("label") == label).select(
        key,
        F.greatest(F.lit(0), left_sample(F.col("onset_s"), rate)).alias("start"),
        F.least(n_samples, left_sample(F.col("onset_s") + F.col("duration_s"), rate)).alias("stop"),
    )
    return merge(rows.where("start < stop"), [key])


def merge(rows: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", gap: int = 0) -> DataFrame:
    """Union of intervals, joined across gaps of at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (before.isNull() | (F.col(start) > before + gap)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(w))
    return island.groupBy(*keys, "_i").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n")).drop("_i")


def erode(rows: DataFrame, margin: int) -> DataFrame:
    """Takes ``margin`` off both ends of every interval; record edges are ends too."""
    return rows.withColumns({"start": F.col("start") + margin, "stop": F.col("stop") - margin}).where("start < stop")


def cells_of(start: Column, stop: Column, cell: int) -> Column:
    """The cells of width ``cell`` that a half-open interval touches; none if it is empty."""
    whole = F.sequence(F.floor(start / cell), F.floor((stop - 1) / cell))
    return F.when(start < stop, whole).otherwise(F.array().cast("array<bigint>"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Intersections of two interval tables, per key.

    Both tables are cut at cells, and the join is an equality of key and cell, so that one key
    is spread over as many tasks as it has cells. A pair that meets in several cells is reported
    in that of its later start alone. ``cell`` is best about as long as a common interval: each
    interval is sent once for every cell that it touches."""
    left = a.select(*keys, "start", "stop").withColumn("_cell", F.explode(cells_of(F.col("start"), F.col("stop"), cell)))
    right = b.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    right = right.withColumn("_cell", F.explode(cells_of(F.col("_s"), F.col("_e"), cell)))
    later = F.greatest("start", "_s")
    both = left.join(right, [*keys, "_cell"]).where((later < F.least("stop", "_e")) & (F.floor(later / cell) == F.col("_cell")))
    return both.select(*keys, later.alias("start"), F.least("stop", "_e").alias("stop"))


def length(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias(name))


def exposure(stage: DataFrame, eroded: DataFrame, invalid: DataFrame, rate: float, keys: list[str], cell: int) -> DataFrame:
    """Sample counts of the stage, of what erosion leaves, of invalid samples in it, and the
    eligible hours. ``cell``: see ``overlap``."""
    parts = [length(stage, keys, "stage_samples"), length(eroded, keys, "eroded_samples"), length(overlap(eroded, merge(invalid, keys), keys, cell), keys, "invalid_samples")]
    out = parts[0].join(parts[1], keys, "left").join(parts[2], keys, "left").na.fill(0, ["eroded_samples", "invalid_samples"])
    eligible = F.col("eroded_samples") - F.col("invalid_samples")
    return out.withColumn("eligible_samples", eligible).withColumn("eligible_hours", eligible / rate / 3600)


def contained(windows: DataFrame, runs: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Windows that lie within one run of a table of disjoint runs. A window looks into the cell
    of its start only, as a run that holds it touches that cell."""
    right = runs.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    right = right.withColumn("_cell", F.explode(cells_of(F.col("_s"), F.col("_e"), cell)))
    left = windows.withColumn("_cell", F.floor(F.least(F.col("start"), F.col("stop") - 1) / cell))  # an empty one: that before it
    return left.join(right, [*keys, "_cell"]).where((F.col("start") >= F.col("_s")) & (F.col("stop") <= F.col("_e"))).drop("_s", "_e", "_cell")


def project_rate(rows: DataFrame, source: float, target: float, n_target: int) -> DataFrame:
    """Intervals of one rate as those of another: a target sample i reads source sample
    floor(i * source / target)."""
    to = lambda c: F.ceil(F.col(c) * (target / source) - 1e-10).cast("long")
    return rows.withColumns({"start": F.least(to("start"), F.lit(n_target)), "stop": F.least(to("stop"), F.lit(n_target))}).where("start < stop")


def aligned(onset: Column, origin_us: Column, measured_us: Column, first_s: Column | float = 0.0) -> Column:
    """Onsets on the recording's clock; without an origin they stay as they are."""
    return F.when(origin_us.isNull(), onset).otherwise(onset + (origin_us - measured_us) / 1e6 - first_s)
