"""Ordered-sequence operators: runs, gaps, rolling sums, maxima, suppression, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.operators import intervals, scans
from wavetally.operators.robust import finite


def flat_runs(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float, least: int, cell: Column | None = None) -> DataFrame:
    """Runs of samples whose steps are finite and at most ``tolerance``: n steps are n + 1
    samples; runs of ``least`` (two at least) samples stay. ``cell``: see ``scans``."""
    rows = scans.with_previous(df, keys, order, F.col(value), "_p", cell)
    flat = (F.abs(F.col(value) - F.col("_p")) <= tolerance) & finite(F.col(value)) & finite(F.col("_p"))
    step = (~F.coalesce(flat, F.lit(False))).cast("long")
    rows = scans.running_sums(rows, keys, order, {"_k": F.lit(1).cast("long"), "_run": step}, cell)
    runs = rows.groupBy(*keys, "_run").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= max(2, least)).select(*keys, "first", "last", "n")


def invalid_runs(df: DataFrame, keys: list[str], sample: str, value: str, least: int, tolerance: float = 0.0, cell: Column | None = None) -> DataFrame:
    """Half-open intervals (keys, start, stop) of samples that are not finite or lie in a flat
    run of ``least`` samples; ``sample`` counts without gaps from its first value."""
    first = df.groupBy(*keys).agg(F.min(sample).alias("_0"))
    flat = flat_runs(df, keys, [sample], value, tolerance, least, cell).join(first, keys)
    flat = flat.select(*keys, (F.col("first") - 1 + F.col("_0")).alias("start"), (F.col("last") + F.col("_0")).alias("stop"))
    lost = df.where(~F.coalesce(finite(F.col(value)), F.lit(False))).select(*keys, F.col(sample).alias("start"), (F.col(sample) + 1).alias("stop"))
    return intervals.merge(lost.unionByName(flat), keys).drop("n")


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, cell: Column | None = None) -> DataFrame:
    """``filled``: linear in ``order`` through missing values, constant at the ends. ``cell``: see
    ``scans``."""
    good = F.when(finite(F.col(value)), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    rows = scans.nearest_known(df, keys, order, good, cell)
    a, b, t = F.col("_a"), F.col("_b"), F.col(order)
    between = a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])
    filled = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(a["t"] == b["t"], a["v"]).otherwise(between)
    return rows.withColumn("filled", filled).drop("_a", "_b")


def rolling(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], width: int, cell: Column | None = None) -> DataFrame:
    """Sums of each row and the ``width - 1`` after it; rows with a full window only."""
    return scans.rolling_sums(df, keys, order, columns, width, cell)


def strided(df: DataFrame, index: str, step: int) -> DataFrame:
    return df.where(F.col(index) % step == 0)


def local_maxima(df: DataFrame, keys: list[str], order: list[str], score: str, qualified: Column) -> DataFrame:
    """Qualified rows with no better qualified left and no equal or better right neighbour."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_s", F.when(qualified, F.col(score)))
    left, right = F.lag("_s").over(w), F.lead("_s").over(w)
    better = F.coalesce(left > F.col("_s"), F.lit(False)) | F.coalesce(right >= F.col("_s"), F.lit(False))
    return rows.withColumn("_no", better).where(F.col("_s").isNotNull() & ~F.col("_no")).drop("_s", "_no")


def best_per_center(df: DataFrame, keys: list[str], center: str, order: list[Column]) -> DataFrame:
    """Suppression at radius zero: one row for each centre."""
    w = Window.partitionBy(*keys, center).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def band_join(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, tolerance: int) -> DataFrame:
    """Pairs within ``tolerance``, as an equality join on cells of that width: each left row
    looks into three cells."""
    cells = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(left) / tolerance) + d)
    x = a.withColumn("_cell", F.explode(cells))
    y = b.withColumn("_cell", F.floor(F.col(right) / tolerance))
    return x.join(y, [*keys, "_cell"]).where(F.abs(F.col(left) - F.col(right)) <= tolerance).drop("_cell")


def nearest_best(anchors: DataFrame, found: DataFrame, keys: list[str], at: str, start: str, score: str, tolerance: int, anchor_id: str) -> DataFrame:
    """Per anchor the best score that starts within the tolerance, else zero and nulls."""
    hit = band_join(anchors.select(*keys, anchor_id, at), found.select(*keys, start, score), keys, at, start, tolerance)
    best = hit.groupBy(*keys, anchor_id).agg(F.max(score).alias("_b"), F.max_by(start, F.struct(F.col(score), -F.col(start))).alias("matched_start"))
    return anchors.join(best, [*keys, anchor_id], "left").withColumn("matched_score", F.coalesce("_b", F.lit(0.0))).drop("_b")


def match_events(truth: DataFrame, found: DataFrame, keys: list[str], tolerance: float, time: str = "t") -> DataFrame:
    """Greedy one-to-one matches in time order per key, the tolerance included: keys, truth_t,
    found_t.

    A fold over the merged times that carries those of one kind that still wait: whatever is
    older than the tolerance stops waiting, and a time of the other kind takes the first. Nothing
    waits across a gap of more than the tolerance, so keys are split there first."""
    pick = lambda df, kind: df.select(*keys, F.col(time).cast("double").alias("t"), F.lit(kind).alias("kind"))
    w = Window.partitionBy(*keys).orderBy("t", "kind")
    merged = pick(truth, 0).unionByName(pick(found, 1)).where("t is not null")
    apart = merged.withColumn("_g", (F.col("t") - F.lag("t").over(w) > tolerance).cast("int"))
    apart = apart.withColumn("_i", F.sum(F.coalesce("_g", F.lit(0))).over(w))
    times = apart.groupBy(*keys, "_i").agg(F.array_sort(F.collect_list(F.struct("t", "kind"))).alias("times")).where(F.size("times") > 1)
    none = F.struct(F.array().cast("array<double>").alias("wait"), F.lit(0).alias("kind"), F.array().cast("array<struct<truth_t:double,found_t:double>>").alias("pairs"))

    def step(state: Column, x: Column) -> Column:
        wait = F.filter(state["wait"], lambda t: x["t"] - t <= tolerance)
        pair = F.struct(F.when(x["kind"] == 1, wait[0]).otherwise(x["t"]).alias("truth_t"), F.when(x["kind"] == 1, x["t"]).otherwise(wait[0]).alias("found_t"))
        taken = (F.size(wait) > 0) & (state["kind"] != x["kind"])
        return F.when(taken, F.struct(F.slice(wait, 2, F.size(wait)).alias("wait"), state["kind"].alias("kind"), F.concat(state["pairs"], F.array(pair)).alias("pairs"))).otherwise(
            F.struct(F.concat(wait, F.array(x["t"])).alias("wait"), x["kind"].alias("kind"), state["pairs"].alias("pairs"))
        )

    return times.select(*keys, F.inline(F.aggregate("times", none, step, lambda s: s["pairs"])))
