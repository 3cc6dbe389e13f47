"""Operating thresholds from injection scores, and score grids.

Order statistics come from a count per distinct score and a running sum over those counts,
so the window sees distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.operators import scans


class CoverageError(ValueError):
    """A threshold lies below what was stored."""


class UnattainableError(ValueError):
    """Ties make an exact recovery count impossible."""


def ranked_scores(scores: DataFrame, keys: list[str], score: str = "score", cell: float | None = None) -> DataFrame:
    """Per key and distinct score: recovered = trials at or above it, and all trials. ``cell``:
    width of the cells of scores that are ranked apart (none: a key's scores together)."""
    per = scores.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    all_ = scores.groupBy(*keys).agg(F.count("*").alias("trials"))
    ranked = scans.running_sums(per, keys, [F.desc(score)], {"recovered": F.col("_n")}, None if cell is None else F.floor(F.col(score) / cell), descending=True)
    return ranked.join(all_, keys).select(*keys, score, "recovered", "trials")


def at_least(scores: DataFrame, keys: list[str], levels: list[float], score: str = "score", cell: float | None = None) -> DataFrame:
    """Per key and level: the k-th largest score, k = max(1, ceil(level * n - 1e-12)), and
    all that it recovers, ties included."""
    if any(not 0 < x <= 1 for x in levels) or sorted(set(levels)) != list(levels):
        raise ValueError("levels ascend within (0, 1]")
    ranked = ranked_scores(scores, keys, score, cell).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    k = F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("trials") - 1e-12))
    ok = ranked.where(F.col("recovered") >= k)
    return ok.groupBy(*keys, "level").agg(F.max(score).alias("threshold"), F.min("recovered").alias("recoveries"), F.first("trials").alias("trials"))


def exact_count(scores: DataFrame, keys: list[str], fraction: float, score: str = "score", cell: float | None = None) -> DataFrame:
    """As ``at_least`` with k = floor(fraction * n + 0.5); ``tied`` tells that the
    threshold recovers another count than k."""
    ranked = ranked_scores(scores, keys, score, cell).withColumn("k", F.floor(fraction * F.col("trials") + 0.5))
    got = ranked.where((F.col("recovered") >= F.col("k")) & (F.col("k") > 0)).groupBy(*keys).agg(
        F.max(score).alias("threshold"), F.min("recovered").alias("recoveries"), F.first("k").alias("wanted")
    )
    return got.withColumn("tied", F.col("recoveries") != F.col("wanted"))


def exact_or_raise(scores: DataFrame, keys: list[str], fraction: float, score: str = "score") -> DataFrame:
    """``exact_count`` for scores in [0, 1]; a key whose count would be under one, and ties
    across the rank, raise."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies within (0, 1]")
    inside = F.coalesce(F.col(score).between(0.0, 1.0) & ~F.isnan(score), F.lit(False))
    seen = scores.groupBy(*keys).agg(F.count("*").alias("trials"), F.count_if(~inside).alias("outside"))
    faults = seen.agg(F.count("*").alias("groups"), F.sum("outside").alias("outside"), F.count_if(F.floor(fraction * F.col("trials") + 0.5) < 1).alias("small")).first()
    if not faults["groups"] or faults["outside"]:
        raise ValueError("scores are finite numbers within [0, 1], one at least")
    if faults["small"]:
        raise ValueError("the wanted recovery is under one trial")
    found = exact_count(scores, keys, fraction, score)
    tied = found.where("tied").select(*keys, "recoveries", "wanted").limit(1).collect()  # one is named
    if tied:
        raise UnattainableError(f"ties recover {tied[0]['recoveries']} trials, not {tied[0]['wanted']}: {tied[0].asDict()}")
    return found.drop("tied")


def development_thresholds(injections: DataFrame, codes: list[str], grid: list[float], target: float, amplitude: float, jitter: float, score: str = "maximum_matched_score") -> DataFrame:
    """``grid_threshold`` of each code over the trials of one condition; a code without any
    trial raises."""
    rows = injections.where((F.col("amplitude_mad") == amplitude) & (F.col("interval_jitter_fraction") == jitter) & F.col("code_id").isin(codes))
    out = grid_threshold(rows, ["code_id"], grid, target, score)
    lost = sorted(set(codes) - {r["code_id"] for r in out.select("code_id").collect()})  # one row a code
    if lost:
        raise ValueError(f"no trials of the condition for {lost}")
    return out


def calibrated_only(found: DataFrame) -> DataFrame:
    """Codes with a threshold; none at all raises."""
    kept = found.where("calibrated").select("code_id", "threshold")
    if kept.isEmpty():
        raise ValueError("no code is calibrated")
    return kept


def decimal_grids(df: DataFrame, start: str, stop: str, step: str) -> DataFrame:
    """Each row with its grid, (i, threshold): start, start + step, ..., stop; the last value is
    ``stop`` itself. A step that is not positive or does not reach the end raises."""
    a, b, d = (F.col(c).cast("double") for c in (start, stop, step))
    n = F.rint((b - a) / d).cast("long")
    good = (d > 0) & (n >= 0) & (F.abs(a + n * d - b) <= 1e-9)
    checked = F.when(F.coalesce(good, F.lit(False)), n).otherwise(F.raise_error(F.lit("the step does not reach the end")).cast("long"))
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), checked)))
    return rows.withColumn("threshold", F.when(F.col("i") == n, b).otherwise(a + F.col("i") * d))


def grid_threshold(scores: DataFrame, keys: list[str], grid: list[float], target: float, score: str = "score") -> DataFrame:
    """The largest grid value at which the recovered share reaches ``target``; none: not
    calibrated, threshold null. One count per grid value in a single pass."""
    counts = scores.groupBy(*keys).agg(F.count("*").alias("trials"), F.array(*[F.struct(F.lit(float(g)).alias("threshold"), F.count_if(F.col(score) >= g).alias("successes")) for g in grid]).alias("g"))
    ok = F.filter("g", lambda x: x["successes"] / F.col("trials") >= target)
    best = F.array_max(ok)
    return counts.select(*keys, "trials", best["threshold"].alias("threshold"), F.coalesce(best["successes"], F.lit(0)).alias("successes"), best.isNotNull().alias("calibrated"))


def drifting_grid(start: float, stop: float, step: float) -> list[float]:
    """start + i * ((start + step) - start): the values of a half-open float range."""
    d = (start + step) - start
    n = round((stop - start) / step) + 1
    return [start + i * d for i in range(n)]


def counts_at_or_above(rows: DataFrame, keys: list[str], grid: list[float], score: str = "score") -> DataFrame:
    """Per key and grid value: rows with at least that score. Each score finds its place in
    the grid, places are counted, and a suffix sum over the grid adds them up."""
    values = F.array(*[F.lit(float(g)) for g in grid])
    place = F.size(F.filter(values, lambda g: g <= F.col(score)))
    per = rows.withColumn("_p", place).groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    grid_rows = per.select(*keys).distinct().select(*keys, F.posexplode(values).alias("_i", "threshold"))
    full = grid_rows.join(per.withColumn("_i", F.col("_p") - 1), [*keys, "_i"], "left")
    w = Window.partitionBy(*keys).orderBy(F.desc("_i"))
    return full.select(*keys, F.col("_i").alias("i"), "threshold", F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("n"))


def storage_floor(stored: DataFrame, events: DataFrame, keys: list[str], threshold: str = "threshold", score: str = "score") -> DataFrame:
    """Per key: the least and greatest stored threshold, and events below the floor."""
    floor = stored.groupBy(*keys).agg(F.min(threshold).alias("floor"), F.max(threshold).alias("ceiling"))
    below = events.join(floor, keys).groupBy(*keys).agg(F.count_if(F.col(score) < F.col("floor")).alias("below"))
    return floor.join(below, keys, "left").select(*keys, "floor", (F.col("floor") == F.col("ceiling")).alias("single"), F.coalesce("below", F.lit(0)).alias("below"))


def covered(threshold: Column, floor: Column) -> Column:
    return threshold >= floor - 1e-12


def require_covered(df: DataFrame, threshold: str = "threshold", floor: str = "floor") -> DataFrame:
    if not df.where(~covered(F.col(threshold), F.col(floor))).isEmpty():
        raise CoverageError("a threshold lies below the stored floor")
    return df


def paired_condition(inj: DataFrame, candidate: str, control: str, anchor: list[str], code: str = "code_id") -> DataFrame:
    """One row: anchors that repeat within a code, and anchors that only one code has."""
    rows = inj.where(F.col(code).isin(candidate, control))
    per = rows.groupBy(*anchor).agg(F.count_if(F.col(code) == candidate).alias("a"), F.count_if(F.col(code) == control).alias("b"))
    return per.agg(F.count_if(F.greatest("a", "b") > 1).alias("repeated"), F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias("unpaired"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("paired"))
