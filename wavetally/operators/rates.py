"""Counts per subject, rates per hour of exposure, contrasts of two codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.functions.stats import clopper_pearson_column, poisson_column


def subject_counts(events: DataFrame, exposure: DataFrame, code: str, threshold: float, subject: str = "subject_id", hours: str = "hours") -> DataFrame:
    """Every subject of the exposure table, with its hours and its events at or above the
    threshold, none as zero."""
    per = exposure.groupBy(subject).agg(F.sum(hours).alias("hours"))
    n = events.where((F.col("code_id") == code) & (F.col("score") >= threshold)).groupBy(subject).agg(F.count("*").alias("events"))
    return per.join(n, subject, "left").select(subject, "hours", F.coalesce("events", F.lit(0)).alias("events"))


def froc_points(thresholds: DataFrame, events: DataFrame, exposure: DataFrame, injections: DataFrame) -> DataFrame:
    """thresholds: level, role, code_id, threshold. One row for each: recoveries, trials,
    events, hours of all subjects, events per hour. The table of thresholds has a row for
    each operating point and code."""
    hours = exposure.agg(F.sum("hours").alias("hours"))
    keys = ["level", "role", "code_id", "threshold"]
    ev = thresholds.join(events.select("code_id", "score"), "code_id", "left").groupBy(*keys).agg(F.count_if(F.col("score") >= F.col("threshold")).alias("events"))
    inj = thresholds.join(injections.select("code_id", F.col("score").alias("s")), "code_id").groupBy(*keys).agg(F.count_if(F.col("s") >= F.col("threshold")).alias("recoveries"), F.count("*").alias("trials"))
    return ev.join(inj, keys).crossJoin(hours).withColumn("rate", F.try_divide("events", "hours"))  # hours is one row


def with_intervals(points: DataFrame) -> DataFrame:
    out = points.withColumn("cp", clopper_pearson_column(F.col("recoveries"), F.col("trials"))).withColumn("po", poisson_column(F.col("events"), F.col("hours")))
    return out.select(*points.columns, F.col("cp.lower").alias("recovery_lower"), F.col("cp.upper").alias("recovery_upper"), F.col("po.lower").alias("rate_lower"), F.col("po.upper").alias("rate_upper"), F.col("po.one_sided_upper").alias("rate_one_sided_upper"))


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables beside one another. A key that repeats on a side, or that the other
    side lacks, raises when the rows are made; no job runs before. Null keys are a key."""
    sides = []
    for k, df in enumerate((a, b)):
        rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
        sides.append(df.groupBy(*keys).agg(F.first(rest).alias(f"_r{k}"), F.count("*").alias(f"_n{k}")).select(*[F.col(c).alias(f"_{k}_{c}") for c in keys], f"_r{k}", f"_n{k}"))
    on = [sides[0][f"_0_{c}"].eqNullSafe(sides[1][f"_1_{c}"]) for c in keys]
    both = sides[0].join(sides[1], on, "full_outer")
    fault = F.when(F.col("_n0").isNull() | F.col("_n1").isNull(), F.lit("a key has no partner: ")).when((F.col("_n0") > 1) | (F.col("_n1") > 1), F.lit("a key repeats: "))
    named = F.concat_ws("|", *[F.coalesce(F.col(f"_0_{c}").cast("string"), F.col(f"_1_{c}").cast("string")) for c in keys])
    # The keys carry the check, so that no plan can leave it out.
    checked = [F.when(fault.isNotNull(), F.raise_error(F.concat(fault, named)).cast(a.schema[c].dataType)).otherwise(F.col(f"_0_{c}")).alias(c) for c in keys]
    return both.select(*checked, "_r0.*", "_r1.*")


def paired(candidate: DataFrame, control: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Counts of two codes side by side, one row per subject; subjects must agree and stand once
    in each table."""
    a = candidate.select(subject, F.col("hours"), F.col("events").alias("candidate_events"))
    return one_to_one(a, control.select(subject, F.col("events").alias("control_events")), [subject])


def recovery_surface(injections: DataFrame, thresholds: DataFrame, score: str = "maximum_matched_score") -> DataFrame:
    """code_id, amplitude, jitter: the share of trials at or above the code's own threshold, with
    its exact interval. thresholds: (code_id, threshold), one row a code; other codes go."""
    keys = ["code_id", "amplitude_mad", "interval_jitter_fraction"]
    rows = injections.select(*keys, F.col(score).alias("_s")).join(thresholds.select("code_id", "threshold"), "code_id")
    out = rows.groupBy(*keys, "threshold").agg(F.count_if(F.col("_s") >= F.col("threshold")).alias("recovered"), F.count("*").alias("trials"))
    out = out.withColumn("fraction", F.col("recovered") / F.col("trials")).withColumn("_c", clopper_pearson_column(F.col("recovered"), F.col("trials")))
    return out.select(*keys, "threshold", "recovered", "trials", "fraction", F.col("_c.lower").alias("lower"), F.col("_c.upper").alias("upper"))


def contrast(pairs: DataFrame) -> DataFrame:
    """One row: events, hours, rates, their difference and ratio (null without control)."""
    sums = pairs.agg(F.sum("candidate_events").alias("candidate_events"), F.sum("control_events").alias("control_events"), F.sum("hours").alias("hours"), F.count("*").alias("subjects"))
    c, k = F.try_divide("candidate_events", "hours"), F.try_divide("control_events", "hours")
    return sums.withColumns({"candidate_rate": c, "control_rate": k, "difference": c - k, "ratio": F.try_divide(c, k)})


def gates(df: DataFrame, upper: str, ratio: str, most_ratio: float = 0.7) -> DataFrame:
    """Decision flags of each row; a missing ratio fails its gate."""
    a, b = F.col(upper) < 0, F.coalesce(F.col(ratio) <= most_ratio, F.lit(False))
    return df.withColumns({"upper_below_zero": a, "ratio_small": b, "passes": a & b})
