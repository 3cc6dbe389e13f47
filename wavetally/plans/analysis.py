"""The analysis of saved tables: matched thresholds, points, contrasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators import rates, thresholds
from wavetally.sources.manifests import digest_problems
from wavetally.sources.tables import Bundle

from .bootstrap import interval, labelled_seed, matched_bootstrap


@dataclass(frozen=True)
class Design:
    candidate: str
    control: str
    amplitude: float
    jitter: float
    levels: tuple[float, ...]
    scope: str = "rem"


def condition(inj: DataFrame, design: Design, tolerance: float = 1e-12) -> DataFrame:
    """Injections of one synthetic condition; both codes must have the same unique anchors."""
    near = lambda c, v: F.abs(F.col(c) - v) <= tolerance
    rows = inj.where(near("amplitude_mad", design.amplitude) & near("interval_jitter_fraction", design.jitter) & F.col("code_id").isin(design.candidate, design.control))
    anchor = [c for c in ("subject_id", "record_id", "anchor_index") if c in inj.columns]
    got = thresholds.paired_condition(rows, design.candidate, design.control, anchor).first()
    if got["repeated"] or got["unpaired"] or not got["paired"]:
        raise ValueError(f"anchors are not paired: {got.asDict()}")
    return rows.withColumn("score", F.col("maximum_matched_score"))


def exposure_of(bundle: Bundle, scope: str) -> DataFrame:
    """Hours of each subject and recording; they repeat for each code in the table."""
    keys = [c for c in ("subject_id", "record_id") if c in bundle.exposure.columns]
    per = bundle.exposure.where(F.col("scope") == scope).groupBy(*keys).agg(F.min("exposure_hours").alias("hours"))
    return per.groupBy("subject_id").agg(F.sum("hours").alias("hours"))


def matched(bundle: Bundle, design: Design) -> DataFrame:
    """level, role, code_id, threshold, recoveries, trials, matched_recoveries, floor."""
    t = thresholds.at_least(condition(bundle.injections, design), ["code_id"], list(design.levels))
    scoped = lambda df: df.where(F.col("scope") == design.scope)
    floor = thresholds.storage_floor(scoped(bundle.exposure), scoped(bundle.events), ["code_id"])
    t = t.join(floor, "code_id").withColumn("role", F.when(F.col("code_id") == design.candidate, "candidate").otherwise("control"))
    thresholds.require_covered(t)
    least = t.groupBy("level").agg(F.min("recoveries").alias("matched_recoveries"), F.count_distinct("trials").alias("_d"))
    return t.join(least, "level").drop("_d", "single", "below")


#: The entries of a gate document that hold frozen thresholds.
FROZEN = "sc_95_descriptive_thresholds"


def frozen_thresholds(spark: SparkSession, gate: dict) -> DataFrame:
    """The thresholds of a gate document in the form of ``matched``: a row for each role."""
    got, level = gate[FROZEN], float(gate["recovery_target"])
    n, trials = int(got["recoveries"]), int(got["trials"])
    rows = [(level, role, str(gate[role]), float(got[f"{role}_threshold"]), n, trials, n) for role in ("candidate", "control")]
    return spark.createDataFrame(rows, "level double, role string, code_id string, threshold double, recoveries long, trials long, matched_recoveries long")


def gate_design(gate: dict, scope: str = "rem") -> Design:
    """The condition that a gate document froze."""
    return Design(str(gate["candidate"]), str(gate["control"]), float(gate["amplitude_mad"]), float(gate["interval_jitter_fraction"]), (float(gate["recovery_target"]),), scope)


def verify_sources(gate: dict, digests: dict[str, str]) -> None:
    """The files that a gate document was made from, a few, must have their digests still."""
    changed = sorted(f for f, want in gate["generated_from"]["files"].items() if digests.get(f) != want)
    if changed:
        raise ValueError(f"sources differ from the gate: {', '.join(changed)}")


#: The gate documents that must be sealed before a cohort may be read.
GATES = {
    "st-placebo": ("locked_thresholds.json", "external_95_st_gate.json"),
    "st-temazepam": ("locked_thresholds.json", "temazepam_analysis_gate.json"),
    "cap-normal": ("cap_analysis_gate.json",),
}


def require_stage_gate(cohort: str, files: DataFrame, seal: DataFrame) -> None:
    """The gate documents of a cohort must exist among ``files`` (file, sha256), be part of the
    ``seal`` (file, sha256) and have its digests; a cohort without gates is open."""
    want = GATES.get(cohort, ())
    rows = files.where(F.col("file").isin(*want)).select("file", F.col("sha256").alias("now")).join(seal.select("file", "sha256"), "file", "left").collect() if want else []
    found = {r["file"]: (r["now"], r["sha256"]) for r in rows}  # some names
    for gate in want:
        if gate not in found:
            raise ValueError(f"cohort {cohort} stays sealed until the gate exists: {gate}")
        now, sealed = found[gate]
        if sealed is None:
            raise ValueError(f"the gate is not part of the seal: {gate}")
        if now != sealed:
            raise ValueError(f"the gate differs from the seal: {gate}")


def frozen_revision(files: DataFrame, seal: DataFrame) -> str:
    """The revision of a sealed set of files (file, sha256): a digest of all of them in order of
    name. Sealed files that are missing or differ raise, with their names."""
    changed = digest_problems(seal.select("file", "sha256"), files).orderBy("file").limit(20).collect()
    if changed:
        raise ValueError("not as sealed: " + ", ".join(f"{r['file']} ({r['problem']})" for r in changed))
    line = F.concat_ws(" ", "sha256", "file")
    whole = seal.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("revision"))
    return whole.first()["revision"]


def subject_differences(events: DataFrame, exposure: DataFrame, thresholds: dict[str, float], candidate: str, control: str) -> DataFrame:
    """Each subject's counts and rates of both codes and their difference (null without hours):
    the table behind a figure of subjects."""
    two = {"candidate": candidate, "control": control}
    pair = [rates.subject_counts(events, exposure, code, thresholds[code]) for code in two.values()]
    rate = lambda role: F.try_divide(f"{role}_events", "hours")
    out = rates.paired(*pair).withColumns({f"{role}_rate": rate(role) for role in two})
    return out.withColumn("difference", F.col("candidate_rate") - F.col("control_rate"))


def contrast_panels(rows: DataFrame, high: float = 0.95) -> DataFrame:
    """Contrasts (cohort, level, role, difference, lower, upper) with the label and panel that a
    figure shows them under."""
    percent = F.round(F.col("level") * 100).cast("int").cast("string")
    return rows.withColumns({"label": F.format_string("%s %s%% (%s)", "cohort", percent, "role"), "panel": F.when(F.col("level") < high, "lower-rate points").otherwise("high-recovery tests")})


def points(bundle: Bundle, table: DataFrame, design: Design) -> DataFrame:
    """Operating points with exact intervals; ``table`` may come from another cohort."""
    events = bundle.events.where(F.col("scope") == design.scope)
    keys = table.select("level", "role", "code_id", "threshold")
    return rates.with_intervals(rates.froc_points(keys, events, exposure_of(bundle, design.scope), condition(bundle.injections, design)))


def contrasts(bundle: Bundle, table: DataFrame, design: Design, replicates: int, seed: int) -> list[dict]:
    """Per level: rate difference, ratio, bootstrap interval and decision flags."""
    events, hours = bundle.events.where(F.col("scope") == design.scope), exposure_of(bundle, design.scope)
    inj, out = condition(bundle.injections, design), []
    rows = {(r["level"], r["role"]): r for r in table.collect()}  # two rows a level
    for level in design.levels:
        pair = [rates.subject_counts(events, hours, rows[level, k]["code_id"], rows[level, k]["threshold"]) for k in ("candidate", "control")]
        row = rates.contrast(rates.paired(*pair)).first().asDict()
        floors = {rows[level, k]["code_id"]: rows[level, k]["floor"] for k in ("candidate", "control")}
        reps = matched_bootstrap(inj.select("subject_id", "code_id", "score"), events, hours, design.candidate, design.control, level, replicates, seed + round(level * 1000), floors)
        low, high = interval(reps.orderBy("replicate").toPandas()["difference"].to_numpy())
        out.append({"level": level, **row, "lower": low, "upper": high, "upper_below_zero": high < 0, "ratio_small": row["ratio"] is not None and row["ratio"] <= 0.7, "seed": labelled_seed(seed, level)})
    return out
