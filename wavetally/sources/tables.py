"""Tables with a column contract, numeric and domain rules, result bundles, sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

STRINGS = {"subject_id", "record_id", "scope", "code_id", "signal_file", "psg_file"}

#: Columns that the tables of a result bundle must have.
REQUIRED = {
    "synthetic_recovery": ("subject_id", "code_id", "anchor_index", "anchor_seconds", "amplitude_mad", "interval_jitter_fraction", "maximum_matched_score", "engineering_check_only"),
    "background_events": ("subject_id", "scope", "code_id", "score"),
    "background_by_recording": ("subject_id", "scope", "code_id", "threshold", "events", "exposure_hours"),
}


class TableError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TableError("missing columns: " + ", ".join(missing))
    return df


def read_csv(spark: SparkSession, path: str, required) -> DataFrame:
    """Header CSV; ids stay text (no inference that would drop leading zeros)."""
    return require_columns(spark.read.option("header", True).csv(path), required)


def not_finite(c: Column) -> Column:
    number = c.try_cast("double")
    return number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))


def count_not_numeric(df: DataFrame, columns) -> DataFrame:
    """One row: values of each column that are no finite number."""
    return df.agg(*[F.count_if(not_finite(F.col(c))).alias(c) for c in columns])


def numeric(df: DataFrame, columns) -> DataFrame:
    bad = {c: n for c, n in count_not_numeric(df, columns).first().asDict().items() if n}
    if bad:
        raise TableError(f"values that are no finite number: {bad}")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def text_bool(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1")


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (a null condition breaks it)."""
    return df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])


@dataclass(frozen=True)
class Bundle:
    """Injection scores, candidates and exposure of one analysis."""

    injections: DataFrame
    events: DataFrame
    exposure: DataFrame
    label: str


def domain_rules(score: str = "score", exposure: str = "exposure_hours", events: str = "events") -> dict[str, dict[str, Column]]:
    return {
        "injections": {"score_range": F.col("maximum_matched_score").between(0, 1), "engineering_only": text_bool(F.col("engineering_check_only"))},
        "events": {"score_range": F.col(score).between(0, 1)},
        "exposure": {
            "exposure_not_negative": F.col(exposure) >= 0,
            "events_not_negative": F.col(events) >= 0,
            "no_exposure_no_events": (F.col(exposure) > 0) | (F.col(events) == 0),
        },
    }


def load_bundle(spark: SparkSession, folder: str, label: str | None = None) -> Bundle:
    """Three scans and one validation pass each; every broken rule is reported together."""
    inj = numeric(read_csv(spark, f"{folder}/synthetic_recovery.csv", REQUIRED["synthetic_recovery"]), ["anchor_index", "anchor_seconds", "amplitude_mad", "interval_jitter_fraction", "maximum_matched_score"])
    ev = numeric(read_csv(spark, f"{folder}/background_events.csv", REQUIRED["background_events"]), ["score"])
    expo = numeric(read_csv(spark, f"{folder}/background_by_recording.csv", REQUIRED["background_by_recording"]), ["threshold", "events", "exposure_hours"])
    broken = {}
    for name, df in (("injections", inj), ("events", ev), ("exposure", expo)):
        got = rule_violations(df, domain_rules()[name]).first().asDict()
        broken |= {f"{name}.{k}": n for k, n in got.items() if n}
    if broken:
        raise TableError(f"rules broken: {broken}")
    return Bundle(inj.withColumn("engineering_check_only", text_bool(F.col("engineering_check_only"))), ev, expo, label or folder.rstrip("/").rpartition("/")[2])


def strings_schema(columns, doubles=(), bools=()) -> StructType:
    kind = lambda c: DoubleType() if c in doubles else BooleanType() if c in bools else StringType()
    return StructType([StructField(c, kind(c)) for c in columns])


# ---------------------------------------------------------------- configuration and sinks
def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise TableError("a configuration is a JSON object")
    return value


def write_json(path: str, value) -> None:
    def plain(x):
        if is_dataclass(x) and not isinstance(x, type):
            return asdict(x)
        if hasattr(x, "item"):
            return x.item()
        raise TypeError(type(x).__name__)

    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(value, sort_keys=True, indent=2, default=plain) + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    """Refuses to write over an existing table."""
    df.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def write_records(df: DataFrame, path: str, key: str = "record_id") -> None:
    """A folder for each record; only the folders of these records are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def fingerprint(settings: dict) -> str:
    """SHA-256 of the settings of a run, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def same_run(finished: DataFrame, settings: dict, column: str = "run_fingerprint") -> DataFrame:
    """Finished records, which must all stem from a run of these settings."""
    if not finished.where(~F.col(column).eqNullSafe(fingerprint(settings))).isEmpty():
        raise TableError("finished records stem from other settings")
    return finished


def unfinished(records: DataFrame, finished: DataFrame, key: str = "record_id") -> DataFrame:
    """Records that a resumed run still has to do."""
    return records.join(finished.select(key).distinct(), key, "left_anti")


def combine(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
