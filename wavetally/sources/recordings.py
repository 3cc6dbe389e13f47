"""Recordings: EDF files, stage texts, conversion to chunks of samples and intervals."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.functions import signals
from wavetally.operators import filtering
from wavetally.sources.edf import SCHEMAS, EdfSource

CHUNKS = SCHEMAS["chunks"]


def _edf(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(EdfSource)
    given = {k: v for k, v in options.items() if v is not None}
    return spark.read.format("edf").options(kind=kind, **given).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per signal of every file; unreadable files have a status and an error."""
    return _edf(spark, path, "headers")


def read_chunks(spark: SparkSession, path: str, channels: list[str] | None = None, rate: float | None = None, chunk: int = 60_000, split_bytes: int = 64 << 20) -> DataFrame:
    """Samples of the named channels in microvolts, in chunks; another rate raises. A file of
    more than ``split_bytes`` is read by several tasks."""
    return _edf(spark, path, "chunks", channels=json.dumps(channels) if channels else None, rate=rate, chunk=chunk, splitBytes=split_bytes)


def read_annotations(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    return _edf(spark, path, "notes", splitBytes=split_bytes)


def subtract(chunks: DataFrame, a: str, b: str) -> DataFrame:
    """Channel a minus channel b, chunk by chunk."""
    pick = lambda label, name: chunks.where(F.col("label") == label).select("record_id", "chunk_idx", "start_sample", "sample_rate_hz", F.col("values").alias(name))
    both = pick(a, "_a").join(pick(b, "_b"), ["record_id", "chunk_idx", "start_sample", "sample_rate_hz"])
    return both.select("record_id", F.lit(f"{a}-{b}").alias("label"), "chunk_idx", "start_sample", "sample_rate_hz", F.zip_with("_a", "_b", lambda x, y: x - y).alias("values"))


def one_channel(chunks: DataFrame, operation: str, a: str, b: str = "") -> DataFrame:
    """The channel that a manifest row names: itself, or the difference of two."""
    if operation not in ("identity", "subtract") or (operation == "subtract") != bool(b):
        raise ValueError("identity has one channel, subtract two")
    return subtract(chunks, a, b) if b else chunks.where(F.col("label") == a)


def resampled(chunks: DataFrame, target: float, chunk: int = 60_000) -> DataFrame:
    """Each recording and channel at the rate ``target``: gaps are filled across chunks, then
    frames of samples with what the filter reaches to either side are resampled apart, and
    samples that stem from a gap are marked in ``lost``. New chunks have ``chunk`` samples,
    rounded up to a whole number of the ratio's. Null values count as gaps; a recording
    without a finite sample raises. All recordings have one rate; several raise."""
    rates = [r[0] for r in chunks.select("sample_rate_hz").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("the recordings have several rates")
    schema = CHUNKS + ", lost array<boolean>"
    if not rates:
        return chunks.select("record_id", "label", "chunk_idx", "start_sample", "sample_rate_hz", "values", F.array().cast("array<boolean>").alias("lost"))
    source = rates[0]
    up, down = signals.ratio_of(source, target)
    each = -(-chunk // up)
    size, far = each * down, signals.reach(up, down)
    whole = filtering.filled(chunks)
    n, last = F.max(F.col("start_sample") + F.size("values")), F.element_at("values", -1)
    ends = whole.groupBy("record_id", "label").agg(n.alias("n"), F.min_by(F.get("values", F.lit(0)), "start_sample").alias("first_value"), F.max_by(last, "start_sample").alias("last_value"))
    ends = ends.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))))
    framed = filtering.frames(whole.withColumn("values", F.arrays_zip("values", "lost")), size, far, far)
    rows = framed.select("record_id", "label", "frame", "first_sample", F.transform("values", lambda v: v["values"]).alias("values"), F.transform("values", lambda v: v["lost"]).alias("lost"))
    rows = rows.join(ends.hint("shuffle_hash"), ["record_id", "label", "frame"])

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                start, stop = r.frame * each * up, min((r.frame + 1) * each * up, -(-r.n * up // down))
                y = signals.resampled_part(np.asarray(r.values, float), r.first_sample, r.n, (r.first_value, r.last_value), up, down, start, stop)
                origin = np.minimum(r.n - 1, np.floor(np.arange(start, stop) / target * source + 1e-9).astype(np.int64)) - r.first_sample
                out.append((r.record_id, r.label, r.frame, start, target, y, np.asarray(r.lost, bool)[origin]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(of, schema)


def exploded(chunks: DataFrame) -> DataFrame:
    """(record_id, sample, value) for operators in SQL."""
    return chunks.select("record_id", "start_sample", F.posexplode("values").alias("k", "value")).select("record_id", (F.col("start_sample") + F.col("k")).alias("sample"), "value")


def clock_seconds(c):
    """HH:MM:SS (or with dots) as seconds of the day, else null."""
    part = lambda k: F.regexp_extract(c, r"^\s*(\d{1,2})[:.](\d{2})[:.](\d{2})\s*$", k).try_cast("int")
    h, m, s = part(1), part(2), part(3)
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def read_stages(texts: DataFrame, key: str, text: str, start_clock: str, seconds: str) -> DataFrame:
    """Stage rows of RemLogic texts: the lines after the header ``Sleep Stage ... Time``,
    clock times counted from the start of the recording across midnight, within it."""
    lines = texts.select(key, start_clock, seconds, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    head = lines.where(F.col("line").startswith("Sleep Stage") & F.col("line").contains("Time")).groupBy(key).agg(F.min("line_no").alias("_head"), F.min_by("line", "line_no").alias("_names"))
    rows = lines.join(head, key).where("line_no > _head").withColumn("_f", F.split("line", "\t")).withColumn("_n", F.split("_names", "\t"))
    field = lambda name: F.trim(F.get("_f", F.array_position(F.transform("_n", lambda x: F.regexp_replace(F.trim(x), r"\s*\[.*", "")), name).cast("int") - 1))
    out = rows.select(key, field("Event").alias("event"), field("Sleep Stage").alias("stage"), clock_seconds(field("Time")).alias("_c"), field("Duration").try_cast("double").alias("duration_s"), start_clock, seconds)
    out = out.where(F.col("event").startswith("SLEEP-") & F.col("_c").isNotNull()).withColumn("onset_s", F.pmod(F.col("_c") - F.col(start_clock), F.lit(86400)).cast("double"))
    return out.where(F.col("onset_s") + F.col("duration_s") <= F.col(seconds)).select(key, "onset_s", "duration_s", "stage", "event")
