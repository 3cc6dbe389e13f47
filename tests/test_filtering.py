"""Filters, gaps and frames over chunks against the one-pass kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetally.functions import signals
from wavetally.operators import filtering

CHUNKS = "record_id string, label string, chunk_idx int, start_sample long, sample_rate_hz double, values array<double>"
SOS = signals.butterworth_bandpass(100, 0.1, 8)


def chunked(spark, records, size):
    rows = [(k, "EOG", i, at, 100.0, x[at : at + size].tolist()) for k, x in records.items() for i, at in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, CHUNKS)


def whole(df, column="values"):
    rows = df.select("record_id", "chunk_idx", column).toPandas().sort_values(["record_id", "chunk_idx"])
    return {k: np.concatenate([np.asarray(v) for v in g[column]]) for k, g in rows.groupby("record_id")}


def one_loop(x, sos):
    """Both directions sample by sample, in extended precision."""
    pad = min(3 * (2 * len(sos) + 1), len(x) - 1)
    x = x.astype(np.longdouble)
    x = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for _ in range(2):
        level = x[0]
        for b0, b1, b2, _, a1, a2 in sos.astype(np.longdouble):
            to = level * (b0 + b1 + b2) / (1 + a1 + a2)
            z1 = b2 * level - a2 * to
            z0, level, out = b1 * level - a1 * to + z1, to, []
            for v in x:
                y = b0 * v + z0
                z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
                out.append(y)
            x = np.array(out)
        x = x[::-1]
    return x[pad:-pad]


@pytest.mark.parametrize("n", [32, 40, 500, 4_001])
def test_kernel_against_the_loop(n):
    x = np.random.default_rng(n).normal(0, 30, n).cumsum() / 5 + 7
    assert np.abs(signals.zero_phase(x, SOS) - one_loop(x, SOS)).max() < 1e-10


def test_sections_with_real_poles():
    sos = signals.butterworth_bandpass(100, 0.5, 40, order=1)
    x = np.random.default_rng(1).normal(size=700)
    assert np.abs(signals.zero_phase(x, sos) - one_loop(x, sos)).max() < 1e-10
    with pytest.raises(ValueError):
        signals.zero_phase(x[:31], sos)


@pytest.mark.parametrize("size", [7, 64, 333, 5_000])
def test_chunks_give_the_same_as_one_pass(spark, monkeypatch, size):
    monkeypatch.setattr(filtering, "BLOCK", 5)
    rng = np.random.default_rng(2)
    records = {k: rng.normal(0, 20, n).cumsum() / 10 for k, n in (("a", 3_001), ("b", 32), ("c", 700))}
    got = whole(filtering.zero_phase(chunked(spark, records, size), SOS))
    assert got.keys() == records.keys()
    for k, x in records.items():
        assert np.abs(got[k] - signals.zero_phase(x, SOS)).max() < 1e-9


def test_ten_million_samples_in_many_tasks(spark):
    n, size = 10_000_000, 50_000
    rows = spark.range(0, n // size, 1, 16).select(F.lit("r").alias("record_id"), F.lit("EOG").alias("label"), F.col("id").cast("int").alias("chunk_idx"), (F.col("id") * size).alias("start_sample"), F.lit(100.0).alias("sample_rate_hz"))
    wave = lambda i: 40 * F.sin(i / 37.0) + 9 * F.sin(i * i / 1e7) + F.pmod(i * 7919, F.lit(1013)) / 101.0
    chunks = rows.withColumn("values", F.transform(F.sequence(F.col("start_sample"), F.col("start_sample") + size - 1), wave))
    out = filtering.zero_phase(chunks, SOS).withColumn("task", F.spark_partition_id())
    i = np.arange(n, dtype=float)
    want = signals.zero_phase(40 * np.sin(i / 37.0) + 9 * np.sin(i * i / 1e7) + np.fmod(i * 7919, 1013) / 101.0, SOS)
    worst, seen, tasks = 0.0, 0, set()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    for r in out.select("start_sample", "values", "task").toLocalIterator():
        tasks.add(r["task"])
        worst = max(worst, np.abs(np.array(r["values"]) - want[r["start_sample"] : r["start_sample"] + size]).max())
        seen += len(r["values"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen == n and worst < 1e-9 and len(tasks) >= 8


def test_short_recordings_raise(spark):
    with pytest.raises(Exception, match="32 samples"):
        filtering.zero_phase(chunked(spark, {"a": np.ones(31)}, 10), SOS).collect()


@pytest.mark.parametrize("size", [3, 50, 400])
def test_gaps_are_filled_across_chunks(spark, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    x[:5], x[40:75], x[120], x[200:203], x[290:] = np.nan, np.nan, np.inf, np.nan, -np.inf
    got = filtering.filled(chunked(spark, {"a": x, "b": np.arange(9.0)}, size))
    assert np.abs(whole(got)["a"] - signals.fill_gaps(x)).max() < 1e-12
    assert whole(got, "lost")["a"].tolist() == (~np.isfinite(x)).tolist() and not whole(got, "lost")["b"].any()
    with pytest.raises(Exception, match="no finite sample"):
        filtering.filled(chunked(spark, {"a": np.full(20, np.nan)}, size)).collect()


def test_null_samples_are_gaps(spark):
    rows = spark.createDataFrame([("a", "EOG", 0, 0, 100.0, [1.0, None, 3.0])], CHUNKS)
    assert filtering.filled(rows).first()["values"] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("size", [10, 64, 1_000])
def test_frames_do_not_depend_on_the_cut(spark, size):
    x = np.arange(530.0)
    got = filtering.frames(chunked(spark, {"a": x}, size), 100, 30, 45).orderBy("frame").collect()
    assert [(r["frame"], r["first_sample"], r["values"][0], r["values"][-1]) for r in got] == [
        (f, max(0, 100 * f - 30), float(max(0, 100 * f - 30)), float(min(529, 100 * f + 144))) for f in range(6)
    ]


def plain_candidates(x, bank, d, eligible, invalid):
    """The whole recording at once: maxima, one for each centre, the gate, greedy suppression."""
    from wavetally.plans import detection

    rows = [(*m, detection.trailing_scale(x, invalid, m[0], d)) for m in detection.scan(x, bank, d, eligible & ~invalid, None)]
    order = lambda m: (-m[4], -abs(m[6]), abs(m[3] - 1), m[3], m[0])
    best = {}
    for m in sorted(rows, key=order):
        best.setdefault(m[2], m)
    kept = []
    for m in sorted((m for m in best.values() if m[-1] and abs(m[6]) / m[-1] >= d.least_amplitude), key=order):
        if all(abs(m[2] - k[2]) > d.radius for k in kept):
            kept.append(m)
    return sorted((m[0], m[1], m[3]) for m in kept)


@pytest.mark.parametrize(("size", "frame"), [(10_000, 60_000), (777, 4_000), (30_000, 9_001)])
def test_candidates_do_not_depend_on_chunks_and_frames(spark, size, frame):
    from wavetally.functions import waveforms
    from wavetally.plans import detection

    rng, w = np.random.default_rng(5), waveforms.Waveform()
    x = rng.normal(0, 5, 40_000)
    t = waveforms.render("SSLSLSLL", w)
    for at in (11_000, 15_990, 23_980, 31_000):
        x[at : at + len(t)] += 60 * t
    x[20_000:20_400] = np.nan
    d = detection.Detector(floor=0.45, least_amplitude=1.0, window_seconds=60.0, bin_seconds=10.0)
    banks = {"c0": detection.filtered_bank("SSLSLSLL", w, (0.9, 1.0, 1.1), SOS)}
    iv = [("a", "eligible", 0, 30_000), ("a", "eligible", 30_500, 40_000), ("a", "invalid", 20_000, 20_400)]
    got = detection.candidates(chunked(spark, {"a": x}, size), spark.createDataFrame(iv, "record_id string, kind string, start long, stop long"), banks, SOS, d, frame)
    eligible, invalid = np.ones(40_000, bool), np.zeros(40_000, bool)
    eligible[30_000:30_500], invalid[20_000:20_400] = False, True
    want = plain_candidates(signals.zero_phase(signals.fill_gaps(x), SOS), banks["c0"], d, eligible, invalid)
    assert len(want) > 5
    assert sorted((r["start_sample"], r["end_sample"], r["time_scale"]) for r in got.collect()) == want


def test_correlation_against_every_window():
    rng = np.random.default_rng(6)
    x, t = rng.normal(size=400).cumsum(), rng.normal(size=23)
    x[100:140] = 3.0
    at, score, amp, ok = signals.correlate(x, t, step=3)
    for k, a in enumerate(at):
        v = x[a : a + 23]
        want = 0.0 if np.ptp(v) == 0 else np.corrcoef(v, t)[0, 1]
        assert score[k] == pytest.approx(want, abs=1e-9) and amp[k] == pytest.approx((v @ (t - t.mean())) / ((t - t.mean()) @ (t - t.mean())))
    assert ok.all() and at[-1] == 375


@pytest.mark.parametrize(("source", "target", "size", "chunk"), [(128.0, 100.0, 700, 500), (512.0, 100.0, 333, 60_000), (100.0, 256.0, 64, 900), (100.0, 100.0, 90, 50)])
def test_resampling_does_not_depend_on_the_cut(spark, source, target, size, chunk):
    from wavetally.sources import recordings

    rng = np.random.default_rng(8)
    records = {"a": rng.normal(size=3_000).cumsum() + 40, "b": rng.normal(size=130)}
    records["a"][1_000:1_020] = np.nan
    got = recordings.resampled(chunked(spark, records, size).withColumn("sample_rate_hz", F.lit(source)), target, chunk)
    values, lost = whole(got), whole(got, "lost")
    for k, x in records.items():
        want = signals.resample(signals.fill_gaps(x), source, target)
        origin = np.minimum(len(x) - 1, np.floor(np.arange(len(want)) / target * source + 1e-9).astype(int))
        assert len(values[k]) == len(want) and np.abs(values[k] - want).max() < 1e-9
        assert lost[k].tolist() == (~np.isfinite(x))[origin].tolist()


def test_resampling_against_the_transform():
    """The same taps over the signal with zeros between its samples, by one long convolution."""
    x, up, down = np.random.default_rng(9).normal(size=400).cumsum(), 25, 32
    half = 10 * down
    taps = np.sinc(np.arange(-half, half + 1) / down) * np.kaiser(2 * half + 1, 5.0)
    line = np.linspace(x[0], x[-1], len(x))
    wide = np.zeros(len(x) * up)
    wide[::up] = x - line
    at = np.arange(-(-len(x) * up // down)) * down
    want = np.convolve(wide, taps * up / taps.sum())[half + at] + np.interp(at / up, np.arange(len(x)), line)
    assert np.abs(signals.resample(x, 128, 100) - want).max() < 1e-9
