"""Manifests by file names, frozen and development thresholds, the injection grid, bootstraps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetally.functions import signals, waveforms
from wavetally.operators import sequences, thresholds
from wavetally.plans import analysis, bootstrap, detection
from wavetally.sources import manifests, recordings, tables


def test_split_routing_and_checksums(spark):
    rows = spark.createDataFrame([("a", "dev", "cap1"), ("b", "dev", "sc"), ("b", "test", "sc")], "subject_id string, split string, cohort string")
    assert manifests.select_split(rows, "dev").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        manifests.select_split(rows.unionAll(rows), "dev")
    assert {r["cohort"]: (r["dataset"], r["folder"]) for r in manifests.routing(rows).collect()} == {"cap1": ("cap", "cap"), "sc": ("edfx", "edfx/sc")}
    text = spark.createDataFrame([("AB  x/a.edf",), ("cd *b.edf",), ("",)], "value string")
    assert {tuple(r) for r in manifests.checksum_list(text).collect()} == {("ab", "x/a.edf"), ("cd", "b.edf")}
    with pytest.raises(ValueError, match="repeats"):
        manifests.checksum_list(text.unionAll(text))


def test_exactly_one_and_build(spark):
    records = spark.createDataFrame([("SC4121E0", "s1", "c", "SC4121E0-PSG.edf")], "record_id string, subject_id string, cohort string, signal_file string")
    files = spark.createDataFrame([("SC4121EC-Hypnogram.edf",), ("SC4122EC-Hypnogram.edf",)], "file string")
    one = manifests.exactly_one(records, files, F.substring("record_id", 1, 6), "-Hypnogram.edf", "record_id")
    assert [tuple(r) for r in one.collect()] == [("SC4121E0", "SC4121EC-Hypnogram.edf")]
    with pytest.raises(ValueError, match="exactly one"):
        manifests.exactly_one(records, files, F.substring("record_id", 1, 5), "-Hypnogram.edf", "record_id").count()
    full = records.join(one.withColumnRenamed("file", "annotation_file"), "record_id")
    sums = spark.createDataFrame([("SC4121E0-PSG.edf", "0a"), ("SC4121EC-Hypnogram.edf", "1b")], "file string, sha256 string")
    subjects = spark.createDataFrame([("s1", 40)], "subject_id string, age int")
    row = manifests.build_manifest(full, sums, subjects).first()
    assert (row["signal_sha256"], row["annotation_sha256"], row["age"]) == ("0a", "1b", 40)
    with pytest.raises(ValueError, match="no checksum"):
        manifests.build_manifest(full, sums.limit(1), subjects)


def test_names_and_roles(spark):
    paths = ["sleep-cassette/SC4121E0-PSG.edf", "sleep-cassette/SC4111E0-PSG.edf", "sleep-telemetry/ST7011J0-PSG.edf", "sleep-telemetry/ST7012J0-PSG.edf", "x/SC4121E0-PSG.edf", None]
    files = manifests.named(spark.createDataFrame([(p,) for p in paths], "file string"))
    assert {(r["study"], r["subject"], r["night"]) for r in files.collect()} == {("sc", 12, 1), ("sc", 11, 1), ("st", 1, 1), ("st", 1, 2)}
    nights = spark.createDataFrame([(12, 1)], "subject int, night int")
    placebo = spark.createDataFrame([(1, 2)], "subject int, placebo_night int")
    got = manifests.classified(files, nights, placebo)
    assert {(r["participant_id"], r["night"], r["analysis_role"], r["condition"]) for r in got.collect()} == {("SC12", 1, "primary_confirmation", "spontaneous"), ("ST01", 1, "exploratory_drug_condition", "temazepam"), ("ST01", 2, "threshold_transport", "placebo")}
    assert manifests.require_counts(got, {"primary_confirmation": (1, 1)}).count() == 3
    with pytest.raises(ValueError, match="differ from the plan"):
        manifests.require_counts(got, {"primary_confirmation": (2, 1)})
    with pytest.raises(ValueError, match="missing"):
        manifests.classified(files, nights.limit(0), placebo)


def test_exact_recovery_errors(spark):
    df = spark.createDataFrame([("c", x) for x in (0.9, 0.8, 0.8, 0.7)], "code_id string, score double")
    with pytest.raises(thresholds.UnattainableError):
        thresholds.exact_or_raise(df, ["code_id"], 0.5)
    assert thresholds.exact_or_raise(df, ["code_id"], 0.75).first()["threshold"] == 0.8
    with pytest.raises(ValueError, match="under one"):
        thresholds.exact_or_raise(df, ["code_id"], 0.1)
    for bad in (df.limit(0), df.withColumn("score", F.lit(1.5)), df.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="finite"):
            thresholds.exact_or_raise(bad, ["code_id"], 0.5)


def test_development_and_frozen_thresholds(spark):
    cols = "code_id string, amplitude_mad double, interval_jitter_fraction double, maximum_matched_score double"
    rows = [("a", 4.0, 0.1, s) for s in (0.9, 0.8, 0.7)] + [("b", 4.0, 0.1, 0.1), ("a", 2.0, 0.1, 0.0)]
    df = spark.createDataFrame(rows, cols)
    got = thresholds.development_thresholds(df, ["a", "b"], [0.5, 0.6, 0.7, 0.8], 0.9, 4.0, 0.1)
    assert [tuple(r) for r in thresholds.calibrated_only(got).collect()] == [("a", 0.7)]
    with pytest.raises(ValueError, match="no trials"):
        thresholds.development_thresholds(df, ["a", "z"], [0.5], 0.9, 4.0, 0.1)
    with pytest.raises(ValueError, match="calibrated"):
        thresholds.calibrated_only(got.where("code_id = 'b'"))
    gate = {"recovery_target": 0.95, "candidate": "a", "control": "b", "amplitude_mad": 4, "interval_jitter_fraction": 0.1, "generated_from": {"files": {"x": "1"}}, analysis.FROZEN: {"recoveries": 19, "trials": 20, "candidate_threshold": 0.5, "control_threshold": 0.6}}
    frozen = {r["role"]: (r["code_id"], r["threshold"], r["recoveries"]) for r in analysis.frozen_thresholds(spark, gate).collect()}
    assert frozen == {"candidate": ("a", 0.5, 19), "control": ("b", 0.6, 19)} and analysis.gate_design(gate).levels == (0.95,)
    analysis.verify_sources(gate, {"x": "1"})
    with pytest.raises(ValueError, match="x"):
        analysis.verify_sources(gate, {"x": "2"})


def test_invalid_runs(spark):
    v = [1.0, None, 2.0, 2.0, 2.0, 3.0, float("inf"), 4.0, 4.0]
    df = spark.createDataFrame([("r", i + 10, x) for i, x in enumerate(v)], "record_id string, sample long, value double")
    got = sequences.invalid_runs(df, ["record_id"], "sample", "value", 3)
    assert sorted((r["start"], r["stop"]) for r in got.collect()) == [(11, 15), (16, 17)]
    assert sequences.invalid_runs(df.limit(0), ["record_id"], "sample", "value", 3).count() == 0


def test_resampled_difference(spark):
    t = np.arange(512 * 20) / 512
    a, b = 3 * np.sin(2 * np.pi * t) + 1, np.full(len(t), 1.0)
    a[5000:5100] = np.nan
    rows = [("r", label, i, i * 2048, 512.0, x[i * 2048 : (i + 1) * 2048].tolist()) for label, x in (("A", a), ("B", b)) for i in range(5)]
    chunks = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in recordings.CHUNKS.split(", ")]), recordings.CHUNKS)
    got = recordings.resampled(recordings.one_channel(chunks, "subtract", "A", "B"), 100.0, chunk=700).orderBy("chunk_idx").collect()
    y, lost = np.concatenate([r["values"] for r in got]), np.concatenate([r["lost"] for r in got])
    assert len(y) == 2000 and [len(r["values"]) for r in got] == [700, 700, 600]
    want = 3 * np.sin(2 * np.pi * np.arange(2000) / 100)
    assert np.abs(y - want)[100:900].max() < 0.05 and set(np.flatnonzero(lost)) == {k for k in range(2000) if 5000 <= int(k * 5.12 + 1e-9) < 5100}
    with pytest.raises(ValueError):
        recordings.one_channel(chunks, "identity", "A", "B")


def test_injection_grid(spark):
    rng, w = np.random.default_rng(5), waveforms.Waveform()
    x = rng.normal(0, 5, 60_000)
    chunks = spark.createDataFrame(pd.DataFrame([("r", "EOG", 0, 0, 100.0, x.tolist())], columns=[c.split()[0] for c in recordings.CHUNKS.split(", ")]))
    iv = spark.createDataFrame([("r", "eligible", 0, 60_000)], "record_id string, kind string, start long, stop long")
    sos, rhythms = signals.butterworth_bandpass(100, 0.1, 8), {"c0": "SSLSLSLL", "iso": "EEEEEEEE"}
    banks = {k: detection.filtered_bank(r, w, (1.0,), sos) for k, r in rhythms.items()}
    run = lambda seed: detection.injection_grid(chunks, iv, rhythms, w, banks, sos, detection.Detector(step=10), waveforms.Perturbation(), [1.0, 20.0], [0.0, 0.2], seed, most=3).toPandas()
    got = run(7)
    assert (got.groupby(["code_id", "amplitude_mad", "interval_jitter_fraction"]).size() == got["anchor_index"].nunique()).all() and got.groupby("anchor_index")["anchor_sample"].nunique().max() == 1
    clear = got[(got["amplitude_mad"] == 20.0) & (got["interval_jitter_fraction"] == 0.0)]
    assert clear["matched_score"].min() > 0.9 and ((clear["matched_start"] - clear["anchor_sample"]).abs() <= 75).all()
    assert clear["matched_score"].mean() > got[got["amplitude_mad"] == 1.0]["matched_score"].mean()
    with pytest.raises(Exception, match="no anchor"):
        detection.injection_grid(chunks, iv.withColumn("stop", F.lit(5).cast("long")), rhythms, w, banks, sos, detection.Detector(), waveforms.Perturbation(), [1.0], [0.0], 7).count()


def test_bootstraps_against_plain_loops(spark):
    hours = {"a": 1.0, "b": 2.0, "c": 0.5}
    pairs = spark.createDataFrame([(s, h, n, n + 1) for (s, h), n in zip(hours.items(), (4, 1, 7), strict=True)], "subject_id string, hours double, candidate_events long, control_events long")
    draws = np.random.default_rng(3).integers(0, 3, (200, 3))
    plain = [sum(-1 for k in d) / sum(list(hours.values())[k] for k in d) for d in draws]
    assert bootstrap.pilot_interval(pairs, 200, 3) == pytest.approx(bootstrap.interval(np.array(plain)))

    rng = np.random.default_rng(0)
    inj = [(s, c, round(float(rng.random()), 2)) for s in hours for c in ("x", "y") for _ in range(6)]
    ev = [(s, c, round(float(rng.random()), 2)) for s in hours for c in ("x", "y") for _ in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "subject_id string, code_id string, score double")
    expo = spark.createDataFrame(list(hours.items()), "subject_id string, hours double")
    got = bootstrap.matched_bootstrap(frame(inj), frame(ev), expo, "x", "y", 0.5, 40, 9, {}).orderBy("replicate").collect()
    names = sorted(hours)
    for r, draw in zip(got, np.random.default_rng(9).integers(0, 3, (40, 3)), strict=True):
        total = sum(hours[names[k]] for k in draw)
        for role, code in (("candidate", "x"), ("control", "y")):
            scores = sorted((s for k in draw for who, c, s in inj if who == names[k] and c == code), reverse=True)
            t = scores[int(np.ceil(0.5 * len(scores) - 1e-12)) - 1]
            n = sum(s >= t for k in draw for who, c, s in ev if who == names[k] and c == code)
            assert (r[f"{role}_threshold"], r[f"{role}_events"]) == (t, n)
            assert r[f"{role}_recovery"] == pytest.approx(sum(s >= t for s in scores) / len(scores)) and r[f"{role}_rate"] == pytest.approx(n / total)
        assert r["difference"] == pytest.approx(r["candidate_rate"] - r["control_rate"])
    again = bootstrap.matched_bootstrap(frame(inj), frame(ev), expo, "x", "y", 0.5, 40, 9, {}, per_task=3).orderBy("replicate").collect()
    assert again == got  # whatever the tasks
    one = bootstrap.matched_interval(frame(inj), frame(ev), expo, "x", "y", 0.5, 40, 9, {}).first()
    low, high = np.quantile([r["difference"] for r in got], [0.025, 0.975])
    assert (one["lower"], one["upper"], one["replicates"]) == (pytest.approx(low), pytest.approx(high), 40)
    scores = sorted((s for _, c, s in inj if c == "x"), reverse=True)
    assert one["candidate_threshold"] == scores[8] and one["candidate_events"] == sum(s >= scores[8] for _, c, s in ev if c == "x")
    counter = lambda tasks: bootstrap.matched_bootstrap(frame(inj), frame(ev), expo, "x", "y", 0.5, 30, 9, {}, "counter", tasks).orderBy("replicate").collect()
    assert counter(3) == counter(30) and len({r["difference"] for r in counter(30)}) > 5
    with pytest.raises(Exception, match="floor"):
        bootstrap.matched_bootstrap(frame(inj), frame(ev), expo, "x", "y", 0.5, 40, 9, {"x": 2.0}).count()


def test_figure_tables_and_runs(spark):
    ev = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.2), ("b", "y", 0.9)], "subject_id string, code_id string, score double")
    expo = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "subject_id string, hours double")
    got = {r["subject_id"]: (r["candidate_events"], r["control_events"], r["difference"]) for r in analysis.subject_differences(ev, expo, {"x": 0.5, "y": 0.5}, "x", "y").collect()}
    assert got == {"a": (1, 0, 0.5), "b": (0, 1, None)}
    rows = spark.createDataFrame([("SC", 0.9, "primary"), ("ST", 0.95, "external")], "cohort string, level double, role string")
    assert {(r["label"], r["panel"]) for r in analysis.contrast_panels(rows).collect()} == {("SC 90% (primary)", "lower-rate points"), ("ST 95% (external)", "high-recovery tests")}
    done = spark.createDataFrame([("r1", tables.fingerprint({"a": 1, "b": 2}))], "record_id string, run_fingerprint string")
    assert tables.same_run(done, {"b": 2, "a": 1}).count() == 1
    with pytest.raises(tables.TableError, match="other settings"):
        tables.same_run(done, {"a": 2, "b": 2})
