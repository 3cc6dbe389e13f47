import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetally.functions import signals, waveforms
from wavetally.operators import intervals, rates, robust, sequences, thresholds
from wavetally.plans import analysis, bootstrap, detection
from wavetally.sources import manifests, recordings, tables

C0, ISO = [0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50], [0.98, 0.88, 0.84, 0.82, 0.77, 0.68, 0.64, 0.62, 0.57, 0.52]
EVENTS = {("a", "c0"): [0.90, 0.70, 0.55], ("b", "c0"): [0.80, 0.61], ("a", "iso"): [0.92, 0.76, 0.63], ("b", "iso"): [0.81, 0.65, 0.51]}


@pytest.fixture
def bundle(spark):
    inj = [("a" if i < 5 else "b", c, i % 5, 100.0 + i, 4.0, 0.15, s, True) for c, ss in (("c0", C0), ("iso", ISO)) for i, s in enumerate(ss)]
    ev = [(s, "rem", c, x) for (s, c), xs in EVENTS.items() for x in xs]
    ex = [(s, "rem", c, 0.5, len(EVENTS[s, c]), h) for s, h in (("a", 1.0), ("b", 2.0)) for c in ("c0", "iso")]
    return tables.Bundle(
        spark.createDataFrame(inj, "subject_id string, code_id string, anchor_index int, anchor_seconds double, amplitude_mad double, interval_jitter_fraction double, maximum_matched_score double, engineering_check_only boolean"),
        spark.createDataFrame(ev, "subject_id string, scope string, code_id string, score double"),
        spark.createDataFrame(ex, "subject_id string, scope string, code_id string, threshold double, events long, exposure_hours double"),
        "fixture",
    )


DESIGN = analysis.Design("c0", "iso", 4.0, 0.15, (0.5, 0.8))


def test_matched_thresholds_points_and_contrast(bundle):
    got = {(r["level"], r["code_id"]): r for r in analysis.matched(bundle, DESIGN).collect()}
    assert {k: (r["threshold"], r["recoveries"]) for k, r in got.items()} == {(0.5, "c0"): (0.75, 5), (0.8, "c0"): (0.60, 8), (0.5, "iso"): (0.77, 5), (0.8, "iso"): (0.62, 8)}
    table = analysis.matched(bundle, DESIGN)
    p = {(r["level"], r["role"]): r for r in analysis.points(bundle, table, DESIGN).collect()}
    assert (p[0.8, "candidate"]["events"], p[0.8, "control"]["events"]) == (4, 5)
    assert p[0.8, "candidate"]["rate"] == pytest.approx(4 / 3) and p[0.8, "control"]["rate"] == pytest.approx(5 / 3)
    rows = analysis.contrasts(bundle, table, DESIGN, 200, 1)
    assert rows[1]["difference"] == pytest.approx(-1 / 3) and rows[1]["subjects"] == 2 and rows[1]["lower"] <= rows[1]["upper"]


def test_contrasts_repeat_and_respect_floors(bundle):
    table = analysis.matched(bundle, DESIGN)
    assert analysis.contrasts(bundle, table, DESIGN, 50, 3) == analysis.contrasts(bundle, table, DESIGN, 50, 3)
    with pytest.raises(thresholds.CoverageError):
        thresholds.require_covered(table.withColumn("floor", F.lit(0.7)))


def test_ties_of_thresholds(spark):
    df = spark.createDataFrame([("c", x) for x in (0.9, 0.8, 0.8, 0.7)], "code_id string, score double")
    exact = thresholds.exact_count(df, ["code_id"], 0.5).first()
    least = thresholds.at_least(df, ["code_id"], [0.5]).first()
    assert exact["tied"] and (least["threshold"], least["recoveries"]) == (0.8, 3)


def test_grid_thresholds(spark):
    df = spark.createDataFrame([("c", 0.91)] * 9 + [("c", 0.61)] + [("d", 0.4), ("d", 0.5)], "code_id string, score double")
    got = {r["code_id"]: r for r in thresholds.grid_threshold(df, ["code_id"], [0.6, 0.7, 0.8, 0.9, 0.925], 0.9).collect()}
    assert (got["c"]["threshold"], got["c"]["successes"]) == (0.9, 9) and not got["d"]["calibrated"] and got["d"]["threshold"] is None
    grid = thresholds.decimal_grids(spark.createDataFrame([(0.5, 0.95, 0.025)], "a double, b double, s double"), "a", "b", "s").collect()
    assert len(grid) == 19 and grid[-1]["threshold"] == 0.95
    with pytest.raises(Exception, match="reach the end"):
        thresholds.decimal_grids(spark.createDataFrame([(0.5, 0.96, 0.025)], "a double, b double, s double"), "a", "b", "s").collect()


def test_unpaired_anchors_raise(bundle):
    broken = tables.Bundle(bundle.injections.where("not (code_id = 'iso' and anchor_index = 2)"), bundle.events, bundle.exposure, "x")
    with pytest.raises(ValueError, match="paired"):
        analysis.condition(broken.injections, DESIGN)


def test_annotations_erosion_and_origin(spark):
    notes = spark.createDataFrame([("r", -0.5, 1.0, "R"), ("r", 1.0, 1.0, "R"), ("r", 1.5, 1.0, "R"), ("r", 3.0, 1.0, "W")], "record_id string, onset_s double, duration_s double, label string")
    got = intervals.from_annotations(notes, 10.0, F.lit(30), "R")
    assert sorted((r["start"], r["stop"]) for r in got.collect()) == [(0, 5), (10, 25)]
    runs = spark.createDataFrame([("r", 1, 6), ("r", 7, 9)], "record_id string, start long, stop long")
    assert [(r["start"], r["stop"]) for r in intervals.erode(runs, 1).collect()] == [(2, 5)]
    row = spark.range(1).select(intervals.aligned(F.lit(0.0), F.lit(12_000_000), F.lit(0), 2.0).alias("a"), intervals.aligned(F.lit(3.0), F.lit(None).cast("long"), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == (10.0, 3.0)


def test_flat_runs_and_gaps(spark):
    v = [0.0, 0.0, 0.0, 1.0, float("nan"), 2.0, 2.0, 2.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)], "record_id string, sample int, value double")
    got = sequences.flat_runs(df, ["record_id"], ["sample"], "value", 0.0, 3).orderBy("first").collect()
    assert [(r["first"] - 1, r["last"] - 1) for r in got] == [(0, 2), (5, 7)]
    filled = sequences.interpolate(df, ["record_id"], "sample", "value").orderBy("sample").collect()
    assert filled[4]["filled"] == 1.5


def test_trailing_scale_sees_the_past_only(spark):
    df = spark.createDataFrame([("r", t, float(t % 7)) for t in range(100)], "record_id string, t long, v double")
    got = {r["bin"]: r["mad"] for r in robust.trailing_mad(df, ["record_id"], "t", "v", 10, 50, 10).collect()}
    changed = df.withColumn("v", F.when(F.col("t") >= 60, 1000.0 * F.col("t")).otherwise(F.col("v")))
    after = {r["bin"]: r["mad"] for r in robust.trailing_mad(changed, ["record_id"], "t", "v", 10, 50, 10).collect()}
    assert 0 not in got and all(got[b] == after[b] for b in range(1, 7)) and got[9] != after[9]
    x = np.arange(10, 60) % 7
    assert got[6] == pytest.approx(signals.robust_mad(x[:50].astype(float)))


def test_rates_and_gates(spark):
    ev = spark.createDataFrame([("a", "c", 0.9)], "subject_id string, code_id string, score double")
    ex = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "subject_id string, hours double")
    got = {r["subject_id"]: (r["hours"], r["events"]) for r in rates.subject_counts(ev, ex, "c", 0.5).collect()}
    assert got == {"a": (3.0, 1), "b": (1.0, 0)}
    g = rates.gates(spark.createDataFrame([(-1.0, 0.6), (-1.0, None)], "u double, r double"), "u", "r").collect()
    assert [r["passes"] for r in g] == [True, False]


def test_labelled_seeds_agree(spark):
    got = spark.range(1).select(bootstrap.seed_column(F.lit("42|x|4.0")).alias("s")).first()["s"]
    assert int(got, 16) == bootstrap.labelled_seed(42, "x", 4.0)


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.04, 0.03))], "f string, i int, p double")
    got = {r["i"]: r["adjusted"] for r in bootstrap.holm(df, "p", ["f"], "i").collect()}
    assert [round(got[i], 6) for i in range(3)] == [0.03, 0.06, 0.06]


def edf(labels, data, rate, seconds, notes=None):
    """A small EDF file: one record a second."""
    n = len(labels) + (notes is not None)
    all_labels = labels + (["EDF Annotations"] if notes is not None else [])
    per = [rate] * len(labels) + ([60] if notes is not None else [])
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad("0", 8) + pad("x", 80) + pad("y", 80) + b"01.01.20" + b"23.59.30" + pad(256 * (n + 1), 8) + pad("", 44) + pad(seconds, 8) + pad(1, 8) + pad(n, 4)
    fields = [(all_labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), (per, 8), ([""] * n, 32)]
    head += b"".join(pad(v, w) for vs, w in fields for v in vs)
    body = b""
    for s in range(seconds):
        for x in data:
            raw = np.round((x[s * rate : (s + 1) * rate] + 1000) * 65535 / 2000 - 32768)
            body += raw.astype("<i2").tobytes()
        if notes is not None:
            tal = f"+{s}\x14\x14\0".encode() + (notes if s == 0 else b"")
            body += tal.ljust(120, b"\0")
    return head + body


def test_edf_scan(spark, tmp_path):
    x = 100 * np.sin(np.arange(300) / 10)
    (tmp_path / "a.edf").write_bytes(edf(["EOG horizontal", "EEG Fpz"], [x, x / 2], 100, 3, b"+1\x152\x14Sleep stage R\x14\0"))
    (tmp_path / "bad.edf").write_bytes(b"no header")
    heads = recordings.read_headers(spark, str(tmp_path)).collect()
    assert {(r["label"], r["status"]) for r in heads} == {("EOG horizontal", "ok"), ("EEG Fpz", "ok"), ("EDF Annotations", "ok"), (None, "error")}
    (tmp_path / "bad.edf").unlink()
    got = recordings.read_chunks(spark, str(tmp_path), ["EOG horizontal", "EEG Fpz"], 100.0, chunk=120)
    both = recordings.exploded(got.where("label = 'EOG horizontal'")).orderBy("sample").toPandas()
    assert len(both) == 300 and np.abs(both["value"] - x).max() < 0.05
    diff = recordings.exploded(recordings.subtract(got, "EOG horizontal", "EEG Fpz")).orderBy("sample").toPandas()
    assert np.abs(diff["value"] - x / 2).max() < 0.1
    assert [(r["onset_s"], r["duration_s"], r["label"]) for r in recordings.read_annotations(spark, str(tmp_path)).collect()] == [(1.0, 2.0, "Sleep stage R")]


def test_stage_text_across_midnight(spark):
    text = "free text\nSleep Stage\tPosition\tTime [hh:mm:ss]\tEvent\tDuration[s]\tLocation\n" + "".join(f"{s}\tUnknown\t{t}\t{e}\t30\tX\n" for s, t, e in (("W", "23:59:30", "SLEEP-S0"), ("R", "00:00:00", "SLEEP-REM"), ("R", "00:00:30", "SLEEP-REM"), ("R", "00:00:40", "MCAP-A1"), ("R", "00:01:00", "SLEEP-REM")))
    df = spark.createDataFrame([("n1", text, 86370, 90.0)], "record_id string, text string, start int, seconds double")
    got = recordings.read_stages(df, "record_id", "text", "start", "seconds").orderBy("onset_s").collect()
    assert [(r["onset_s"], r["stage"]) for r in got] == [(0.0, "W"), (30.0, "R"), (60.0, "R")]


def test_manifest_rules(spark):
    cols = "record_id string, subject_id string, cohort string, signal_file string, annotation_file string, signal_sha256 string, annotation_sha256 string, operation string, channel_a string, channel_b string, source_sample_rate_hz double, target_sample_rate_hz double"
    good = ("r1", "s1", "sc", "a.edf", "a.hyp", "0" * 64, "1" * 64, "identity", "EOG", "", 100.0, 100.0)
    checks = manifests.record_checks(["sc"])
    df = spark.createDataFrame([good], cols)
    assert manifests.validated(df, checks).count() == 1 and manifests.assets(df).count() == 2
    bad = spark.createDataFrame([good, ("r2", "s2", "sc", "../n1.edf", "a.hyp", "0" * 64, "1" * 64, "subtract", "EOG", "", 100.0, 0.0)], cols)
    with pytest.raises(ValueError, match="channels.*rates.*signal_file"):
        manifests.validated(bad, checks)


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0" * 64)], "file string, sha256 string")
    assert [(r["file"], r["problem"]) for r in manifests.digest_problems(want, manifests.file_digests(spark, str(tmp_path))).collect()] == [("y.bin", "missing")]


def test_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("01", "1.5"), ("02", "x")], "subject_id string, v string")
    tables.write_csv(df, str(tmp_path / "t"))
    back = tables.read_csv(spark, str(tmp_path / "t"), ["subject_id", "v"])
    assert sorted(r["subject_id"] for r in back.collect()) == ["01", "02"]
    with pytest.raises(tables.TableError, match="missing columns: w"):
        tables.read_csv(spark, str(tmp_path / "t"), ["w"])
    with pytest.raises(tables.TableError, match="no finite number"):
        tables.numeric(back, ["v"])
    with pytest.raises(Exception, match="already exists"):
        tables.write_csv(df, str(tmp_path / "t"))
    tables.write_records(df.withColumnRenamed("subject_id", "record_id"), str(tmp_path / "p"))
    done = spark.read.schema("v string, record_id string").parquet(str(tmp_path / "p"))
    todo = spark.createDataFrame([("02",), ("03",)], "record_id string")
    assert [r[0] for r in tables.unfinished(todo, done).collect()] == ["03"]
    assert tables.same_rows(df, df) and not tables.same_rows(df, df.limit(1))


def test_detection_end_to_end(spark):
    rng, w = np.random.default_rng(5), waveforms.Waveform()
    x = rng.normal(0, 5, 60_000)
    t = waveforms.render("SSLSLSLL", w)
    for at in (40_000, 50_000):
        x[at : at + len(t)] += 100 * t
    chunks = spark.createDataFrame(pd.DataFrame([("r", "EOG", i, i * 10_000, 100.0, x[i * 10_000 : (i + 1) * 10_000].tolist()) for i in range(6)], columns=["record_id", "label", "chunk_idx", "start_sample", "sample_rate_hz", "values"]))
    iv = spark.createDataFrame([("r", "eligible", 0, 60_000)], "record_id string, kind string, start long, stop long")
    sos = signals.butterworth_bandpass(100, 0.1, 8)
    banks = {"c0": detection.filtered_bank("SSLSLSLL", w, (1.0,), sos)}
    d = detection.Detector(floor=0.6, least_amplitude=2.0)
    got = detection.candidates(chunks, iv, banks, sos, d).orderBy("start_sample").collect()
    assert [round(r["start_sample"], -2) for r in got if r["score"] > 0.9] == [40_000, 50_000]
    scores = detection.injections(chunks, iv, {"c0": "SSLSLSLL"}, w, banks, sos, d, waveforms.Perturbation(jitter=0.05), 8.0, 7, most=4).collect()
    ok = [r for r in scores if r["status"] == "ok"]
    assert ok and sum(r["matched_score"] > 0.6 for r in ok) >= len(ok) - 1


def test_streaming_window_scale(spark, tmp_path):
    from wavetally.streaming.causal_gate import windowed_scale

    rows = spark.createDataFrame([("c", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(50)], "code_id string, ts string, score double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_scale(stream).writeStream.format("memory").queryName("scales").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    a, b = spark.table("scales"), windowed_scale(rows)
    assert tables.same_rows(a, b) and a.count() == 3
