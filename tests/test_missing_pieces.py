"""Joins of one to one, file lookup, download manifests, gates, surfaces."""

import pytest
from pyspark.sql import functions as F

from wavetally.functions import stats
from wavetally.operators import rates
from wavetally.plans import analysis
from wavetally.sources import manifests


def test_one_to_one(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, n int")
    b = spark.createDataFrame([("y", "b"), ("x", "a"), (None, "c")], "k string, t string")
    assert sorted(map(tuple, rates.one_to_one(a, b, ["k"]).collect()), key=str) == [("x", 1, "a"), ("y", 2, "b"), (None, 3, "c")]
    for left, right, fault in ((a.union(a.limit(1)), b, "repeats: x"), (a, b.union(b.limit(1)), "repeats: y"), (a.where("n > 1"), b, "no partner: x"), (a, b.where("t = 'a'"), "no partner")):
        with pytest.raises(Exception, match=fault):
            rates.one_to_one(left, right, ["k"]).collect()


def test_lookup_by_prefixes_of_several_lengths(spark):
    records = spark.createDataFrame([("r1", "abc", ".hyp"), ("r2", "abcdefg", ".edf"), ("r3", "x", ".hyp")], "record_id string, p string, s string")
    files = spark.createDataFrame([("abcq.hyp",), ("abcdefg1.edf",), ("x.hyp",), ("x.edf",), ("ab.hyp",)], "file string")
    got = manifests.exactly_one(records, files, F.col("p"), F.col("s"), "record_id")
    assert sorted(map(tuple, got.collect())) == [("r1", "abcq.hyp"), ("r2", "abcdefg1.edf"), ("r3", "x.hyp")]
    for bad in (files.where("file != 'x.hyp'"), files.union(spark.createDataFrame([("abcz.hyp",)], "file string"))):
        with pytest.raises(ValueError, match="exactly one"):
            manifests.exactly_one(records, bad, F.col("p"), F.col("s"), "record_id")


GOOD = (" s1 ", "test", "a.edf", "A" * 64, "b.EDF ", "b" * 64)
COLUMNS = "subject_id string, split string, psg_file string, psg_sha256 string, hypnogram_file string, hypnogram_sha256 string"


@pytest.mark.parametrize(("row", "rule"), [
    (("s2", "train", "c.edf", "c" * 64, "d.edf", "d" * 64), "split"),
    (("  ", "test", "c.edf", "c" * 64, "d.edf", "d" * 64), "subject_id"),
    (("s2", "test", "../c.edf", "c" * 64, "d.edf", "d" * 64), "psg_file"),
    (("s2", "test", "c\\d.edf", "c" * 64, "d.edf", "d" * 64), "psg_file"),
    (("s2", "test", "c.edf", "c" * 63, "d.edf", "d" * 64), "psg_sha256"),
    (("s2", "test", "c.edf", "c" * 64, "d.txt", "d" * 64), "hypnogram_file"),
    (("s2", "test", "c.edf", "c" * 64, None, "d" * 64), "hypnogram_file"),
    (("s2", "test", "c.edf", "c" * 64, "d.edf", "g" * 64), "hypnogram_sha256"),
    (("s1", "development", "c.edf", "c" * 64, "d.edf", "d" * 64), "subject_repeats"),
    (("s2", "test", "a.edf", "a" * 64, "d.edf", "d" * 64), "file_repeats"),
    (("s2", "test", "a.edf", "c" * 64, "d.edf", "d" * 64), "file_conflicts"),
])
def test_download_rules(spark, row, rule):
    df = spark.createDataFrame([GOOD, row], COLUMNS)
    assert {r["rule"] for r in manifests.download_violations(df).collect()} == {rule}
    with pytest.raises(ValueError, match=rule):
        manifests.download_files(df, "all")


def test_download_files(spark):
    df = spark.createDataFrame([GOOD, ("s2", "development", "c.edf", "c" * 64, "d.edf", "d" * 64)], COLUMNS)
    got = sorted(map(tuple, manifests.download_files(df, "test").collect()))
    assert got == [("s1", "test", "hypnogram", "b.EDF", "b" * 64), ("s1", "test", "psg", "a.edf", "a" * 64)]
    assert manifests.download_files(df, "all").count() == 4
    with pytest.raises(ValueError, match="called"):
        manifests.download_files(df, "train")
    with pytest.raises(ValueError, match="no files"):
        manifests.download_files(df.where("subject_id = 's2'"), "test")


def test_inventory_and_addresses(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"abc")
    rows = manifests.inventory(spark, str(tmp_path))
    assert [(r["file"], r["bytes"]) for r in rows.collect()] == [("a.bin", 3)]
    assert "content:" not in rows._jdf.queryExecution().executedPlan().toString()
    got = manifests.routing(spark.createDataFrame([("cap-normal",), ("sleep-cassette",)], "cohort string")).orderBy("cohort").collect()
    assert [r["base_url"].partition("files/")[2] for r in got] == ["capslpdb/1.0.0", "sleep-edfx/1.0.0/sleep-cassette"]


def test_gates_and_frozen_revisions(spark):
    table = lambda rows: spark.createDataFrame(rows, "file string, sha256 string")
    seal = table([("cap_analysis_gate.json", "1"), ("code.py", "2")])
    analysis.require_stage_gate("sc", table([]), seal)
    analysis.require_stage_gate("cap-normal", seal, seal)
    for files, sealed, fault in ((table([("code.py", "2")]), seal, "until the gate exists"), (seal, seal.where("file = 'code.py'"), "not part of the seal"), (table([("cap_analysis_gate.json", "9")]), seal, "differs")):
        with pytest.raises(ValueError, match=fault):
            analysis.require_stage_gate("cap-normal", files, sealed)
    first = analysis.frozen_revision(seal.orderBy(F.desc("file")), seal)
    assert first == analysis.frozen_revision(seal, seal.orderBy(F.desc("file"))) and len(first) == 64
    with pytest.raises(ValueError, match=r"cap_analysis_gate.json \(mismatch\), code.py \(missing\)"):
        analysis.frozen_revision(table([("cap_analysis_gate.json", "3")]), seal)


def test_recovery_by_each_codes_threshold(spark):
    rows = [("a", 4.0, 0.1, s) for s in (0.9, 0.5, 0.4)] + [("b", 4.0, 0.1, 0.5), ("c", 4.0, 0.1, 0.5)]
    inj = spark.createDataFrame(rows, "code_id string, amplitude_mad double, interval_jitter_fraction double, maximum_matched_score double")
    got = {r["code_id"]: r for r in rates.recovery_surface(inj, spark.createDataFrame([("a", 0.5), ("b", 0.6)], "code_id string, threshold double")).collect()}
    assert got.keys() == {"a", "b"} and (got["a"]["recovered"], got["a"]["trials"], got["b"]["recovered"]) == (2, 3, 0)
    assert (got["a"]["lower"], got["a"]["upper"]) == pytest.approx(stats.clopper_pearson(2, 3))
