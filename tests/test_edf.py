"""The EDF source by splits: equal for any cut, and only what is asked for is decoded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.sources import edf, recordings


def file_of(labels, data, rates, seconds, notes=None, digital=None, records=None, units=None):
    """An EDF file with one data record a second; ``notes``: bytes of each record's list."""
    n = len(labels) + (notes is not None)
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad("0", 8) + pad("x", 80) + pad("y", 80) + b"01.01.20" + b"23.59.30" + pad(256 * (n + 1), 8) + pad("", 44) + pad(seconds if records is None else records, 8) + pad(1, 8) + pad(n, 4)
    per, more = [*rates, *([60] if notes is not None else [])], [""] * n
    low, high = digital or ([-32768] * n, [32767] * n)
    fields = [([*labels, *([edf.NOTES] if notes is not None else [])], 16), (more, 80), (units or ["uV"] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), (low, 8), (high, 8), (more, 80), (per, 8), (more, 32)]
    body = []
    for s in range(seconds):
        body += [np.round((x[s * r : (s + 1) * r] + 1000) * 65535 / 2000 - 32768).astype("<i2").tobytes() for x, r in zip(data, rates, strict=True)]
        if notes is not None:
            body.append(notes[s].ljust(120, b"\0"))
    return head + b"".join(pad(v, w) for vs, w in fields for v in vs) + b"".join(body)


def joined(df, label):
    rows = sorted((r["chunk_idx"], r["start_sample"], r["values"]) for r in df.where(df.label == label).collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    return np.concatenate([r[2] for r in rows]), [r[1] for r in rows]


@pytest.mark.parametrize(("split", "chunk"), [(1 << 30, 1_000), (9_000, 1_000), (700, 64), (5_000, 37), (20_000, 100_000)])
def test_any_split_gives_the_same_chunks(spark, tmp_path, split, chunk):
    x = [200 * np.sin(np.arange(60 * r) / 9 + r) for r in (100, 25)]
    notes = [f"+{s}\x14\x14\0".encode() + (f"+{s}.5\x152\x14stage {s}\x14\0".encode() if s % 7 == 0 else b"") for s in range(60)]
    (tmp_path / "a.edf").write_bytes(file_of(["EOG", "EEG"], x, [100, 25], 60, notes))
    got = recordings.read_chunks(spark, str(tmp_path), chunk=chunk, split_bytes=split)
    size = (tmp_path / "a.edf").stat().st_size
    assert got.rdd.getNumPartitions() == -(-size // split)
    for label, want in (("EOG", x[0]), ("EEG", x[1])):
        values, starts = joined(got, label)
        assert len(values) == len(want) and np.abs(values - want).max() < 0.02 and starts == list(range(0, len(want), chunk))
    found = sorted((r["onset_s"], r["duration_s"], r["label"]) for r in recordings.read_annotations(spark, str(tmp_path), split).collect())
    assert found == [(s + 0.5, 2.0, f"stage {s}") for s in range(0, 60, 7)]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    seconds, rate = 1_000, 25_000
    x = np.tile(np.sin(np.arange(rate) / 99.0) * 500, seconds)
    other = np.zeros(seconds * rate)
    (tmp_path / "b.edf").write_bytes(file_of(["EOG", "EEG"], [x, other], [rate, rate], seconds))
    assert (tmp_path / "b.edf").stat().st_size > 100_000_000 - 1_000
    got = recordings.read_chunks(spark, str(tmp_path / "b.edf"), ["EOG"], float(rate), 500_000, 16 << 20)
    assert got.rdd.getNumPartitions() >= 5
    sums = got.withColumn("task", F.spark_partition_id()).selectExpr("count(distinct chunk_idx) n", "count(distinct task) tasks", "sum(size(values)) s", "min(label) a", "max(label) b").first()
    assert (sums["n"], sums["s"], sums["a"], sums["b"]) == (50, seconds * rate, "EOG", "EOG") and sums["tasks"] >= 5


def test_channels_not_asked_for_are_not_decoded(spark, tmp_path):
    x = np.sin(np.arange(500) / 5)
    (tmp_path / "c.edf").write_bytes(file_of(["EOG", "broken"], [x, x], [50, 50], 10, digital=([-32768, 7], [32767, 7])))
    values, _ = joined(recordings.read_chunks(spark, str(tmp_path), ["EOG"]), "EOG")
    assert np.abs(values - x).max() < 0.02
    with pytest.raises(Exception, match="broken has no digital range"):
        recordings.read_chunks(spark, str(tmp_path), ["broken"]).collect()
    with pytest.raises(Exception, match="has 50.0 Hz, not 100.0"):
        recordings.read_chunks(spark, str(tmp_path), ["EOG"], 100.0).collect()


def test_units_unknown_counts_and_files_cut_short(spark, tmp_path):
    x = np.sin(np.arange(500) / 5)
    whole = file_of(["EOG"], [x], [50], 10, records=-1, units=["mV"])
    (tmp_path / "d.edf").write_bytes(whole)
    values, _ = joined(recordings.read_chunks(spark, str(tmp_path)), "EOG")
    assert len(values) == 500 and np.abs(values - 1_000 * x).max() < 20
    (tmp_path / "d.edf").write_bytes(file_of(["EOG"], [x], [50], 10)[:-130])  # the last records are not there
    assert len(joined(recordings.read_chunks(spark, str(tmp_path)), "EOG")[0]) == 400
    (tmp_path / "d.edf").write_bytes(whole[:300])
    (tmp_path / "e.edf").write_bytes(b"")
    (tmp_path / "readme.txt").write_bytes(b"no recording")
    heads = recordings.read_headers(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rpartition("/")[2], r["status"], r["error"]) for r in heads) == [("d.edf", "error", "the header is cut short"), ("e.edf", "error", "not an EDF header")]
