"""Operators that spread one key over many tasks, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.functions import signals
from wavetally.operators import intervals, orderstats, robust, sequences, suppression


def spans(spark, rng, n, most):
    rows = [(k, int(s), int(s + m)) for k, s, m in zip(rng.choice(["a", "b"], n, p=[0.8, 0.2]), rng.integers(-50, 400, n), rng.integers(0, most, n), strict=True)]
    return rows, spark.createDataFrame(rows, "k string, start long, stop long")


@pytest.mark.parametrize("cell", [1, 7, 64, 1_000])
def test_interval_joins(spark, cell):
    rng = np.random.default_rng(cell)
    (a, da), (b, db) = spans(spark, rng, 60, 40), spans(spark, rng, 40, 150)
    want = sorted((k, max(s, t), min(e, f)) for k, s, e in a for m, t, f in b if k == m and max(s, t) < min(e, f) and s < e and t < f)
    got = intervals.overlap(da, db, ["k"], cell)
    assert sorted(map(tuple, got.collect())) == want
    runs = intervals.merge(db.where("start < stop"), ["k"]).select("k", "start", "stop")
    disjoint = [tuple(r) for r in runs.collect()]
    inside = sorted((k, s, e) for k, s, e in a for m, t, f in disjoint if k == m and t <= s and e <= f)
    assert sorted(map(tuple, intervals.contained(da, runs, ["k"], cell).collect())) == inside


def test_interval_join_has_no_join_on_the_key_alone(spark):
    _, a = spans(spark, np.random.default_rng(1), 5, 9)
    plan = intervals.overlap(a, a, ["k"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan.split("Join Inner")[1].split("\n")[0]


def naive(rows, radius):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3])):
        if all(abs(r[1] - x[1]) > radius or r[0] != x[0] for x in kept):
            kept.append(r)
    return sorted(kept, key=str)


@pytest.mark.parametrize(("radius", "cells"), [(0.0, 4), (0.3, 2), (3.5, 2), (10.0, 3), (10.0, 64), (500.0, 2)])
def test_suppression_in_rounds_is_the_greedy_one(spark, radius, cells):
    rng = np.random.default_rng(int(radius * 10) + cells)
    rows = [(k, float(c), float(s), i) for i, (k, c, s) in enumerate(zip(rng.choice(["a", "b"], 400), rng.integers(-40, 400, 400) / 2, rng.integers(0, 30, 400) / 30, strict=True))]
    got = suppression.suppress(spark.createDataFrame(rows, "k string, center double, score double, id long"), ["k"], radius, cells=cells)
    assert sorted(map(tuple, got.collect()), key=str) == naive(rows, radius)


def test_chains_across_all_cells(spark):
    rows = [("a", float(i), float(i), i) for i in range(300)] + [(None, 1.0, 1.0, 900), (None, 1.5, 0.5, 901), ("a", None, 2.0, 902)]
    got = suppression.suppress(spark.createDataFrame(rows, "k string, center double, score double, id long"), ["k"], 1.0, cells=2)
    assert sorted(r["id"] for r in got.collect()) == [*range(1, 300, 2), 900]
    assert suppression.suppress(spark.createDataFrame([], "k string, center double, score double, id long"), ["k"], 1.0).count() == 0


def test_suppression_of_one_key_with_a_million_candidates(spark):
    n, radius = 1_000_000, 50.0
    rows = spark.range(0, n, 1, 8).select(F.lit("r").alias("k"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50_000_000)) / 10.0).alias("center"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_003)) / 1e6).alias("score"), "id")
    got = suppression.suppress(rows, ["k"], radius, cells=256).toPandas().sort_values("center")
    assert (np.diff(got["center"]) > radius).all()
    data = rows.toPandas()
    order = np.lexsort((data["id"], -data["score"]))
    one = np.ones(n)
    want = signals.suppress(data["center"].to_numpy()[order], data["score"].to_numpy()[order], one, one, radius)
    assert sorted(got["id"]) == sorted(data["id"].to_numpy()[order][want])


@pytest.mark.parametrize("scale", [1.0, 1e-290, 1e290])
def test_quantiles_of_all_sizes_and_ties(spark, monkeypatch, scale):
    monkeypatch.setattr(orderstats, "CELLS", 8)
    rng = np.random.default_rng(7)
    groups = {"one": [3.0], "ties": [2.0] * 50, "two": [1.0, 2.0], "normal": rng.normal(size=500).tolist(), "few": rng.integers(0, 3, 200).astype(float).tolist(), "heavy": (1 / rng.random(300) ** 4).tolist()}
    rows = [(k, v * scale) for k, x in groups.items() for v in x] + [("normal", None), ("normal", float("nan")), ("normal", float("inf")), ("lost", None)]
    got = {r["k"]: r for r in orderstats.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.025, "mid": 0.5, "top": 1.0}).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        want = np.quantile(np.array(x), [0.025, 0.5, 1.0])
        assert [got[k][c] / scale for c in ("low", "mid", "top")] == pytest.approx(want.tolist(), rel=1e-12) and got[k]["n"] == len(x)


def test_mad_of_groups(spark):
    rows = [("a", v) for v in (0.0, 1.0, 2.0, float("nan"), float("inf"))] + [("b", 5.0)] * 3
    got = {r["k"]: r["mad"] for r in robust.mad(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": pytest.approx(1.4826), "b": 0.0}


def two_pointers(truth, found, tolerance):
    t, d, i, j, out = sorted(truth), sorted(found), 0, 0, []
    while i < len(t) and j < len(d):
        if abs(d[j] - t[i]) <= tolerance:
            out.append((t[i], d[j]))
            i, j = i + 1, j + 1
        elif d[j] < t[i]:
            j += 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 4.0])
def test_matches_are_one_to_one_in_time_order(spark, tolerance):
    rng = np.random.default_rng(11)
    side = lambda n: [(k, float(t)) for k, t in zip(rng.choice(["a", "b"], n), rng.integers(0, 400, n) / 4, strict=True)]
    # The four truths and detections of the known case.
    a, b = side(90) + [("k", t) for t in (10.0, 20.0, 30.0)], side(120) + [("k", t) for t in (9.8, 10.2, 20.6, 30.1)]
    got = sequences.match_events(spark.createDataFrame(a, "k string, t double"), spark.createDataFrame(b, "k string, t double"), ["k"], tolerance)
    want = sorted((k, *p) for k in ("a", "b", "k") for p in two_pointers([t for x, t in a if x == k], [t for x, t in b if x == k], tolerance))
    assert sorted(map(tuple, got.collect())) == want
    if tolerance == 0.5:
        assert sum(r[0] == "k" for r in want) == 2
