"""Order statistics of few keys with many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators import orderstats, robust


def test_order_statistics_of_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=400), "b": rng.normal(size=30), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "k string, x double")
    for few, hot in ((100, 10), (0, 100), (0, 10_000)):  # broadcast whole, hot keys only, none
        monkeypatch.setattr(orderstats, "FEW", few)
        monkeypatch.setattr(orderstats, "HOT", hot)
        found = orderstats.quantiles(df, ["k"], "x", {"low": 0.1, "mid": 0.5})
        got = {r["k"]: (r["n"], r["low"], r["mid"]) for r in found.collect()}
        assert got == {k: (len(x), pytest.approx(np.quantile(x, 0.1)), pytest.approx(np.median(x))) for k, x in groups.items()}
        scale = {r["k"]: r["mad"] for r in robust.mad(df, ["k"], "x").collect()}
        assert scale == {k: pytest.approx(1.4826 * np.median(np.abs(x - np.median(x)))) for k, x in groups.items()}
    monkeypatch.setattr(orderstats, "FEW", 100)
    plan = orderstats.beside(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
