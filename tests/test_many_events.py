"""Exact intervals cost the same for any number of events."""

import math

import pytest
from pyspark.sql import functions as F

from wavetally.functions import stats


def test_intervals_of_many_events(spark):
    x = [1, 2, 15, 16, 17, 1000, 123_456, 40_000_000]
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    for r in rows.select("x", stats._log_factorial(F.col("x")).alias("y"), stats._log_choose(F.col("x") + 3, F.lit(3.0)).alias("z")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"] + 1), rel=1e-14, abs=1e-14)
        assert r["z"] == pytest.approx(math.log(math.comb(int(r["x"]) + 3, 3)), rel=1e-14)
    one = spark.range(1).select(stats.poisson_column(F.lit(200_000), F.lit(10.0)).alias("p"), stats.clopper_pearson_column(F.lit(180_000), F.lit(200_000)).alias("c")).first()
    assert tuple(one["p"]) == pytest.approx(stats.poisson_rate(200_000, 10.0), rel=1e-11)
    assert tuple(one["c"]) == pytest.approx(stats.clopper_pearson(180_000, 200_000), rel=1e-10)
