"""Interval columns against the quantile functions of single numbers."""

import pytest
from pyspark.sql import functions as F

from wavetally.functions import stats


@pytest.mark.parametrize("level", [0.9, 0.95])
def test_binomial_bounds(spark, level):
    rows = [(k, n) for n in (1, 2, 7, 40, 333) for k in sorted({0, 1, n // 3, n // 2, n - 1, n}) if k >= 0] + [(2179, 2563), (3, 40_000), (39_990, 40_000)]
    df = spark.createDataFrame([*rows, (0, 0), (5, 3), (None, 4)], "k long, n long")
    got = df.withColumn("i", stats.clopper_pearson_column(F.col("k"), F.col("n"), level)).select("k", "n", "i.lower", "i.upper").collect()
    for r, want in zip(got, [stats.clopper_pearson(k, n, level) for k, n in rows], strict=False):
        assert (r["lower"], r["upper"]) == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert all(r["lower"] is None and r["upper"] is None for r in got[len(rows) :])


@pytest.mark.parametrize("level", [0.9, 0.95])
def test_poisson_bounds(spark, level):
    rows = [(k, h) for k in (0, 1, 2, 9, 100, 1_500, 20_000) for h in (0.5, 177.13)]
    df = spark.createDataFrame([*rows, (3, 0.0), (3, None)], "k long, h double")
    got = df.withColumn("i", stats.poisson_column(F.col("k"), F.col("h"), level)).select("i.*").collect()
    for r, want in zip(got, [stats.poisson_rate(k, h, level) for k, h in rows], strict=False):
        assert tuple(r) == pytest.approx(want, rel=1e-9)
    assert all(v is None for r in got[len(rows) :] for v in r)


def test_no_python_in_the_plan(spark):
    df = spark.range(3).withColumn("i", stats.clopper_pearson_column(F.col("id"), F.lit(5)))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
