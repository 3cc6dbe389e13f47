"""Scans over cells against one window a key."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetally.operators import scans, sequences, thresholds

WIDTHS = [None, 1, 7, 1_000]


def of(width):
    return None if width is None else F.floor(F.col("t") / width)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 90, 260)
    value = rng.choice([1.0, 1.005, 2.0, float("nan"), None], 260, p=[0.4, 0.3, 0.15, 0.1, 0.05])
    data = [(k, int(a), i, None if v is None else float(v)) for i, (k, a, v) in enumerate(zip(rng.choice(["a", "b", None], 260), t, value, strict=True))]
    return spark.createDataFrame(data, "k string, t long, id long, v double")


def same(a, b):
    key = lambda df: sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("cell", WIDTHS)
def test_sums_numbers_and_previous_rows(rows, cell):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = scans.running_sums(rows, ["k"], ["t", "id"], {"s": F.col("id"), "n": F.lit(1).cast("long")}, of(cell))
    same(got, rows.withColumns({"s": F.sum("id").over(upto), "n": F.row_number().over(w).cast("long")}))
    same(scans.with_previous(rows, ["k"], ["t", "id"], F.col("v"), "p", of(cell)), rows.withColumn("p", F.lag("v").over(w)))


@pytest.mark.parametrize("cell", WIDTHS)
@pytest.mark.parametrize("width", [1, 4, 30])
def test_rolling_sums(rows, cell, width):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(0, width - 1)
    want = rows.withColumns({"s": F.sum("id").over(w), "_n": F.count("*").over(w)}).where(F.col("_n") == width).drop("_n")
    same(scans.rolling_sums(rows, ["k"], ["t", "id"], {"s": F.col("id")}, width, of(cell), frame=16), want)


@pytest.mark.parametrize("cell", WIDTHS[1:])
def test_runs_and_gaps_do_not_depend_on_cells(rows, cell):
    runs = lambda c: sequences.flat_runs(rows, ["k"], ["t", "id"], "v", 0.01, 2, c)
    assert runs(None).count() > 20
    same(runs(of(cell)), runs(None))
    one = rows.where("id % 3 = 0").groupBy("k", "t").agg(F.min("v").alias("v"))  # a row for each place
    fill = lambda c: sequences.interpolate(one, ["k"], "t", "v", c).withColumn("filled", F.round("filled", 9))
    same(fill(of(cell)), fill(None))


def test_flat_runs_by_hand(spark):
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate([5.0, 5.0, 5.0, 6.0, 6.0, float("nan"), 6.0, 6.0, 6.0, 6.0])], "k string, t long, v double")
    got = sequences.flat_runs(rows, ["k"], ["t"], "v", 0.0, 3, F.floor(F.col("t") / 2)).orderBy("first").collect()
    assert [(r["first"], r["last"], r["n"]) for r in got] == [(1, 3, 3), (7, 10, 4)]


@pytest.mark.parametrize("cell", [0.05, 1.0, 0.001])
def test_ranks_of_scores_by_cells(rows, cell):
    scores = rows.select("k", (F.pmod(F.col("id") * 7, F.lit(41)) / 50.0).alias("score")).where("k is not null")
    same(thresholds.ranked_scores(scores, ["k"], "score", cell), thresholds.ranked_scores(scores, ["k"], "score"))


def test_one_key_has_as_many_tasks_as_cells(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.lit("r").alias("k"), F.col("id").alias("t"), (F.col("id") % 5).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = scans.running_sums(df, ["k"], ["t"], {"s": F.col("v")}, F.floor(F.col("t") / 5_000)).withColumn("task", F.spark_partition_id())
    got = out.groupBy("task").agg(F.count("*").alias("n")).collect()
    last = out.orderBy(F.desc("t")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) >= 4 and max(r["n"] for r in got) < 120_000 and last["s"] == 400_000
