"""Extension: counts and scales of a stream that see earlier events only.

Windows are closed by a watermark; late events beyond it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scale(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("code_id",), value: str = "score", window: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per key and window: count, mean and spread of a value; works on streams and tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, window, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "spread"
    )
