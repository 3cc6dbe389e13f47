"""Shared helpers: work tables in the cluster's shared folder, text columns, batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every operator of this folder.
SPACES = " \t\n\x0b\x0c\r"


#: Deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in
    local mode, in which all tasks see the driver's disk; on a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/wavetally/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, read back. Nothing reads
    the shuffles of the query again, so they go with it."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if "/wavetally/" in root:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``weight`` the number of
    ``rows`` with that key (``total`` in all). Keys with over ``1 / share`` of all rows, fewer
    than ``share`` of them, are broadcast, so that no key fills a task; the others meet in a
    shuffle. ``weight`` is dropped. ``rows`` is read twice: better a written table."""
    hot = F.col(weight) * share > total
    few, rest = table.where(hot).drop(weight), table.where(~hot).drop(weight)
    cool = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(few), on).unionByName(cool.join(rest, on))


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes, null as empty: Python then reads bytes without decoding."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def held_out(name: str = "doc_id") -> Column:
    return crc_of_id(name) % 4 == 2


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices batches so that ``column`` holds about ``most`` bytes, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) if x else 0 for x in batch.column(column).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
