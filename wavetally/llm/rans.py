"""Token ids as a binary file set, coded by a static range asymmetric numeral system.

A file set in a folder has three Parquet tables:

``table``  symbol, freq: the shared frequencies, which sum to 2**SCALE;
``parts``  part, offset: ids of all documents before each range of ids;
``blocks`` a folder per part in ascending order; a row is an independent block of whole
           documents: their ids and lengths, the number of lanes, the 32-bit words, the
           checkpoints, and a checksum of both.

Within a block, lane j codes ids j, j + lanes, ... A checkpoint holds, after every STEPS
rows of lanes, the lane states and how many words were read, so segments decode apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_encoder
from .common import as_batch, chunks, drop_written, new_path, text_bytes, written

SCALE, LOW = 20, np.uint64(1 << 31)
LANES, STEPS, BLOCK = 1024, 256, 1 << 19
_WORD, _MASK = np.uint64(32), np.uint64((1 << SCALE) - 1)


class Table:
    """Frequencies of symbols, quantised so that every symbol that occurs has one at least."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.int64), freq.astype(np.uint64)
        cum = np.cumsum(self.freq) - self.freq
        size = int(self.symbols.max(initial=0)) + 1
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[self.symbols], self.c[self.symbols] = self.freq, cum
        self.at = np.repeat(self.symbols.astype(np.int32), self.freq.astype(np.int64))

    @staticmethod
    def of_counts(symbols: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        if not len(symbols):
            return Table(np.zeros(0, np.int64), np.zeros(0, np.int64))
        room = (1 << SCALE) - len(symbols)
        freq = 1 + np.floor(counts / counts.sum() * room).astype(np.int64)
        freq[np.argmax(freq)] += (1 << SCALE) - freq.sum()
        return Table(symbols, freq)


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES, steps: int = STEPS) -> tuple[int, bytes, bytes]:
    """Lanes used, words (little-endian 32 bit), checkpoints (per segment: words read
    before it, then its lanes' states)."""
    lanes = max(1, min(lanes, len(ids)))
    rows = -(-len(ids) // lanes)
    x, out, marks = np.full(lanes, LOW, np.uint64), [], []
    for k in reversed(range(rows)):
        s = ids[k * lanes : (k + 1) * lanes]
        y, f = x[: len(s)], t.f[s]
        full = y >= f << np.uint64(63 - SCALE)
        words = (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        y = np.where(full, y >> _WORD, y)
        q = y // f
        x[: len(s)] = (q << np.uint64(SCALE)) + (y - q * f) + t.c[s]
        out.append(words)
        if k % steps == 0:
            marks.append((k, x.copy()))
    out.reverse()
    marks.reverse()
    before = np.concatenate(([0], np.cumsum([len(w) for w in out]))).astype("<u8")
    mark = b"".join(before[k].tobytes() + states.astype("<u8").tobytes() for k, states in marks)
    return lanes, np.concatenate(out).tobytes() if out else b"", mark


def decode_segment(words: np.ndarray, marks: np.ndarray, segment: int, n: int, lanes: int, t: Table, steps: int = STEPS) -> np.ndarray:
    """The ids of one segment; needs nothing of the segments before it."""
    rows = -(-n // lanes)
    first, last = segment * steps, min(rows, (segment + 1) * steps)
    at, x = int(marks[segment, 0]), marks[segment, 1:].astype(np.uint64)
    out = np.empty(min(n, last * lanes) - first * lanes, np.int32)
    for k in range(first, last):
        width = min(lanes, n - k * lanes)
        y = x[:width]
        slot = y & _MASK
        s = t.at[slot.astype(np.int64)]
        y = t.f[s] * (y >> np.uint64(SCALE)) + slot - t.c[s]
        low = y < LOW
        need = int(np.count_nonzero(low))
        if need:
            y[low] = (y[low] << _WORD) | words[at : at + need]
            at += need
        x[:width] = y
        out[(k - first) * lanes : (k - first) * lanes + width] = s
    if segment + 1 < len(marks) and (at != marks[segment + 1, 0] or (x != marks[segment + 1, 1:]).any()):
        raise ValueError("a segment did not end at the next checkpoint")
    return out


def decode_block(n: int, lanes: int, words: bytes, marks: bytes, t: Table) -> np.ndarray:
    w = np.frombuffer(words, "<u4").astype(np.uint64)
    m = np.frombuffer(marks, "<u8").reshape(-1, lanes + 1)
    return np.concatenate([decode_segment(w, m, k, n, lanes, t) for k in range(len(m))]) if n else np.zeros(0, np.int32)


def block_crc(words: bytes, marks: bytes) -> int:
    return zlib.crc32(marks, zlib.crc32(words)) & 0xFFFFFFFF


# ---------------------------------------------------------------- file sets
def encode_texts(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table in the order of ``docs``: id, tie (a number of its own for each row), n,
    ids (16-bit numbers). Null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(vocabulary_path), np.array([end_id], "<u2").tobytes()
        tie = TaskContext.get().partitionId() << 40
        for b in chunks(batches, "text", 16 << 20):  # fewer distinct pieces than in smaller ones
            data = [d + end for d in encoder.texts(b.column("text").to_pylist())]
            schema = pa.schema([("id", b.column("id").type), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
            yield as_batch(schema, b.column("id"), np.arange(tie, tie + len(data)), [len(d) // 2 for d in data], data)
            tie += len(data)

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return written(rows.mapInArrow(of, f"id {kind}, tie long, n long, ids binary"), "ids")


def write_files(encoded: DataFrame, path: str) -> None:
    """encoded: as ``encode_texts`` gives it. Documents are coded in ascending order of ids,
    null ids first, ties in the order of their numbers; token ids are shuffled, not texts."""
    spark, kind = encoded.sparkSession, encoded.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for d in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(d, "<u2"), minlength=1 << 16) if len(d) > 1 << 15 else 0
            short = b"".join(d for d in b.column(0).to_pylist() if len(d) <= 1 << 15)
            total += np.bincount(np.frombuffer(short, "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    counts = encoded.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    table = Table.of_counts(counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    rows = [(int(s), int(f)) for s, f in zip(table.symbols, table.freq, strict=True)]
    spark.createDataFrame(rows, "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.symbols, table.freq.astype(np.int64)))  # at most 65536 rows

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, start, size, schema = Table(*shared.value), [], 0, 0, None
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[2] for r in held), "<u2").astype(np.int64)
            lanes, words, marks = encode_block(ids, t)
            return as_batch(schema, [part], [start], [len(ids)], [[r[0] for r in held]], [[r[1] for r in held]], [lanes], [words], [marks], [block_crc(words, marks)])

        for b in batches:
            schema = pa.schema(
                [("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(b.column(0).type)), ("lens", pa.list_(pa.int64())), ("lanes", pa.int32()), ("words", pa.binary()), ("marks", pa.binary()), ("crc", pa.int64())]
            )
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= BLOCK:
                    yield block()
                    held, start, size = [], start + size, 0
                held.append(row)
                size += row[1]
        if held:
            yield block()

    ordered = encoded.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "n", "ids")
    made = ordered.mapInArrow(blocks, f"part int, start long, n long, ids array<{kind}>, lens array<long>, lanes int, words binary, marks binary, crc long")
    made.sortWithinPartitions("part", "start").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    # One row for each range of ids, of which there are at most as many as shuffle partitions.
    sizes = []
    if rows:
        sizes = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).astype(np.int64).tolist()
    spark.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets, strict=False)], "part int, offset long").coalesce(1).write.parquet(f"{path}/parts")


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens and
    ids_crc32, from the decoded files. A wrong checksum or checkpoint raises."""
    rows = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks") if rows else None
    if blocks is None:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(*shared.value)
        for b in batches:
            for k in range(b.num_rows):
                r = {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}
                words, marks = r["words"].as_py(), r["marks"].as_py()
                if block_crc(words, marks) != r["crc"].as_py():
                    raise ValueError("a block's checksum is wrong")
                ids = decode_block(r["n"].as_py(), r["lanes"].as_py(), words, marks, t).astype("<u4")
                lens = np.array(r["lens"].as_py(), np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n : e]) & 0xFFFFFFFF for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                part = pa.array([r["part"].as_py()] * len(lens), pa.int32())
                id_values = r["ids"].values
                yield pa.RecordBatch.from_arrays(
                    [id_values, part, pa.array(r["start"].as_py() + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names=["id", "part", "start", "n", "crc"]
                )

    found = blocks.select("part", "start", "n", "ids", "lens", "lanes", "words", "marks", "crc").mapInArrow(of, f"id {kind}, part int, start long, n long, crc long")
    parts = spark.read.parquet(f"{path}/parts").withColumnRenamed("part", "p")
    return found.join(parts, F.col("part") == F.col("p")).select(
        F.col("id").alias(id_col), (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def store(docs: DataFrame, vocabulary_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes, codes and writes ``docs``; returns the folder of the file set. An empty
    table gives an empty file set; other columns are not read."""
    encoded = encode_texts(docs, vocabulary_path, end_id, id_col, text_col)
    path = path or new_path(docs.sparkSession, "ids-files")
    write_files(encoded, path)
    drop_written(encoded)
    return path
