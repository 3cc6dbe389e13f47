"""Best-fit packing of token sequences with certified bin counts.

Pieces are dealt evenly to partitions of about ``rows`` pieces. Each partition is packed
by best-fit decreasing, and dual-feasible functions over its lengths give a lower bound
of its bin count. Partitions above their bound exchange documents: their bins with free
room are dealt anew in mixed groups and packed again; a group's new packing is taken
where it needs fewer bins, so the total never grows. A group that saves nothing keeps its
gap and is mixed anew in the next round. Rounds end when no partition has a gap or a whole
round saves nothing. ``certificate`` compares the result with the bound over all pieces.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_encoder
from .common import as_batch, chunks, text_bytes, written

PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A document is its ids and
    ``end_id`` (null or empty text: that id alone); only longer ones than ``limit`` are cut."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(vocabulary_path), np.array([end_id], "<u2").tobytes()
        for b in chunks(batches, "text"):
            row, piece, length, crc = [], [], [], []
            for k, data in enumerate(encoder.texts(b.column("text").to_pylist())):
                ids = np.frombuffer(data + end, "<u2").astype("<u4")
                for p, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    row.append(k)
                    piece.append(p)
                    length.append(len(part))
                    crc.append(zlib.crc32(part) & 0xFFFFFFFF)
            ids_of = b.column("id").take(pa.array(row, pa.int64()))
            schema = pa.schema([("id", ids_of.type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            yield as_batch(schema, ids_of, piece, np.array(piece, np.int64) * limit, length, crc)

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(of, f"id {kind}, {PIECE}")


def best_fit_decreasing(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the room left in each bin. The non-empty values of
    "room left" are bits of one number, so the tightest bin is its lowest bit at or above
    the item's size."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    open_ = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = open_ >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            b = waiting[left].pop()
            if not waiting[left]:
                open_ ^= 1 << left
        else:
            b, left = len(room), limit
            room.append(limit)
        bins[k], offsets[k] = b, limit - left
        room[b] = left - size
        waiting[left - size].append(b)
        open_ |= 1 << (left - size)
    return bins, offsets, room


def lower_bound(sizes: np.ndarray, limit: int) -> float:
    return bound_of_counts(np.bincount(sizes, minlength=limit + 1).astype(np.float64), limit)


def bound_of_counts(count: np.ndarray, limit: int, most_k: int = 24) -> float:
    """count: items of each size from 0 to ``limit``. The largest bound of the plain volume and two families of dual-feasible functions:
    u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k; and f_e(x) = 1 above
    1 - e, x from e to 1 - e, 0 below e. A bin count is at least this, rounded up."""
    x = np.arange(limit + 1)
    best = float(count @ x) / limit
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % limit == 0
        best = max(best, float(count @ np.where(whole, x / limit, (k + 1) * x // limit / k)))
    # f_e by suffix sums: items above limit - e count one, items from e to limit - e their size
    above = np.concatenate((np.cumsum(count[::-1])[::-1], [0.0]))
    volume = np.concatenate((np.cumsum((count * x)[::-1])[::-1], [0.0]))
    e = np.arange(1, limit // 2 + 1)
    return max(best, float((above[limit - e + 1] + (volume[e] - volume[limit - e + 1]) / limit).max()))


def _bins(part: int, turn: int, bins: np.ndarray) -> np.ndarray:
    """Numbers of their own: below 2**19 rounds, 2**24 partitions and 2**20 bins in one."""
    return (np.int64(turn) << 44) | (np.int64(part) << 20) | bins


def pack(pieces: DataFrame, limit: int = 2048, rows: int = 20_000, rounds: int | None = None) -> DataFrame:
    """pieces: any columns and ``length`` (1 to ``limit``). Adds sequence_id, offset.

    Ties are broken by the order in the table; repeated rows are separate items; an empty
    table gives an empty table. ``rounds`` limits the exchanges (none: until one saves nothing).
    """
    pieces = written(pieces, "pieces")
    own = pieces.columns
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ")
    added = "part long, sequence_id long, offset long, free long, gap double"
    groups = max(1, -(-pieces.count() // rows))

    def first(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        sizes = t.column("length").to_numpy().astype(np.int64)
        bins, offsets, room = best_fit_decreasing(sizes, limit)
        gap = len(room) - lower_bound(sizes, limit)
        out = t.drop_columns(["part"])
        for name, v in (("part", np.full(len(sizes), part)), ("sequence_id", _bins(part, 0, bins)), ("offset", offsets), ("free", np.array(room, np.int64)[bins]), ("gap", np.full(len(sizes), gap))):
            out = out.append_column(name, pa.array(v))
        return out

    dealt = pieces.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    packed = written(dealt.groupBy("part").applyInArrow(first, f"{schema}, {added}"), "packed")
    settled = []
    for turn in itertools.count(1) if rounds is None else range(1, rounds + 1):
        # Bins with room in partitions above their bound (a fraction of a bin is a gap too).
        loose = (F.col("gap") > 0) & (F.col("free") > 0)
        some = packed.where(loose)
        n = some.count()
        if not n:
            break
        mixed = max(1, -(-n // rows))

        def again(t: pa.Table) -> pa.Table:
            turn = int(t.column("turn")[0].as_py())
            part = t.column("mix")[0].as_py()
            sizes = t.column("length").to_numpy().astype(np.int64)
            before = len(np.unique(t.column("sequence_id").to_numpy()))
            bins, offsets, room = best_fit_decreasing(sizes, limit)
            gap = len(room) - lower_bound(sizes, limit)
            out = t.drop_columns(["mix", "turn"])
            new = {"saved": np.full(len(sizes), before - len(room) if len(room) < before else 0)}
            if len(room) < before:
                new |= {"gap": np.full(len(sizes), gap), "part": np.full(len(sizes), part), "sequence_id": _bins(part, turn, bins), "offset": offsets, "free": np.array(room, np.int64)[bins]}
            for name, v in new.items():
                at = out.schema.get_field_index(name)
                out = out.append_column(name, pa.array(v)) if at < 0 else out.set_column(at, name, pa.array(v))
            return out

        redone = written(
            some.withColumn("mix", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(mixed))).withColumn("turn", F.lit(turn)).groupBy("mix").applyInArrow(again, f"{schema}, {added}, saved long"),
            "repacked",
        )
        saved = redone.where("saved > 0").limit(1).count()
        settled.append(packed.where(~loose))
        packed = redone.drop("saved")
        if not saved:
            break
    return reduce(DataFrame.unionByName, settled, packed).select(*own, "sequence_id", "offset")


def certificate(packed: DataFrame, limit: int = 2048) -> tuple[int, int]:
    """Sequences used, and the least number that any packing of these pieces needs (the bound
    over all pieces, rounded up). The driver holds one number for each length."""
    counts = packed.groupBy("length").agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).collect()
    count = np.zeros(limit + 1)
    for r in counts:
        count[r["length"]] = r["n"]
    return sum(r["bins"] for r in counts), int(np.ceil(bound_of_counts(count, limit) - 1e-9))


def pack_documents(docs: DataFrame, vocabulary_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents; other columns are ignored, null ids keep their pieces."""
    out = pack(token_pieces(docs, vocabulary_path, limit, end_id, id_col, text_col), limit)
    return out.withColumnRenamed("id", id_col)
