"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

A window is the first ``length`` bytes of a suffix; windows are equal exactly where suffixes
agree to that depth. Groups are refined digit by digit, and what stands alone leaves after
every pass; groups that are left at full depth are the repeated windows.

The bytes of a window are not read from left to right. Its first digit is the gram of
``length / 2`` bytes with the least hash in it, the leftmost of equal ones: its anchor. Equal
windows have equal anchors at equal places, and neighbours share an anchor, so the first pass
sorts one row for a block of some fifty windows:

1. depth 100: the gram at the anchor. Blocks alone with their gram leave.
2. The whole stretch of bytes of a block: where it stands twice, all its windows are settled,
   and one of the equal blocks stands for them from here on.
3. depth 185: the bytes that the windows of a cell of 16 share. Cells alone leave.
4. depth 200: windows.

Keys are 64-bit hashes beside those of the passes before, so 128 bits at each comparison of
stretches and windows. Spark sorts, counts and joins; tasks only hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, drop_written, join_counted, text_bytes, written

U = np.uint64
#: Bytes hashed at a time (20 bits hold a place), and windows of a cell in the third pass.
BLOCK, CELL = 1 << 20, 16
_RANDOM = np.random.default_rng(12)
#: An odd random number for each byte, and the base of the rolling hash with its inverse.
BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
LIMIT = (1 << 20) + 1


def _powers(base: int, n: int = LIMIT) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, 1 << 64))
        done += more
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hashes of any stretch of one buffer of at most 1 MB."""

    up, down = _powers(BASE), _powers(INVERSE)

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours, from least keys to both sides in blocks."""
    n = len(keys) - width + 1
    grid = np.concatenate((keys, np.full(-len(keys) % width, ~U(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of up to 1 MB: (bytes, number of the text, its place in the buffer, its place in
    the text) of every text in it. Longer texts come in slices that overlap by length - 1."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple:
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        lengths = np.array([len(x[2]) for x in held])
        return data, np.array([x[0] for x in held]), np.cumsum(lengths) - lengths, np.array([x[1] for x in held])

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BLOCK - length + 1):
            piece = text[at : at + BLOCK]
            if held and size + len(piece) > BLOCK:
                yield out()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield out()


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches; those that touch become one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > far[:-1])))
    return start[new], far[np.concatenate((new[1:] - 1, [len(far) - 1]))]


def blocks(data: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of a buffer that lie in one text (texts start at ``first``), by anchor: (anchor,
    first window, last window, gram, stretch) of every block, in order of place."""
    gram = length // 2
    stop = np.append(first[1:], len(data))
    inside = np.arange(len(data) - length + 1) + length <= np.repeat(stop, np.diff(np.append(first, len(data))))[: len(data) - length + 1]
    hashes = Hashes(data)
    h = hashes.all(gram)
    keys = (h & ~U(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    at = np.flatnonzero(inside)
    anchor = (_least(keys, length - gram + 1)[at] & U(BLOCK - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    low, high = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))]
    anchor = anchor[new]
    shape = _mixed(((anchor - low) << 20 | (anchor - high)).astype(np.uint64) + U(1))
    return anchor, low, high, h[anchor], hashes.of(low, high + length) ^ shape


FIRST = "gram array<long>, stretch array<long>, at array<long>, own array<long>"


def first_digits(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Adds the blocks of each text: the hashes of its gram and of its stretch, and the place
    of its anchor with the windows to its left (place << 16 | most << 8 | least). Blocks that
    stand twice in one text are settled there (``own``: starts and stops) and come once."""
    for b in chunks(batches, "text", 4 * BLOCK):
        texts = b.column("text").to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        own: dict[int, list[np.ndarray]] = {}
        for data, number, first, place in slices(texts, length):
            anchor, low, high, gram, stretch = blocks(data, first, length)
            piece = np.searchsorted(first, low, side="right") - 1
            text, shift = number[piece], place[piece] - first[piece]
            order = np.lexsort((low, stretch, gram, text))
            same = np.concatenate(([False], (np.diff(text[order]) == 0) & (gram[order][1:] == gram[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])))
            twice = order[same | np.append(same[1:], False)]
            for t in np.unique(text[twice]).tolist():
                mine = twice[text[twice] == t]
                own.setdefault(t, []).append(np.stack([low[mine] + shift[mine], high[mine] + length + shift[mine]], axis=1))
            keep = np.sort(order[~same])
            packed = (anchor + shift) << 16 | (anchor - low) << 8 | (anchor - high)
            for store, values in zip(out, (text, gram, stretch, packed), strict=False):
                store.append(values[keep])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:4]]
        ends = np.searchsorted(columns[0], np.arange(b.num_rows + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c.view(np.int64))) for c in columns[1:]]
        spans = []
        for i in range(b.num_rows):
            found = np.concatenate(own[i]) if i in own else None
            spans.append(None if found is None else np.stack(merged(found[:, 0], found[:, 1]), axis=1).ravel())
        lists.append(pa.array(spans, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "gram", "stretch", "at", "own"])


STRETCH = pa.schema([("gram", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])


def cut_stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(rid, text, wanted: list of (gram, at)) to one row a block with its bytes."""
    for b in batches:
        held, size = ([], [], [], []), 0
        for rid, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            view = memoryview(text.as_buffer())
            for gram, at in zip(*(wanted.values.field(i).to_pylist() for i in (0, 1)), strict=True):
                place = at >> 16
                held[0].append(gram), held[1].append(rid), held[2].append(at)
                held[3].append(bytes(view[place - (at >> 8 & 255) : place - (at & 255) + length]))
                size += len(held[3][-1])
            if size > 8 << 20:
                yield as_batch(STRETCH, *held)
                held, size = ([], [], [], []), 0
        if held[0]:
            yield as_batch(STRETCH, *held)


def digits(batches: Iterator[pa.RecordBatch], length: int, width: int, cells: bool) -> Iterator[pa.RecordBatch]:
    """(gram, rid, at, bytes and, where ``cells``, a bitmap of the cells still in the sort) to
    (rid, at, cell, key, gram): the bytes that all windows of the cell share. A cell is
    ``width`` neighbouring distances to the anchor, whatever part of it the block has."""
    schema = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("cell", pa.int32()), ("key", pa.int64()), ("gram", pa.int64())])
    for whole in batches:
        step = BLOCK // (2 * length)
        for b in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
            at = b.column(2).to_numpy(zero_copy_only=False)
            most, least = at >> 8 & 255, at & 255
            stretch = b.column(3).to_pylist()
            sizes = np.array([len(x) for x in stretch], np.int64)
            first = np.cumsum(sizes) - sizes
            hashes = Hashes(np.frombuffer(b"".join(stretch), np.uint8))
            low, high = least // width, most // width
            n = high - low + 1
            row = np.repeat(np.arange(len(at)), n)
            cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
            if cells:
                alive = b.column(4).to_numpy(zero_copy_only=False)[row]
                good = (alive >> (cell * width // CELL)) & 1 == 1
                row, cell = row[good], cell[good]
            # Windows at a distance d start most - d bytes into the stretch.
            start = first[row] + most[row] - cell * width
            # A window of the cell is in the block, so the bytes that all of them share are in its stretch.
            stop = start - (width - 1) + length
            key = hashes.of(start, stop) ^ _mixed(cell.astype(np.uint64) + U(width << 32))
            yield as_batch(schema, b.column(1).to_numpy(zero_copy_only=False)[row], at[row], cell, key.view(np.int64), b.column(0).to_numpy(zero_copy_only=False)[row])


KEPT = pa.schema([("n_bytes", pa.int64()), ("start", pa.list_(pa.int64())), ("stop", pa.list_(pa.int64())), ("kept", pa.binary())])


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, own, start, stop) to (id, n_bytes, start, stop, kept)."""
    for b in chunks(batches, "text"):
        rows = []
        for text, own, start, stop in zip(*(b.column(k).to_pylist() for k in ("text", "own", "start", "stop")), strict=True):
            own = np.array(own or [], np.int64)
            a, e = merged(np.concatenate((np.array(start or [], np.int64), own[::2])), np.concatenate((np.array(stop or [], np.int64), own[1::2])))
            a, e = a.tolist(), e.tolist()
            rows.append((len(text), a, e, b"".join(text[x:y] for x, y in zip([0, *e], [*a, len(text)], strict=True)) if a else text))
        out = as_batch(KEPT, *zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([b.column("id"), *out.columns], names=["id", *KEPT.names])


def _again(rows: DataFrame, on: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """A pass of the sort over a written table: the rows whose key stands twice, written; and
    the keys with their counts. Keys of a thousandth of all rows are broadcast."""
    keys = written(rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), name)
    return written(join_counted(rows, keys, on, "n", rows.count()), name), keys


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes of strings of ``length`` bytes that start twice or more
    in all texts: id, n_bytes, start and stop (maximal removed stretches), kept (bytes).

    Matches stay within a document. Null and short texts keep everything; null and repeated ids
    and repeated rows keep their rows, and texts that stand twice go as a whole from ``length``
    bytes on. An empty table gives an empty table; other columns are not read.
    """
    if not 16 <= length <= 510:
        raise ValueError("lengths from 16 to 510 bytes")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    held = written(base.mapInArrow(lambda b: first_digits(b, length), f"rid long, id {kind}, text binary, {FIRST}"), "digits")
    rows = held.select("rid", F.inline(F.arrays_zip("gram", "stretch", "at")))

    # Depth of the gram, then of whole stretches: one of equal blocks goes on beside the others.
    alike, keys = _again(rows, ["gram"], "grams")
    drop_written(keys)
    kinds = written(alike.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one")), "kinds")
    settled = join_counted(alike, kinds.where("n > 1").select("gram", "stretch", "n"), ["gram", "stretch"], "n", alike.count())
    place, most, least = (F.expr(x) for x in ("shiftright(at, 16)", "shiftright(at, 8) & 255", "at & 255"))
    spans = written(settled.select("rid", (place - most).alias("start"), (place - least + length).alias("stop")), "spans")
    drop_written(alike)
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    left = written(join_counted(kinds.select("gram", "one"), mixed, ["gram"], "kinds", kinds.count()).select("gram", "one.rid", "one.at"), "left")
    drop_written(kinds)
    wanted = left.groupBy("rid").agg(F.collect_list(F.struct("gram", "at")).alias("wanted"))
    stretches = held.select("rid", "text").join(wanted.hint("shuffle_hash"), "rid")
    stretches = written(stretches.mapInArrow(lambda b: cut_stretches(b, length), "gram long, rid long, at long, bytes binary"), "stretches")
    drop_written(left)

    # Depth of the cells, then of the windows.
    out, on = "rid long, at long, cell int, key long, gram long", ["gram", "key"]
    cells = written(stretches.mapInArrow(lambda b: digits(b, length, CELL, False), out), "cells")
    alike, keys = _again(cells, on, "cells")
    alive = alike.groupBy("rid", "at").agg(F.bit_or(F.expr("shiftleft(1L, cell)")).alias("alive"))
    windows = stretches.join(alive, ["rid", "at"]).select("gram", "rid", "at", "bytes", "alive")
    windows = written(windows.mapInArrow(lambda b: digits(b, length, 1, True), out), "windows")
    for t in (cells, alike, keys, stretches):
        drop_written(t)
    alike, keys = _again(windows, on, "windows")
    start = F.expr("shiftright(at, 16) - cell")
    spans = spans.unionByName(alike.select("rid", start.alias("start"), (start + length).alias("stop")))
    for t in (windows, keys):
        drop_written(t)

    found = spans.groupBy("rid").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    rows = held.select("rid", "id", "text", "own").join(found.hint("shuffle_hash"), "rid", "left").select("id", "text", "own", "start", "stop")
    cut = rows.mapInArrow(cut_texts, f"id {kind}, n_bytes long, start array<long>, stop array<long>, kept binary")
    return cut.withColumnRenamed("id", id_col)
