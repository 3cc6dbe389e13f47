"""Zero-phase filters and gap filling over recordings that come in chunks.

A filter pass takes the state at a chunk's start to A^n z + c; a pass back over its output
takes the state at its end to A^n z' + c' + M z. These maps of a chunk form a monoid, so they
are composed block by block, the blocks of a recording are scanned, and every chunk gets the
states at both of its edges. Then chunks run apart, both directions at once: two passes over
the samples, whatever the length of a recording, and no task holds more than ``BLOCK`` summaries
or one summary a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.functions import signals
from wavetally.operators.robust import finite

KEYS = ["record_id", "label"]
#: Chunks whose maps one task composes.
BLOCK = 512
SUMMARY = "record_id string, label string, chunk_idx int, n long, c array<double>, back array<double>, head array<double>, tail array<double>"
COMPOSED = SUMMARY.replace("chunk_idx int", "block int") + ", m array<double>"
EDGES = "record_id string, label string, {} int, z array<double>, back_z array<double>"


class _Maps:
    """Maps of stretches: (n, c, c', M, first samples, last samples)."""

    def __init__(self, sos: np.ndarray):
        self.system = signals.Cascade(sos)
        self.keep = 3 * (2 * len(sos) + 1) + 1
        self.sections = len(sos)
        self.power = lru_cache(256)(self.system.power)
        self.cross = lru_cache(256)(self._cross)

    def _cross(self, n: int) -> np.ndarray:
        """M: the state at the start acts on n outputs, and these on the state of the way back."""
        quiet, out = np.zeros(n), []
        for z in np.eye(self.system.size):
            answer = self.system.run(quiet, z)[0]
            out.append(self.system.run(answer[::-1], np.zeros(self.system.size))[1])
        return np.array(out).T

    def of(self, x: np.ndarray) -> tuple:
        zero = np.zeros(self.system.size)
        y, c = self.system.run(x, zero)
        return len(x), c, self.system.run(y[::-1], zero)[1], x[: self.keep], x[-self.keep :]

    def row(self, r) -> tuple:
        n = int(r.n)
        m = np.asarray(r.m, float).reshape(self.system.size, -1) if hasattr(r, "m") else self.cross(n)
        return n, np.asarray(r.c, float), np.asarray(r.back, float), m, np.asarray(r.head, float), np.asarray(r.tail, float)

    def joined(self, p: tuple, q: tuple) -> tuple:
        ap, aq = self.power(p[0]), self.power(q[0])
        head = np.concatenate((p[4], q[4]))[: self.keep] if len(p[4]) < self.keep else p[4]
        tail = np.concatenate((p[5], q[5]))[-self.keep :] if len(q[5]) < self.keep else q[5]
        return p[0] + q[0], aq @ p[1] + q[1], ap @ (q[2] + q[3] @ p[1]) + p[2], ap @ q[3] @ ap + p[3], head, tail

    def edges(self, maps: list[tuple], z: np.ndarray, back: np.ndarray) -> tuple[list, list, np.ndarray]:
        """States at the start (forward) and at the end (backward) of each stretch in a row,
        from those at the start of the first and the end of the last."""
        starts, ends = [], [back] * len(maps)
        for m in maps:
            starts.append(z)
            z = self.power(m[0]) @ z + m[1]
        for k in range(len(maps) - 1, 0, -1):
            m = maps[k]
            ends[k - 1] = self.power(m[0]) @ ends[k] + m[2] + m[3] @ starts[k]
        return starts, ends, z


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def edge_states(chunks: DataFrame, sos: np.ndarray) -> DataFrame:
    """record_id, label, chunk_idx and the states of the filter at the chunk's edges."""

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = _Maps(sos)
        for f in frames:
            yield _table([(r.record_id, r.label, r.chunk_idx, *maps.of(np.asarray(r.values, float))) for r in f.itertuples()], SUMMARY)

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows, maps = rows.sort_values("chunk_idx"), _Maps(sos)
        total = None
        for r in rows.itertuples():
            total = maps.row(r) if total is None else maps.joined(total, maps.row(r))
        n, c, back, m, head, tail = total
        return _table([(rows["record_id"].iloc[0], rows["label"].iloc[0], int(rows["block"].iloc[0]), n, c, back, head, tail, m.ravel())], COMPOSED)

    def scanned(rows: pd.DataFrame) -> pd.DataFrame:
        rows, maps = rows.sort_values("block"), _Maps(sos)
        blocks = [maps.row(r) for r in rows.itertuples()]
        whole = blocks[0]
        for b in blocks[1:]:
            whole = maps.joined(whole, b)
        pad = signals.padding(maps.sections, whole[0])
        before, after = signals.odd_extension(whole[4][: pad + 1], whole[5][-pad - 1 :])
        system = maps.system
        z = system.run(before, system.steady(before[0]))[1]
        end = maps.power(whole[0]) @ z + whole[1]
        last = system.run(after, end)[0][::-1]
        back = system.run(last, system.steady(last[0]))[1]
        starts, ends, _ = maps.edges(blocks, z, back)
        return _table([(r.record_id, r.label, r.block, s, e) for r, s, e in zip(rows.itertuples(), starts, ends, strict=True)], EDGES.format("block"))

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows, maps = rows.sort_values("chunk_idx"), _Maps(sos)
        starts, ends, _ = maps.edges([maps.row(r) for r in rows.itertuples()], np.asarray(rows["z"].iloc[0], float), np.asarray(rows["back_z"].iloc[0], float))
        return _table([(r.record_id, r.label, r.chunk_idx, s, e) for r, s, e in zip(rows.itertuples(), starts, ends, strict=True)], EDGES.format("chunk_idx"))

    each = chunks.where(F.size("values") > 0).select(*KEYS, "chunk_idx", "values").mapInPandas(summaries, SUMMARY)
    each = each.withColumn("block", F.floor(F.col("chunk_idx") / BLOCK).cast("int")).repartition(*KEYS, "block")  # one exchange for both uses
    blocks = each.groupBy(*KEYS, "block").applyInPandas(composed, COMPOSED)
    bounds = blocks.groupBy(*KEYS).applyInPandas(scanned, EDGES.format("block"))
    return each.join(bounds.hint("shuffle_hash"), [*KEYS, "block"]).groupBy(*KEYS, "block").applyInPandas(spread, EDGES.format("chunk_idx"))


def zero_phase(chunks: DataFrame, sos: np.ndarray) -> DataFrame:
    """chunks: (record_id, label, chunk_idx, start_sample, sample_rate_hz, values), finite and
    without holes between them (see ``filled``). The same rows with the values that
    ``signals.zero_phase`` gives for the whole recording. Under 32 samples raise."""
    kind = chunks.schema.simpleString()[7:-1].replace(":", " ")
    names = chunks.columns

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = signals.Cascade(sos)
        for f in frames:
            out = []
            for x, z, back in zip(f["values"], f["z"], f["back_z"], strict=True):
                y = system.run(np.asarray(x, float), np.asarray(z, float))[0]
                out.append(system.run(y[::-1], np.asarray(back, float))[0][::-1])
            yield f.assign(values=out)[names]

    # A hash table of the states (some numbers a chunk), never one of the samples.
    return chunks.join(edge_states(chunks, sos).hint("shuffle_hash"), [*KEYS, "chunk_idx"]).mapInPandas(of, kind)


def filled(chunks: DataFrame) -> DataFrame:
    """Null and non-finite values filled: linear in the sample between the nearest finite ones,
    in whichever chunks these stand, constant at the ends; ``lost`` marks them. A recording
    without a finite sample raises."""
    at = F.filter(F.sequence(F.lit(0), F.size("values") - 1), lambda i: F.coalesce(finite(F.get("values", i)), F.lit(False)))
    point = lambda i: F.when(i.isNotNull(), F.struct((F.col("start_sample") + i).alias("at"), F.get("values", i).alias("v")))
    ends = chunks.where(F.size("values") > 0).select(*KEYS, "chunk_idx", "start_sample", "values", at.alias("_at"))
    ends = ends.select(*KEYS, "chunk_idx", point(F.array_min("_at")).alias("_first"), point(F.array_max("_at")).alias("_last"))
    w = Window.partitionBy(*KEYS).orderBy("chunk_idx")
    near = ends.select(*KEYS, "chunk_idx", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    kind = chunks.schema.simpleString()[7:-1].replace(":", " ")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values, lost = [], []
            for r in f.itertuples():
                x = np.array(r.values, float)
                good = np.isfinite(x)
                known, level = np.flatnonzero(good) + float(r.start_sample), x[good]
                for edge, first in ((r.before_, True), (r.after_, False)):
                    if edge is not None:
                        known = np.concatenate(([edge["at"]], known) if first else (known, [edge["at"]]))
                        level = np.concatenate(([edge["v"]], level) if first else (level, [edge["v"]]))
                if not len(known):
                    raise ValueError(f"{r.record_id}: no finite sample")
                values.append(np.where(good, x, np.interp(np.arange(len(x)) + float(r.start_sample), known, level)))
                lost.append(~good)
            yield f.assign(values=values, lost=lost).drop(columns=["before_", "after_"])

    near = near.withColumnsRenamed({"_before": "before_", "_after": "after_"})
    rows = chunks.where(F.size("values") > 0).join(near.hint("shuffle_hash"), [*KEYS, "chunk_idx"]).select(*chunks.columns, "before_", "after_")
    return rows.mapInPandas(of, kind + ", lost array<boolean>")


def frames(chunks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Recordings cut anew: frame f owns the samples [f * size, (f + 1) * size) and also holds
    ``before`` samples ahead of and ``after`` behind them, where the recording has them:
    record_id, label, frame, first_sample, values. Any cut of the chunks gives the same."""
    stop = F.col("start_sample") + F.size("values")
    rows = chunks.where(F.size("values") > 0).withColumn("frame", F.explode(F.sequence(F.floor((F.col("start_sample") - after) / size), F.floor((stop - 1 + before) / size))))
    low = F.greatest(F.col("start_sample"), F.col("frame") * size - before)
    high = F.least(stop, (F.col("frame") + 1) * size + after)
    rows = rows.where((low < high) & (F.col("frame") >= 0))
    part = F.slice("values", (low - F.col("start_sample") + 1).cast("int"), (high - low).cast("int"))
    parts = rows.select(*KEYS, "frame", F.struct(low.alias("at"), part.alias("v")).alias("part")).groupBy(*KEYS, "frame").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = parts.select(*KEYS, "frame", F.get("parts", F.lit(0))["at"].alias("first_sample"), F.flatten(F.transform("parts", lambda p: p["v"])).alias("values"))
    return whole.where(F.col("first_sample") + F.size("values") > F.col("frame") * size)
