"""Greedy non-maximum suppression in rounds over cells.

The best row stays, rows within the radius of it go, and so on down. What happens to a row is
settled by the better rows within the radius alone. So keys are cut at cells many radii wide;
each round a cell settles, in order, the rows that no open row beyond its edge can change, and
the cells see one another's verdicts in the next round. Cells double from round to round, so
that chains of rows that hang on each other across cells end in few rounds. No task holds a
whole key, unless one chain runs through all of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.operators.rounds import kept

OPEN, STAYS, GOES = 0, 1, 2


def settle(center: np.ndarray, state: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """One cell's verdicts. Rows come best first; ``own`` are those of the cell, the others
    stand within the radius of its edges. States of others do not change."""
    out, width = state.copy(), radius if radius > 0 else 1.0
    stays: dict[int, list[float]] = {}
    open_: dict[int, list[float]] = {}

    def near(cells: dict[int, list[float]], c: float, k: int) -> bool:
        return any(abs(x - c) <= radius for n in (k - 1, k, k + 1) for x in cells.get(n, ()))

    # What stays already counts from the start: every better row beside it has gone.
    for i in np.flatnonzero(state == STAYS).tolist():
        stays.setdefault(math.floor(center[i] / width), []).append(float(center[i]))
    for i, (c, s, mine) in enumerate(zip(center.tolist(), state.tolist(), own.tolist(), strict=True)):
        if s != OPEN:
            continue
        k = math.floor(c / width)
        if mine and near(stays, c, k):
            out[i] = GOES
        elif not mine or near(open_, c, k):
            open_.setdefault(k, []).append(c)
        else:
            out[i] = STAYS
            stays.setdefault(k, []).append(c)
    return out


def suppress(df: DataFrame, keys: list[str], radius: float, center: str = "center", order: list[Column] | None = None, cells: int = 64) -> DataFrame:
    """The rows of ``df`` that greedy suppression keeps in each key. ``order``: what makes a row
    better, first things first (ascending, nulls last); it ends with an id, as the order of rows
    that are alike in all of it is not defined. ``cells``: width of a cell in radii.

    Exact for any group size. Null keys are a group; rows with a null centre go."""
    if radius < 0:
        raise ValueError("the radius is not negative")
    order = order or [-F.col("score"), F.col("id")]
    names, ranks = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.where(F.col(center).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(center).cast("double").alias("_c"), *[o.alias(n) for o, n in zip(order, ranks, strict=True)], whole)
    # At one centre only the best can stay: whatever it goes by takes the others along.
    first = F.struct(*[x for n in ranks for x in (F.col(n).isNull().alias(f"{n}n"), F.col(n))])
    rows = rows.groupBy(*names, "_c").agg(F.min_by(F.struct(*ranks, "row"), first).alias("best")).select(*names, "_c", "best.*")
    light = kept(rows.select(*names, "_c", *ranks, F.lit(OPEN).alias("state")))
    width, reach = max(radius, 1e-9) * cells, radius * (1 + 1e-9)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema)

    def settled(f: pd.DataFrame) -> pd.DataFrame:
        group, center_, own = f["_g"].to_numpy(), f["_c"].to_numpy(float), f["_own"].to_numpy(bool)
        state = f["state"].to_numpy().copy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if (own[a:e] & (state[a:e] == OPEN)).any():
                state[a:e] = settle(center_[a:e], state[a:e], own[a:e], radius)
        return f.assign(state=state.astype(np.int32)).loc[own & (state != GOES), names_out]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of cells and then rank; the last cell of a batch waits for the next."""
        held: pd.DataFrame | None = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            other = np.flatnonzero(f["_g"].to_numpy() != f["_g"].iloc[-1]) if len(f) else np.zeros(0, int)
            last = int(other[-1]) + 1 if len(other) else 0
            held = f.iloc[last:]
            if last:
                yield settled(f.iloc[:last])
        if held is not None and len(held):
            yield settled(held)

    names_out = light.columns
    inner = [x for n in ranks for x in (F.col(n).isNull(), F.col(n))]
    while not light.where(F.col("state") == OPEN).isEmpty():
        cell = lambda c, w=width: F.floor(c / w)
        at = F.array_distinct(F.array(cell(F.col("_c") - reach), cell(F.col("_c")), cell(F.col("_c") + reach)))
        dealt = light.withColumn("_cell", F.explode(at)).withColumn("_own", F.col("_cell") == cell(F.col("_c")))
        sorted_ = dealt.withColumn("_g", F.xxhash64(*names, "_cell")).repartition(*names, "_cell").sortWithinPartitions(*names, "_cell", *inner)
        light = kept(sorted_.mapInPandas(of, schema))
        width *= 2
    stay = light.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("_c").alias("_x"))
    same = [rows[n].eqNullSafe(stay[f"{n}s"]) for n in names] + [rows["_c"] == stay["_x"]]
    return rows.join(stay, same, "left_semi").select("row.*")
