"""Embedding near-duplicates by spherical-cap filters of random product codes.

A filter direction is a concatenation of one code vector for each of four blocks of
coordinates; a vector belongs to every filter whose direction it exceeds ``alpha`` with.
List decoding finds exactly these filters: sums of two blocks each are formed, and only
those that can reach ``alpha`` with the best other half are extended. Vectors of one label
that share a filter are compared in double precision, each pair in the least filter they
share, so link counts need no list of pairs. The code grows with the number of vectors, so
that a filter holds about as many at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, drop_written, join_counted, written
from .components import connected_components
from .simhash import forest

BLOCKS = 4


class ProductCode:
    """``tables`` independent codes of ``size`` unit vectors for each of four blocks."""

    def __init__(self, dim: int, size: int = 16, tables: int = 2, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.dim, self.size, self.tables = dim, size, tables
        self.turn = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(tables)]
        self.cuts = np.linspace(0, dim, BLOCKS + 1).astype(int)
        self.codes = []
        for _ in range(tables):
            blocks = [rng.standard_normal((size, b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
            self.codes.append([c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / np.sqrt(BLOCKS) for c in blocks])

    def halves(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all sums of blocks 0 and 1, and of blocks 2 and 3: (rows, size**2)."""
        x = unit @ self.turn[table]
        s = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes[table], strict=True)]
        both = lambda p, q: (p[:, :, None] + q[:, None, :]).reshape(len(x), -1)
        return both(s[0], s[1]), both(s[2], s[3])

    def decode_all(self, unit: np.ndarray, alpha: float, least: int, step: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """As ``decode``; the threshold of rows with fewer than ``least`` filters goes down in
        steps until they have as many, which only adds filters: no vector is left unseen."""
        row, f = self.decode(unit, alpha)
        todo = np.flatnonzero(np.bincount(row, minlength=len(unit)) < least)
        while len(todo) and alpha > -1:
            alpha -= step
            more, g = self.decode(unit[todo], alpha)
            keep = ~np.isin(row, todo)
            row, f = np.concatenate((row[keep], todo[more])), np.concatenate((f[keep], g))
            todo = todo[np.bincount(more, minlength=len(todo)) < least]
        order = np.lexsort((f, row))
        return row[order], f[order]

    def decode(self, unit: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row exceeds alpha with, in order."""
        rows, filters, width = [], [], self.size**2
        for t in range(self.tables):
            a, b = self.halves(unit, t)
            row, first = np.nonzero(a >= alpha - b.max(axis=1, keepdims=True))
            hit, second = np.nonzero(b[row] >= (alpha - a[row, first])[:, None])
            rows.append(row[hit])
            filters.append((t * width + first[hit]) * width + second)
        row, f = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((f, row))
        return row[order], f[order]


def fit_alpha(sample: np.ndarray, code: ProductCode, mean: float) -> float:
    """The threshold at which the sample's vectors have ``mean`` filters on average."""
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        n = sum(len(code.decode(sample[k : k + 256], mid)[0]) for k in range(0, len(sample), 256)) if mid > 0.2 else 1e18
        low, high = (mid, high) if n > mean * len(sample) else (low, mid)
    return high


def code_size(n: int, filters: float, tables: int = 2, held: float = 4.0) -> int:
    """Vectors of a block's code, so that a filter holds ``held`` of ``n`` vectors on average."""
    return max(8, int(np.ceil((n * filters / (tables * held)) ** (1 / BLOCKS))))


def _first_shared(lists: np.ndarray, i: np.ndarray, j: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which pairs share no filter below their f. lists: (rows, longest), sorted, padded."""
    out, step = np.ones(len(i), bool), max(1, (1 << 22) // max(1, lists.shape[1] ** 2))
    for k in range(0, len(i), step):
        g = f[k : k + step, None]
        a, b = lists[i[k : k + step]], lists[j[k : k + step]]
        width = int(max((a < g).sum(axis=1).max(initial=0), (b < g).sum(axis=1).max(initial=0)))
        a, b = np.where(a < g, a, -1)[:, :width], np.where(b < g, b, -2)[:, :width]
        out[k : k + step] = ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    return out


def _links(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray, cross: np.ndarray, cut: float, large: int = 64, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows of equal bucket (starts, ends) with a cosine of ``cut`` or more. A
    bucket is one block, or two whose rows of side 0 come first and meet those of side 1."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = ends - starts
    for s, e, c in zip(starts[size > large].tolist(), ends[size > large].tolist(), cross[size > large].tolist(), strict=True):
        m = s + int((side[s:e] == 0).sum()) if c else s
        i, j = np.nonzero(x[s:m] @ x[m:e].T >= cut) if c else np.nonzero(np.triu(x[s:e] @ x[s:e].T >= cut, 1))
        found.append((s + i, (m if c else s) + j))
    small = np.flatnonzero(size <= large)
    row = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in zip(starts[small].tolist(), ends[small].tolist(), strict=True))])
    of = np.repeat(small, size[small])
    ones = np.cumsum(np.concatenate(([0], side == 0)))
    begin = np.where(cross[of], starts[of] + ones[ends[of]] - ones[starts[of]], row + 1)
    width = np.where(cross[of] & (side[row] == 1), 0, ends[of] - begin)
    done, at = np.cumsum(width), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        w = width[at:to]
        left = np.repeat(row[at:to], w)
        right = np.repeat(begin[at:to], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        good = np.einsum("ij,ij->i", x[left], x[right]) >= cut
        found.append((left[good], right[good]))
        at = to
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(batches: Iterator[pa.RecordBatch], cut: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, f, lab, node, weight, dim, vec, filters) sorted by (key, i, j,
    side). Yields (u, v, n): with v null the links of u counted by weight, else an edge of a
    spanning forest. The last bucket of a batch waits for the next batch."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = t.filter(pa.array(dims == dim)).combine_chunks() if (dims != dim).any() else t.combine_chunks()
            key, i, j, side, f, lab, node, weight = (part.column(c).to_numpy() for c in ("key", "i", "j", "side", "f", "lab", "node", "weight"))
            x = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            a, b = _links(x, change, np.append(change[1:], len(key)), side, (i != j)[change], cut)
            same = lab[a] == lab[b]  # keys are hashes
            a, b = a[same], b[same]
            if not len(a):
                continue
            filters = part.column("filters").combine_chunks()
            lens = filters.value_lengths().to_numpy()
            lists = np.full((len(key), int(lens.max())), np.iinfo(np.int64).max, np.int64)
            lists[np.arange(lists.shape[1]) < lens[:, None]] = filters.flatten().to_numpy()
            new = _first_shared(lists, a, b, f[a])
            a, b = a[new], b[new]
            n = np.bincount(a, weight[b], len(key)) + np.bincount(b, weight[a], len(key))
            at = np.flatnonzero(n)
            u, v = forest(node[a], node[b])
            yield as_batch(
                schema,
                np.concatenate((node[at], u)),
                pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(v, pa.int64())]),
                np.concatenate((n[at].astype(np.int64), np.zeros(len(u), np.int64))),
            )

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = np.stack([now.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        held = now.slice(last)
        if last:
            yield from work(now.slice(0, last))
    if held is not None:
        yield from work(held)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cut: float = 0.98, filters: float = 32.0, least: int = 20, sample: int = 2000, block: int = 1024) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal length link. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing: no links, their own
    id as component. ``filters`` is the mean number of filters of a vector, fitted on about
    ``sample`` distinct vectors chosen by hash; every vector is indexed and has ``least``
    filters at least, whatever its length. Equal vectors are one node with a weight (known by
    a 64-bit hash), so a hot vector costs no pairs. Null ids keep their row; repeated ids and
    rows are rows of their own; other columns are not read; an empty table gives none.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))).withColumn("node", F.xxhash64("label", "vec"))
    ids = written(rows.select("id", "ok", "node"), "vector-ids")
    distinct = rows.where("ok").groupBy("node").agg(F.xxhash64(F.first("label")).alias("lab"), F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = written(distinct.withColumn("dim", F.size("vec")), "vectors")
    total, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = min(1.0, sample / max(1, total))
    draw = F.pmod(F.xxhash64("vec", F.lit(6)), F.lit(1_000_000)) / 1e6
    some = nodes.where(draw < share).select("vec").toPandas()["vec"] if total else []
    size = code_size(total, filters)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    by_dim: dict[int, list] = {}
    for x in some:
        by_dim.setdefault(len(x), []).append(x / np.abs(x).max())
    # Lengths that the sample lacks start from a high threshold, which goes down to ``least``.
    alphas = {d: fit_alpha(unit(np.array(x, np.float64)), ProductCode(d, size), filters) for d, x in by_dim.items()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                dims, found = np.asarray(part.column("dim")), []
                for d in np.unique(dims).tolist():
                    code = codes.setdefault(d, codes.get(d) or ProductCode(d, size))
                    mine = part.filter(pa.array(dims == d))
                    x = mine.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    row, f = code.decode_all(unit(x / np.abs(x).max(axis=1, keepdims=True)), alphas.get(d, 0.9), least)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))
                    yield mine.append_column("filters", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f, pa.int64())))

    schema = nodes.schema.simpleString()[7:-1].replace(":", " ")
    coded = written(nodes.mapInArrow(decode, f"{schema}, filters array<long>"), "filters")
    members = coded.select("lab", "dim", "node", F.explode("filters").alias("f")).select(F.xxhash64("lab", "dim", "f").alias("key"), "f", "node")
    n_members = coded.agg(F.coalesce(F.sum(F.size("filters")), F.lit(0))).first()[0]
    many = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("b"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("b")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("b") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (k < F.col("own")).cast("int").alias("side")),
    )
    dealt = join_counted(members, many, ["key"], "n", n_members).withColumn("own", own).select("key", "f", "node", F.inline(pairs))
    dealt = (
        dealt.join(coded.select("node", "lab", "dim", "weight", "vec", "filters"), "node")
        .select("key", "i", "j", "side", "f", "lab", "node", "weight", "dim", "vec", "filters")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "side")
    )
    found = written(dealt.mapInArrow(lambda batches: _compare(batches, cut), "u long, v long, n long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("far"))
    comp = connected_components(found.where("v is not null").select("u", "v"))
    known = coded.select("node", "weight", "least").join(links, "node", "left").join(comp, "node", "left")
    known = written(known.select("node", "weight", "least", (F.coalesce("far", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    drop_written(coded)
    drop_written(found)
    least_ids = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    known = written(join_counted(known, least_ids, ["component"], "m", total).select("node", "weight", "n_links", "component_id"), "known")
    found_rows = join_counted(ids.where("ok"), known, ["node"], "weight", n_rows).select("id", "n_links", "component_id")
    rest = ids.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found_rows.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
