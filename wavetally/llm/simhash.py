"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over shingle hashes. They are searched for pairs
within ``radius`` bits:

1. bit correlations of all fingerprints (one 64 x 64 count table) group correlated bits
   into partitions of equal width;
2. exact histograms of each partition's values (at most 2**width entries) give, for every
   value and threshold, how many rows an inquiry would meet; of several numbers of
   partitions the one with the least estimated cost is taken;
3. per fingerprint, dynamic programming allots thresholds T_i >= -1 whose sum is
   ``radius - parts + 1`` at the least estimated count (plus the price of the probes); a
   pair further apart than T_i in every partition differs in more than ``radius`` bits,
   so no link is lost;
4. each fingerprint probes the values within T_i of its own; probes and index rows meet
   in buckets. Buckets over ``block`` rows are dealt as pairs of blocks, and every block
   compares in numpy and yields a few links, never the pairs.

``near_duplicates`` links fingerprints; ``Copies`` takes pairs of near fingerprints as
candidates and links those whose shingle sets have a Jaccard similarity of ``cut`` or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, drop_written, join_counted, text_bytes, written
from .components import connected_components

BITS = 64
#: What a probe row costs (made twice, shuffled, sorted), in comparisons of two rows.
PROBE = 50
#: Words of 64 bits in an odd sketch.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle in order. Words are runs without ASCII white space of the A-Z
    lower-cased text; fewer words than ``shingle`` count as one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * SKETCH values: how many of the distinct hashes have it, mod 2.
    Sketches of two sets differ in at most as many bits as the sets have unshared elements."""
    odd = np.bincount((hashes % np.uint64(BITS * SKETCH)).astype(np.int64), minlength=BITS * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The majority over all shingles, repeats included; no words give zero."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp long: the 64 bits as a signed number). Null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col)).mapInArrow(of, f"id {kind}, fp long")


# ---------------------------------------------------------------- partitions and thresholds
def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Greedy groups of correlated bits. together: how many rows have both bits set."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        free = sorted(left)
        at = np.unravel_index(np.argmax(corr[np.ix_(free, free)]), (len(free), len(free)))
        group = [free[i] for i in sorted(set(at))][:width]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        left -= set(group)
        groups.append(sorted(group))
    return groups


def values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(rows, parts): each partition's bits packed into a number."""
    u = fp.astype("<i8").view(np.uint64)
    out = np.zeros((len(u), len(groups)), np.int64)
    for k, group in enumerate(groups):
        for i, bit in enumerate(group):
            out[:, k] |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def masks(width: int, t: int) -> np.ndarray:
    """All masks of at most t bits."""
    return np.array([sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def near_counts(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """(most + 1, 2**width): rows whose value lies within t bits of each value."""
    out, at = [], np.arange(1 << width)
    for t in range(most + 1):
        total = np.zeros(1 << width, np.float32)
        for m in masks(width, t):
            total += hist[at ^ m]
        out.append(total)
    return np.array(out)


def allot(cost: np.ndarray, total: int) -> np.ndarray:
    """cost: (rows, parts, options) with option k for threshold k - 1 (the first is "skip").
    Returns thresholds (rows, parts) with the given sum and the least total cost."""
    n, parts, options = cost.shape
    span = total + parts + 1  # sums from -parts to total, as 0 .. total + parts
    best, choice = np.full((n, span), np.inf, np.float32), np.zeros((parts, n, span), np.int8)
    best[:, 0] = 0
    for i in range(parts):
        nxt = np.full((n, span), np.inf, np.float32)
        for k in range(options):
            if k >= span:
                break
            way = best[:, : span - k] + cost[:, i, k, None]
            better = way < nxt[:, k:]
            nxt[:, k:] = np.where(better, way, nxt[:, k:])
            choice[i][:, k:][better] = k
        best = nxt
    out, s, rows = np.zeros((n, parts), np.int64), np.full(n, span - 1), np.arange(n)
    for i in reversed(range(parts)):
        k = choice[i][rows, s]
        out[:, i] = k - 1
        s = s - k
    return out


# ---------------------------------------------------------------- buckets
def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as (node, smallest reachable node), nodes that are their own left out."""
    if not len(a):
        return a, b
    nodes, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = pos[: len(a)], pos[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)  # the old root takes the smallest label of its members
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare(sizes_i: np.ndarray, sizes_p: np.ndarray, index: np.ndarray, probe: np.ndarray, radius: int, most: int = 1 << 21):
    """Index and probe fingerprints of many buckets, each side in bucket order. Yields the
    places (of probe, of index) of those within ``radius`` bits and their distances."""
    at_i = np.cumsum(sizes_i) - sizes_i
    # a unit is a probe row with all index rows of its bucket
    bucket = np.repeat(np.arange(len(sizes_p)), sizes_p)
    width = sizes_i[bucket]
    done = np.cumsum(width)
    rows, total = 0, len(bucket)
    while rows < total:
        to = max(rows + 1, int(np.searchsorted(done, (done[rows - 1] if rows else 0) + most, "right")))
        w = width[rows:to]
        inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        right = np.repeat(at_i[bucket[rows:to]], w) + inside
        far = np.bitwise_count((np.repeat(probe[rows:to], w) ^ index[right]).view(np.uint64))
        good = np.flatnonzero(far <= radius)
        if len(good):
            yield np.repeat(np.arange(rows, to), w)[good], right[good], far[good]
        rows = to


def _linked(p: np.ndarray, i: np.ndarray, far: np.ndarray, probe: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints' links."""
    keep = probe[p, 0] != index[i, 0]
    return forest(probe[p[keep], 0], index[i[keep], 0])


def _nearest(p: np.ndarray, i: np.ndarray, far: np.ndarray, probe: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's nearest partner of a smaller number: few pairs, that join large groups; and
    (u, u) for each probe u that met another node and is in none of these pairs."""
    a, b = probe[p, 1], index[i, 1]
    u, v = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((v, far, u))
    order = order[u[order] != v[order]]
    first = order[np.flatnonzero(np.diff(u[order], prepend=u[order[:1]] - 1))] if len(order) else order
    met = np.setdiff1d(a[a != b], np.concatenate((u[first], v[first])))
    return np.concatenate((u[first], met)), np.concatenate((v[first], met))


def _apart(p: np.ndarray, i: np.ndarray, far: np.ndarray, probe: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different components."""
    return _pairs_of(p, i, probe[p, 2] != index[i, 2], probe, index)


def _possible(p: np.ndarray, i: np.ndarray, far: np.ndarray, probe: np.ndarray, index: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose sketches differ in no more bits than sets of the
    wanted similarity have unshared elements; no similar pair is left out."""
    keep = probe[p, 2] != index[i, 2]
    for at in range(0, len(p), most):
        a, b = probe[p[at : at + most]], index[i[at : at + most]]
        differ = np.bitwise_count((a[:, 4:] ^ b[:, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        keep[at : at + most] &= differ * 1000 <= a[:, 3] + b[:, 3]
    return _pairs_of(p, i, keep, probe, index)


def _pairs_of(p: np.ndarray, i: np.ndarray, keep: np.ndarray, probe: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = probe[p[keep], 1], index[i[keep], 1]
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(batches: Iterator[pa.RecordBatch], radius: int, pick) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, role, fp and what else ``pick`` reads) sorted by (key, x, y): the last
    bucket of a batch waits for the next batch."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    kept: list[np.ndarray] | None = None

    def work(key, role, rows):
        change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else np.zeros(0, int)
        n_p = np.add.reduceat(role.astype(np.int64), change) if len(change) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((change, [len(key)])))
        index, probe = rows[role == 0], rows[role == 1]
        links = [pick(*found, probe, index) for found in compare(n - n_p, n_p, index[:, 0], probe[:, 0], radius)]
        u, v = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
        if len(links) > 1 and pick is _linked:
            u, v = forest(u, v)
        if len(u):
            yield as_batch(schema, u, v)

    for b in batches:
        columns = [np.asarray(c) for c in b.columns]
        now = [np.stack(columns[:3], axis=1), columns[3], np.stack(columns[4:], axis=1)]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1)).max(initial=-1)) + 1
        kept = [x[last:] for x in now]
        yield from work(*[x[:last] for x in now])
    if kept is not None:
        yield from work(*kept)


class Probes:
    """Partitions of the fingerprints of ``fps`` (column ``fp``; ``size``, if ``sized``), fitted
    to all its rows, and the pairs that meet in them.

    ``sized`` rows are of sets whose sizes differ at most by the factor ``cut``: index rows go
    to the size class of their own set and the next, probes to their own class. Rows with false
    in a column ``asks`` do not probe."""

    def __init__(self, fps: DataFrame, radius: int, options: tuple[int, ...] = (4, 5, 6, 8), cut: float | None = None):
        if not all(1 <= p <= 8 and BITS // p <= 22 for p in options):
            raise ValueError("partitions of 8 to 22 bits are supported")
        self.radius, self.cut = radius, cut

        def pairs(batches):
            total = np.zeros((BITS, BITS), np.int64)
            for b in batches:
                x = _bits(np.asarray(b.column(0))).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

        only = fps.select("fp")
        got = only.mapInArrow(pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
        together = np.zeros((BITS, BITS))
        together[got["i"], got["j"]] = got["n"]
        rows = fps.count()
        groups = {p: group_bits(together, rows, p) for p in options}

        def counts(batches):
            hists = {p: [np.zeros(1 << len(g), np.int64) for g in gs] for p, gs in groups.items()}
            for b in batches:
                fp = np.asarray(b.column(0))
                for p, gs in groups.items():
                    v = values(fp, gs)
                    for k, h in enumerate(hists[p]):
                        h += np.bincount(v[:, k], minlength=len(h))
            for p, hs in hists.items():
                for k, h in enumerate(hs):
                    at = np.flatnonzero(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p * 8 + k)), pa.array(at), pa.array(h[at])], names=["k", "v", "n"])

        seen = only.mapInArrow(counts, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas()
        some = np.array([r["fp"] for r in only.limit(500).collect()], np.int64)  # for an estimate of costs
        best = np.inf
        for p, gs in groups.items():
            most = min(3, radius)
            near, all_masks = [], [[masks(len(g), t) for t in range(most + 1)] for g in gs]
            for k, g in enumerate(gs):
                hist = np.zeros(1 << len(g), np.float32)
                mine = seen[seen["k"] == p * 8 + k]
                hist[mine["v"].to_numpy()] = mine["n"].to_numpy()
                near.append(near_counts(hist, len(g), most))
            cost = self._cost(some, gs, near, all_masks)
            if radius - p + 1 < -p or radius - p + 1 > most * p:
                continue  # no thresholds have that sum
            chosen = allot(cost, radius - p + 1)
            mean = float(np.take_along_axis(cost, chosen[:, :, None] + 1, axis=2).sum()) / max(1, len(some))
            if mean < best:
                best, self.groups, self.near, self.masks = mean, gs, near, all_masks
        if best == np.inf:
            raise ValueError("no number of partitions reaches this radius")
        # Sent once: within the function each query of a slice would have a copy of its own.
        self.tables = fps.sparkSession.sparkContext.broadcast((self.near, self.masks))
        self.near = self.masks = None

    def _cost(self, fp: np.ndarray, groups, near, all_masks) -> np.ndarray:
        v, options = values(fp, groups), len(all_masks[0])
        cost = np.zeros((len(fp), len(groups), options + 1), np.float32)
        share = 1.0 if self.cut is None else 0.25  # a guess: pairs of two neighbouring classes
        for k in range(len(groups)):
            for t in range(options):
                cost[:, k, t + 1] = share * near[k][t][v[:, k]] + PROBE * len(all_masks[k][t])
        return cost

    def _spread(self, batches: Iterator[pa.RecordBatch], names: list[str], only: range) -> Iterator[pa.RecordBatch]:
        """Rows (key, role, names) of the partitions ``only``. A batch has ``names``, ``asks`` and,
        if sized, ``size``."""
        schema = pa.schema([("key", pa.int64()), ("role", pa.int8()), *((c, pa.int64()) for c in names)])
        total = self.radius - len(self.groups) + 1
        near, all_masks = self.tables.value
        for whole in batches:
            step = min(2048, 6144 // len(names))  # rows of many columns make larger batches
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                columns = [np.asarray(b.column(c)) for c in names]
                v = values(columns[0], self.groups)
                level = np.zeros(len(v), np.int64)
                if self.cut is not None:
                    level = np.floor(np.log(np.maximum(np.asarray(b.column("size")), 1)) / -np.log(self.cut)).astype(np.int64)
                chosen = allot(self._cost(columns[0], self.groups, near, all_masks), total)
                chosen[~np.asarray(b.column("asks"))] = -1
                for k in only:
                    own = v[:, k] | (k << 32) | (level << 36)
                    for up in (0, 1) if self.cut is not None else (0,):
                        yield as_batch(schema, own + (up << 36), np.zeros(len(v), np.int8), *columns)
                    for t, m in enumerate(all_masks[k]):
                        who = np.flatnonzero(chosen[:, k] == t)
                        if len(who):
                            keys = (own[who][:, None] ^ m[None, :]).ravel()
                            yield as_batch(schema, keys, np.ones(len(keys), np.int8), *(np.repeat(c[who], len(m)) for c in columns))

    def written_pairs(self, fps: DataFrame, pick, slices: int = 4) -> DataFrame:
        """The distinct ``pairs``, written; partitions are done in ``slices``, whose shuffles go
        one after the other."""
        cuts = [len(self.groups) * k // slices for k in range(slices + 1)]
        found = [written(self.pairs(fps, pick, only=range(a, b)).distinct(), "slice") for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = written(out.distinct(), "pairs")
        for t in found:
            drop_written(t)
        return out

    def pairs(self, fps: DataFrame, pick, block: int = 4096, only: range | None = None) -> DataFrame:
        """(u, v) as ``pick`` chooses them from the pairs within the radius, of all partitions or
        those of ``only``. Probes are cheaper to make twice than to keep."""
        only = range(len(self.groups)) if only is None else only
        names = {_linked: ["fp"], _nearest: ["fp", "node"], _apart: ["fp", "node", "c"], _possible: ["fp", "node", "c", "room", *SKETCHES]}[pick]
        asks = F.col("asks") if "asks" in fps.columns else F.lit(True).alias("asks")
        rows = fps.select(*names, asks, *(["size"] if self.cut is not None else [])).mapInArrow(lambda batches: self._spread(batches, names, only), "key long, role byte, " + ", ".join(f"{c} long" for c in names))
        size = rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("n_i"), F.count_if(F.col("role") == 1).alias("n_p"))
        parts_of = lambda n: F.ceil(F.col(n) / block).cast("int")
        # Only buckets of more than one block: at most rows / block of them.
        hot = written(size.where(F.greatest("n_i", "n_p") > block).select("key", parts_of("n_i").alias("b_i"), parts_of("n_p").alias("b_p")), "hot")
        buckets = hot.count()
        if buckets <= 1_000_000:  # else the rows are shuffled once more
            hot = F.broadcast(hot)
        own = lambda n: F.pmod(F.xxhash64(names[-1] if pick is _linked else "node", F.lit(7)), F.col(n)).cast("int")
        to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        dealt = (
            (rows.join(hot, "key", "left") if buckets else rows.withColumns({"b_i": F.lit(1), "b_p": F.lit(1)}))
            .withColumn("b_i", F.greatest(F.coalesce("b_i", F.lit(1)), F.lit(1)))
            .withColumn("b_p", F.greatest(F.coalesce("b_p", F.lit(1)), F.lit(1)))
            .withColumn("x", F.explode(F.when(F.col("role") == 0, F.array(own("b_i"))).otherwise(to("b_i"))))
            .withColumn("y", F.explode(F.when(F.col("role") == 1, F.array(own("b_p"))).otherwise(to("b_p"))))
            .select("key", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "role", *names)
            .repartition("key", "x", "y")
            .sortWithinPartitions("key", "x", "y")
        )
        radius = self.radius
        return dealt.mapInArrow(lambda batches: _meet(batches, radius, pick), "u long, v long")


def hamming_components(fps: DataFrame, radius: int = 4, options: tuple[int, ...] = (4,), block: int = 4096) -> DataFrame:
    """fps: one long column ``fp`` of distinct values, better a written table (it is read
    several times). Returns (node, component) of the values that have a link."""
    return connected_components(Probes(fps, radius, options).pairs(fps, _linked, block))


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id reachable by
    links of at most ``radius`` differing bits, itself included).

    Null and empty texts have fingerprint zero and link like any other. Null ids keep
    their row and never become a component's id unless it has no other. Repeated rows
    give repeated rows; an empty table gives none. Other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    total = least.agg(F.sum("n")).first()[0] or 0
    parts_of = hamming_components(least.select("fp"), radius)
    nodes = least.join(parts_of.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component")
    )
    nodes = written(nodes, "nodes")
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    to = written(join_counted(nodes, ids, ["component"], "m", total).select("fp", "n", "component_id"), "classes")
    return join_counted(fps, to, ["fp"], "n", total).select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# ---------------------------------------------------------------- similar texts
def needed(n: int, cut: float) -> int:
    """The least overlap of a set of n with any set of similarity ``cut``."""
    return math.ceil(cut * n - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, cut: float) -> bool:
    """a, b: sorted distinct hashes. Two empty sets are alike."""
    if min(len(a), len(b)) < needed(max(len(a), len(b)), cut):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= cut * (len(a) + len(b) - both) - 1e-9


def _picked(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``uid`` (a number that ascends within a partition) is in ``uids``.
    A broadcast bit for each row of ``rows`` says so, in blocks of 32,768, so no text is shuffled."""
    at = F.col("uid") + 1  # positive numbers have blocks without overlap
    blocks = uids.select(F.bitmap_bucket_number(at).alias("_block"), F.bitmap_bit_position(at).alias("_at"))
    blocks = blocks.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    placed = rows.select("*", F.bitmap_bucket_number(at).alias("_block"), F.bitmap_bit_position(at).alias("_at"))
    byte = F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (F.col("_at") % 8).cast("int"))
    return placed.join(F.broadcast(blocks), "_block").where(bit == 1).drop("_block", "_at", "_bits")


class Copies:
    """Near copies among ``docs``: texts whose sets of ``shingle`` words have a Jaccard
    similarity of ``cut`` or more, and chains of such texts.

    Candidates are pairs of fingerprints (of the sets) within ``radius`` bits; each is checked
    on the whole sets. Two sets of similarity 0.8 differ in 9.7 of 64 bits on average with a
    deviation of 2.9, so that a radius of 14 holds 95 % of pairs at the cut itself and nearly
    all above it. Equal sets are one node however many rows have them. Pairs are checked in
    two rounds: each node with its nearest partner in every block, which joins a large group
    by few pairs, then those whose ends are still in different components. Of these only pairs
    leave their block whose odd sketches (512 bits) allow the similarity, which every similar
    pair's do: a large group of texts just under the cut is compared in blocks and gives few
    rows. Sketches of sets of over some 1,000 shingles are full and hold back less.

    Null texts count as empty; texts without words are alike. Ids may be null or repeated, and
    other columns, whatever their names, are carried along. ``rows`` is a written table (uid,
    doc, node), ``nodes`` one of (node, rep, component, n): rep is the least (id is null, id,
    uid) of the node's rows. An empty table gives none.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, cut: float = 0.8, radius: int = 14):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
        self.columns, self.shingle, self.cut = docs.columns, shingle, cut

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
                fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                out = b.drop_columns(["text"])
                sketch = np.array([odd_sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
                size = np.array([len(s) for s in sets], np.int64)
                for name, x in (("node", node), ("fp", fp), ("size", size), *zip(SKETCHES, np.ascontiguousarray(sketch.T), strict=True)):
                    out = out.append_column(name, pa.array(x))
                yield out

        kept = docs.select(whole, text_bytes(text_col).alias("text"))
        kind = kept.schema["doc"].dataType.simpleString()
        self.rows = written(kept.mapInArrow(of, f"doc {kind}, node long, fp long, size long, " + ", ".join(f"{c} long" for c in SKETCHES)).withColumn("uid", F.monotonically_increasing_id()), "copies")
        at = F.col("doc").getField(id_col)
        rep = F.min(F.struct(at.isNull().alias("no_id"), at.alias("id"), F.col("uid").alias("uid"))).alias("rep")
        nodes = written(self.rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", *SKETCHES)], rep, F.count("*").alias("n")), "nodes")
        self.total = nodes.agg(F.sum("n")).first()[0] or 0
        self.reps = nodes.select("node", "rep")
        probes = Probes(nodes, radius, cut=cut)
        met = probes.written_pairs(nodes, _nearest)
        first = met.where("u != v")
        room = F.ceil(F.col("size") * (1000 * (1 - cut) / (1 + cut)) + 1e-6).alias("room")  # thousandths of unshared elements, for each end
        # Pairs near by chance go by their sketches, before any text is sent.
        sketch = lambda c: nodes.select(F.col("node").alias(c), F.struct(room, *SKETCHES).alias(f"_{c}"))
        differ = sum(F.bit_count(F.col(f"_u.{k}").bitwiseXOR(F.col(f"_v.{k}"))) for k in SKETCHES)
        both = first.join(sketch("u"), "u").join(sketch("v"), "v").where(differ * 1000 <= F.col("_u.room") + F.col("_v.room"))
        links = self._similar(both.select("u", "v"), text_col)
        groups = written(connected_components(links), "groups")
        # Who met nobody in the first round meets nobody now.
        asks = met.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("asks", F.lit(True))
        placed = nodes.join(groups, "node", "left").join(asks, "node", "left")
        placed = placed.select("node", "fp", "size", F.coalesce("component", "node").alias("c"), F.coalesce("asks", F.lit(False)).alias("asks"), room, *SKETCHES)
        placed = written(placed, "placed")
        second = probes.written_pairs(placed, _possible)
        more = self._similar(second.join(first, ["u", "v"], "left_anti"), text_col)
        for t in (met, second, placed):
            drop_written(t)
        probes.tables.destroy()
        # The stars of the first round stand for its links.
        stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        comp = nodes.join(connected_components(stars.unionByName(more)), "node", "left")
        self.nodes = written(comp.select("node", "rep", "n", F.coalesce("component", "node").alias("component")), "classes")
        for t in (links, more, groups, nodes):
            drop_written(t)

    def _similar(self, pairs: DataFrame, text_col: str) -> DataFrame:
        """Those of ``pairs`` (u, v) whose sets have a similarity of ``cut`` or more."""
        shingle, cut = self.shingle, self.cut
        pairs = written(pairs, "near")
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        reps = self.reps.join(ends, "node", "left_semi").select(F.col("rep.uid").alias("uid"))
        texts = _picked(self.rows.select("uid", "node", F.col("doc").getField(text_col).alias("text")), reps)
        texts = written(texts.select("node", text_bytes("text")), "texts")

        def beside(rows: DataFrame, end: str, share: int = 64) -> DataFrame:
            """``rows`` with the text of one end. A node of many pairs has a copy of its text for
            every ``share`` of them."""
            parts = pairs.groupBy(end).agg(F.ceil(F.count("*") / share).cast("int").alias("_parts"))
            named = texts.withColumnsRenamed({"node": end, "text": f"text_{end}"}).join(parts, end)
            named = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
            dealt = rows.join(parts, end).withColumn("_part", F.pmod(F.xxhash64("u", "v"), F.col("_parts")).cast("int")).drop("_parts")
            return dealt.join(named, [end, "_part"]).drop("_part")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}
            held = 0  # bytes

            def set_of(node, text):
                nonlocal held
                if node not in known:
                    if held > 32 << 20:
                        known.clear()
                        held = 0
                    known[node] = np.unique(shingle_hashes(text, shingle))
                    held += known[node].nbytes + 200
                return known[node]

            for b in chunks(chunks(batches, "text_u"), "text_v"):
                u, v, a, c = (b.column(k).to_pylist() for k in range(4))
                good = [similar(set_of(*x), set_of(*y), cut) for x, y in zip(zip(u, a, strict=True), zip(v, c, strict=True), strict=True)]
                yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

        joined = beside(beside(pairs, "u"), "v").select("u", "v", "text_u", "text_v")
        out = written(joined.mapInArrow(of, "u long, v long"), "links")
        drop_written(pairs)
        drop_written(texts)
        return out

    def classes(self, keep: dict[str, Column] | None = None) -> DataFrame:
        """One row per document: ``keep`` (expressions over ``doc``) and component_id, the
        least id of the class (null if it has none)."""
        ids = self.nodes.groupBy("component").agg(F.min("rep").getField("id").alias("component_id"), F.count("*").alias("m"))
        of_node = written(join_counted(self.nodes, ids, ["component"], "m", self.total).select("node", "n", "component_id"), "ids")
        return join_counted(self.rows, of_node, ["node"], "n", self.total).select(*[c.alias(k) for k, c in (keep or {"doc_id": F.col("doc.doc_id")}).items()], "component_id")

    def first_of_each(self) -> DataFrame:
        """``docs`` with one row of each class: the least id; of its repeated rows one."""
        stay = self.nodes.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.uid").alias("uid"))
        return _picked(self.rows, stay).select("doc.*")
