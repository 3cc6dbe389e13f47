"""Shards of near equal size by best-fit decreasing; equal texts stay together.

Groups of equal texts are indivisible, and every group is packed. Groups of one size are
interchangeable, so the packing works on the histogram of sizes: best-fit decreasing puts a
group into the tightest shard with room through a balanced tree, and as that shard stays the
tightest until it is full, as many groups of the size as it holds go at once. Distinct sizes
are at most the root of twice all bytes. Groups get their shard by their rank within their
size. Groups that alone exceed an equal share get shards of their own; the rest is packed at
the smallest capacity that needs no more than the shards that remain.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop_written, join_counted, written


class _Node:
    __slots__ = ("key", "left", "rank", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class RoomTree:
    """Balanced search tree (a treap) of (room left, bin)."""

    def __init__(self, seed: int = 0):
        self.root, self.draw = None, random.Random(seed).random

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, b = self._split(node.right, key)
            return node, b
        a, node.left = self._split(node.left, key)
        return a, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, room: int, bin_: int) -> None:
        a, b = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(a, _Node((room, bin_), self.draw())), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest bin with at least ``size`` room."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        node, above = b, None
        while node.left is not None:
            above, node = node, node.left
        if above is None:
            b = node.right
        else:
            above.left = node.right
        self.root = self._join(a, b)
        return node.key


Run = tuple[int, int, int]  # size, number of groups, bin


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """sizes: (size, how many), in descending order. Where they go, as runs in that order, and
    how many bins are used; items over ``capacity`` are an error."""
    if sizes and sizes[0][0] > capacity:
        raise ValueError("an item exceeds the capacity")
    tree, runs, bins = RoomTree(), [], 0
    for size, left in sizes:
        while left:
            got = tree.take(size)
            room, b = got if got else (capacity, bins)
            bins += got is None
            n = min(left, room // size)
            runs.append((size, n, b))
            tree.add(room - n * size, b)
            left -= n
    return runs, bins


def balance(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """sizes: (size, how many), in descending order. A shard for each group: the smallest
    capacity at which best-fit decreasing needs no more than the given shards. Groups over an
    equal share of what is left stand alone."""
    left, free, total, used, out = list(sizes), shards, sum(s * n for s, n in sizes), 0, []
    while left and free > 1 and left[0][0] * free >= total:
        size, n = left[0]
        out.append((size, 1, used))
        left = left[1:] if n == 1 else [(size, n - 1), *left[1:]]
        total, used, free = total - size, used + 1, free - 1
    if left:
        # At an equal share and the largest size no group is ever without room.
        low, high = max(-(-total // free), left[0][0]), -(-total // free) + left[0][0]
        best = best_fit_decreasing(left, high)[0]
        while low < high and high - low > total // (free * 100_000):
            mid = (low + high) // 2
            runs, n = best_fit_decreasing(left, mid)
            if n <= free:
                best, high = runs, mid
            else:
                low = mid + 1
        out += [(size, n, used + b) for size, n, b in best]
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000) -> DataFrame:
    """id, size (bytes of the text plus 1), text_crc32, shard, slot (gapless in a shard).

    A null text has size 1 and the checksum of the empty text, and is a group of its own
    beside empty texts. Null and repeated ids and repeated rows keep their rows. An empty
    table gives an empty table; other columns are not read.
    """
    text = F.col(text_col)
    base = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("digest"),
        ),
        "texts",
    )
    groups = written(base.groupBy("digest").agg(F.sum("size").alias("total"), F.count("*").alias("n")), "groups")
    hist = groups.groupBy("total").agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).orderBy(F.desc("total")).collect()  # distinct sizes
    n = sum(r["rows"] for r in hist)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, many, to in balance([(r["total"], r["groups"]) for r in hist], shards):
        mine = runs.setdefault(size, [])
        first = mine[-1][2] if mine else 0
        mine.append((size, first, first + many, to))
    spark = docs.sparkSession
    table = spark.createDataFrame([r for rs in runs.values() for r in rs], "total long, first long, last long, shard int")
    table = F.broadcast(table) if len(hist) <= 200_000 else table
    # The rank of a group within its size, by parts of about ``rows`` groups.
    counts = {r["total"]: r["groups"] for r in hist if r["groups"] > rows}
    part = F.lit(0)
    if counts:  # fewer sizes than groups / rows
        heavy = spark.createDataFrame([(s, -(-c // rows)) for s, c in counts.items()], "total long, parts int")
        groups = groups.join(F.broadcast(heavy), "total", "left")
        part = F.coalesce(F.pmod(F.xxhash64("digest", F.lit(3)), F.col("parts")), F.lit(0)).cast("int")
    groups = groups.select("digest", "total", "n", part.alias("part"))
    before = groups.groupBy("total", "part").agg(F.count("*").alias("many"))
    before = before.select("total", "part", (F.sum("many").over(Window.partitionBy("total").orderBy("part")) - F.col("many")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("total", "part").orderBy("digest")) - 1
    ranked = groups.withColumn("at", rank).join(before, ["total", "part"]).withColumn("rank", F.col("at") + F.col("before"))
    ranked = ranked.join(table, "total").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    of_group = written(ranked.select("digest", "n", "shard"), "shards")
    placed = join_counted(base, of_group, ["digest"], "n", n)
    placed = written(placed.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(max(16, n // rows)))), "placed")
    drop_written(base)
    counts_ = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = counts_.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("ahead"))
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "digest")) - 1
    return placed.withColumn("at", at).join(ahead, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") + F.col("ahead")).cast("long").alias("slot")
    )
