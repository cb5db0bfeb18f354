"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of one text. Groups of at least 1 / ITEMS of all bytes
(so at most ITEMS of them) are items of their own; the smaller ones are bundled
by hash into ITEMS bundles, which are indivisible too. So at most 2 * ITEMS items
come to the driver, whatever the input. Items sorted by falling size enter the
bin with the tightest remaining capacity, found in a balanced tree; the capacity
is the smallest one (by bisection) for which the items fill at most the wanted
number of shards.

Defined cases: null text has size 1 and is of the empty text's group; repeated
rows are documents of their own; an empty table gives an empty result. A group
larger than an even share makes its shard larger than the others, as groups are
not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, keyed

ITEMS = 8192


class RemainingTree:
    """An AVL tree of (remaining capacity, bin), for best fit in logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n[3] if n else 0

    @classmethod
    def _make(cls, left, key, right):
        """A balanced node of two trees whose heights differ by at most two."""
        if cls._h(left) > cls._h(right) + 1:
            ll, lk, lr, _ = left
            if cls._h(ll) >= cls._h(lr):
                return cls._node(ll, lk, cls._node(lr, key, right))
            return cls._node(cls._node(ll, lk, lr[0]), lr[1], cls._node(lr[2], key, right))
        if cls._h(right) > cls._h(left) + 1:
            rl, rk, rr, _ = right
            if cls._h(rr) >= cls._h(rl):
                return cls._node(cls._node(left, key, rl), rk, rr)
            return cls._node(cls._node(left, key, rl[0]), rl[1], cls._node(rl[2], rk, rr))
        return cls._node(left, key, right)

    @classmethod
    def _node(cls, left, key, right):
        return (left, key, right, 1 + max(cls._h(left), cls._h(right)))

    def add(self, key):
        def put(n):
            if n is None:
                return (None, key, None, 1)
            return self._make(put(n[0]), n[1], n[2]) if key < n[1] else self._make(n[0], n[1], put(n[2]))

        self.root = put(self.root)

    def take(self, size):
        """Removes and returns the least key of at least ``size``; None if there is none."""
        best, n = None, self.root
        while n:
            best, n = (n[1], n[0]) if n[1][0] >= size else (best, n[2])
        if best is not None:
            self.root = self._cut(self.root, best)
        return best

    @classmethod
    def _cut(cls, n, key):
        left, k, right, _ = n
        if key < k:
            return cls._make(cls._cut(left, key), k, right)
        if key > k:
            return cls._make(left, k, cls._cut(right, key))
        if left is None or right is None:
            return left or right
        low = right
        while low[0]:
            low = low[0]
        return cls._make(left, low[1], cls._cut(right, low[1]))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (given in falling order); bins open as needed."""
    tree, bins, n = RemainingTree(), [], 0
    for s in sizes:
        if (found := tree.take(s)) is None:
            found, n = (max(capacity, s), n), n + 1
        bins.append(found[1])
        tree.add((found[0] - s, found[1]))
    return bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shards of sizes in falling order, by the least capacity for which best fit needs no more shards."""
    if not sizes:
        return []
    lo, hi = max(-(-sum(sizes) // shards), sizes[0]), -(-sum(sizes) // shards) + sizes[0]
    best = best_fit_decreasing(sizes, hi)
    for _ in range(16):
        if lo >= hi:
            break
        mid = (lo + hi) // 2
        bins = best_fit_decreasing(sizes, mid)
        if max(bins) < shards:
            best, hi = bins, mid
        else:
            lo = mid + 1
    return best


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each input row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "shard")
    d = keyed(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = ws.save(d.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("g")))
    groups = ws.save(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // ITEMS))
    large = [(r[0], -1, r[1]) for r in groups.where(F.col("bytes") >= least).collect()]  # at most ITEMS
    bundle = F.pmod("g", F.lit(ITEMS)).cast("int")
    small = [(None, r[0], r[1]) for r in groups.where(F.col("bytes") < least).groupBy(bundle.alias("b")).agg(F.sum("bytes")).collect()]  # at most ITEMS
    items = sorted(large + small, key=lambda x: (-x[2], x[1], x[0] or 0))
    placed = list(zip(items, pack([x[2] for x in items], shards)))
    by_group = spark.createDataFrame([(x[0], s) for x, s in placed if x[1] < 0], "g long, own int")
    by_bundle = spark.createDataFrame([(x[1], s) for x, s in placed if x[1] >= 0], "b int, shared int")
    put = rows.withColumn("b", bundle).join(F.broadcast(by_group), "g", "left").join(F.broadcast(by_bundle), "b", "left")
    put = put.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(256)).cast("int").alias("part"))
    put = ws.save(put)
    cells = put.groupBy("shard", "part").count()  # 256 for each shard
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cells.select("shard", "part", before.alias("base"))
    k = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id")) - 1
    return put.withColumn("k", k).join(F.broadcast(base), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
