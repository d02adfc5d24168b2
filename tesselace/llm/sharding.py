"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal text) are packed by the bytes of the whole group. The packing itself needs only the
histogram (group bytes, number of groups): groups of one size are interchangeable, so a run of k groups enters
a bin in one step. The histogram is what reaches the driver. It has at most sqrt(2 * total bytes) rows, since
distinct sizes add up to no more than the total. Which group of a size goes where follows from its rank in that
size, which is computed by hash bucket, so that neither a frequent size nor a frequent text meets in one task.

Null text counts as empty. Repeated rows of one doc_id are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ranked

#: Bytes that a row costs beside its text.
OVERHEAD = 16


class _Node:
    __slots__ = ("key", "priority", "left", "right")

    def __init__(self, key, priority):
        self.key, self.priority, self.left, self.right = key, priority, None, None


class Treap:
    """Balanced search tree over (remaining capacity, bin); priorities are a hash of the insertion number."""

    def __init__(self):
        self.root, self.count = None, 0

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, b = self._split(node.right, key)
            return node, b
        a, node.left = self._split(node.left, key)
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, key) -> None:
        self.count += 1
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, _Node(key, self.count * 0x9E3779B97F4A7C15 % 2**64)), b)

    def pop_at_least(self, key):
        """Remove and return the least key that is not below the given one; None if there is none."""
        a, b = self._split(self.root, key)
        if b is None:
            self.root = a
            return None
        least = b
        while least.left is not None:
            least = least.left
        _, rest = self._split(b, (least.key[0], least.key[1] + 1))
        self.root = self._merge(a, rest)
        return least.key


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None):
    """Pack (size, count) classes, largest first; each item enters the bin with the least room that holds it.

    Returns runs (size, first rank, end rank, bin) or None if `bins` bins of that capacity do not suffice.
    Without `bins`, a bin is opened whenever no open one holds the item; an item above the capacity has its own.
    """
    tree, runs, opened = Treap(), [], 0
    if bins is not None:
        for opened in range(bins):
            tree.insert((capacity, opened))
        opened = bins
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.pop_at_least((size, -1))
            if found is None:
                if bins is not None:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, number = found
            k = min(count - rank, room // size)
            runs.append((size, rank, rank + k, number))
            tree.insert((room - k * size, number))
            rank += k
    return runs


def pack_into(sizes: list[tuple[int, int]], bins: int):
    """Runs for exactly `bins` bins: the least capacity for which best-fit-decreasing succeeds.

    A group larger than the mean load of the bins that are left has a bin of its own, and the capacity is found
    for the others.
    """
    left, own, number = sorted(sizes, reverse=True), [], 0
    total = sum(s * c for s, c in left)
    while left and bins - number > 1 and left[0][0] * (bins - number) > total:
        size, count = left[0]
        rank = own[-1][2] if own and own[-1][0] == size else 0
        own.append((size, rank, rank + 1, number))
        number, total = number + 1, total - size
        left = [(size, count - 1), *left[1:]] if count > 1 else left[1:]
    if not left:
        return own
    shift = {size: end for size, _, end, _ in own}
    low, high = max(left[0][0], -(-total // (bins - number))), total
    best = best_fit_decreasing(left, high, bins - number)
    while low < high:
        middle = (low + high) // 2
        if found := best_fit_decreasing(left, middle, bins - number):
            best, high = found, middle
        else:
            low = middle + 1
    return own + [(s, a + shift.get(s, 0), b + shift.get(s, 0), n + number) for s, a, b, n in best]


def shard_documents(docs: DataFrame, shards: int = 40, hot_share: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; equal texts share a shard.

    law is `bytes`. grown_shard is null under that law. A text with more than 1/hot_share of the rows is joined
    by broadcast (there are fewer than hot_share of them), the others by shuffle.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes")), "shard-groups")
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")).collect()
    total = sum(r.n_rows for r in histogram)
    runs = pack_into([(r.bytes, r.n) for r in histogram], shards)
    schema = "bytes long, first_rank long, end_rank long, shard int"
    plan = spark.createDataFrame(runs, schema)
    placed = materialise(
        ranked(groups, ["bytes"], ["digest"], "group_rank", max(1, total // 2_000_000))
        .join(plan, "bytes")
        .where((F.col("group_rank") >= F.col("first_rank")) & (F.col("group_rank") < F.col("end_rank")))
        .select("digest", "n_rows", "shard"),
        "shard-placed",
    )
    hot = F.broadcast(placed.where(F.col("n_rows") > total // hot_share).select("digest", "shard"))
    cold = placed.where(F.col("n_rows") <= total // hot_share).select("digest", "shard")
    dealt = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return ranked(dealt.drop("digest"), ["shard"], ["doc_id", "text_crc32"], "slot", max(16, total // 10_000_000)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
