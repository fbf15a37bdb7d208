"""Sharding by best-fit-decreasing bin packing of indivisible groups.

``best_fit_decreasing`` puts groups, sorted by size, into the bin with the tightest remaining capacity, which a
balanced tree (a treap over remaining capacities) finds in logarithmic time. Over a large table the packed items are
the few groups above a fixed share of all bytes, each by itself, and bundles of all other
groups. There are more bundles for more rows, so that none holds much more than ``BUNDLE_ROWS``, and at most ``MOST_BUNDLES``, so that the driver
sees a bounded list. Groups never split: a bundle is the set of groups whose hash falls into it.

Slots are counted in parallel: a shard's rows lie in cells (bundles, or salted slices of a large group),
each cell numbers its own rows and starts where the cells before it end.

Defined results: a null text has no bytes and groups with the empty text; equal rows get different slots;
an empty table gives no rows; rows of a null id are numbered like others.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written

LEAST_BUNDLES, MOST_BUNDLES = 8192, 1 << 18
BUNDLE_ROWS = 32_768
SLICES = 64
#: A group above 1 / (LARGE x shards) of all bytes is packed by itself; there are fewer than LARGE x shards of them.
LARGE = 64


class Treap:
    """A balanced search tree of (remaining capacity, bin) with a ceiling search."""

    __slots__ = ("key", "priority", "left", "right")

    def __init__(self, key: tuple[int, int], priority: float):
        self.key, self.priority = key, priority
        self.left: Treap | None = None
        self.right: Treap | None = None


def _split(node: Treap | None, key: tuple[int, int]) -> tuple[Treap | None, Treap | None]:
    if node is None:
        return None, None
    if node.key < key:
        a, node_right = _split(node.right, key)
        node.right = a
        return node, node_right
    node_left, b = _split(node.left, key)
    node.left = b
    return node_left, node


def _merge(a: Treap | None, b: Treap | None) -> Treap | None:
    if a is None or b is None:
        return a or b
    if a.priority > b.priority:
        a.right = _merge(a.right, b)
        return a
    b.left = _merge(a, b.left)
    return b


def _ceiling(node: Treap | None, need: int) -> tuple[int, int] | None:
    best = None
    while node is not None:
        if node.key[0] >= need:
            best, node = node.key, node.left
        else:
            node = node.right
    return best


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size and the number of bins of that capacity; larger items than capacity get a bin of their own size."""
    rng = random.Random(0)
    root: Treap | None = None
    bins, used = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = _ceiling(root, sizes[i])
        if found is None:
            room, b = max(capacity, sizes[i]), used
            used += 1
        else:
            room, b = found
            low, rest = _split(root, found)
            _, high = _split(rest, (room, b + 1))
            root = _merge(low, high)
        bins[i] = b
        key = (room - sizes[i], b)
        low, high = _split(root, key)
        root = _merge(_merge(low, Treap(key, rng.random())), high)
    return bins, used


def into_shards(sizes: Sequence[int], shards: int) -> list[int]:
    """Best-fit decreasing at the least capacity at which the items fit into so many bins.

    An item above an even share has a bin to itself, and the share of the others is counted again without it.
    """
    bins = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    own, left = 0, sum(sizes)
    while own < min(shards - 1, len(order)) and sizes[order[own]] * (shards - own) >= left:
        bins[order[own]] = own
        left -= sizes[order[own]]
        own += 1
    rest = sorted(order[own:])
    if not rest:
        return bins
    items = [sizes[i] for i in rest]
    low = max(max(items), -(-sum(items) // (shards - own)))
    high = 2 * low
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(items, middle)[1] <= shards - own:
            high = middle
        else:
            low = middle + 1
    for i, b in zip(rest, best_fit_decreasing(items, high)[0]):
        bins[i] = own + b
    return bins


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", bundles: int | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, group, shard, slot): sizes (UTF-8 bytes + 1) near equal over shards, equal texts together."""
    spark = df.sparkSession
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = written(df.select(col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("group")), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    bundles = bundles or min(MOST_BUNDLES, max(LEAST_BUNDLES, n // BUNDLE_ROWS))
    bundle = F.pmod("group", F.lit(bundles))
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    least = total // (LARGE * shards) + 1
    large = {g: b for g, b in groups.filter(F.col("bytes") >= least).select("group", "bytes").collect()}  # fewer than LARGE x shards rows
    known = spark.createDataFrame([(g, i) for i, g in enumerate(sorted(large))], "large long, nth int")
    placed = rows.join(F.broadcast(known), F.col("group") == F.col("large"), "left").drop("large")  # at most LARGE x shards rows
    cell = F.when(F.col("nth").isNull(), bundle).otherwise(F.lit(bundles) + F.col("nth") * SLICES + slice_).cast("int")
    placed = placed.withColumn("cell", cell)
    cells = sorted(placed.groupBy("cell").agg(F.sum("size"), F.count("*")).collect())  # at most bundles + LARGE x shards x SLICES rows
    items: dict[tuple[int, int], list[tuple[int, int]]] = {}
    sizes: dict[tuple[int, int], int] = {}
    for c, size, n in cells:
        unit = (0, c) if c < bundles else (1, (c - bundles) // SLICES)
        items.setdefault(unit, []).append((c, n))
        sizes[unit] = sizes.get(unit, 0) + size
    units = sorted(items)
    of = dict(zip(units, into_shards([sizes[u] for u in units], shards)))
    begin = [0] * shards
    plan = []
    for u in units:
        for c, n in items[u]:
            plan.append((c, of[u], begin[of[u]]))
            begin[of[u]] += n
    starts = spark.createDataFrame(plan, "cell int, shard int, begin long")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "group", "size")))
    return numbered.join(F.broadcast(starts), "cell").select("doc_id", "size", "text_crc32", "group", "shard", (F.col("begin") + F.col("nth") - 1).alias("slot"))  # as many rows as cells
