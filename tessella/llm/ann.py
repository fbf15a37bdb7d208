"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of bits (signs of random projections). A tree is one sorted array of these strings,
laid out over the cluster by prefix: rows that share a prefix of ``depth`` bits lie in one cell, sorted by their
strings. A query descends to its longest match in each tree's array; all trees then ascend together, one bit at a time, until the ranges of
rows that share so long a prefix hold ``wanted`` rows in sum. A query among many rows stops at a long prefix, one among few climbs further. The
rows of these ranges are the candidates, and are compared exactly.

The number of trees and ``wanted`` are measured, not assumed: true neighbours of a bounded set of queries are found among all rows by brute
force, and so are the sizes of these queries' ranges at each level; ``wanted`` is what finds the target share of those neighbours, and the number of
trees what costs least then.

Of equal vectors only the k + 1 smallest ids can be results; the others leave before the search. Cells that hold too much are cut into slices
of rows and of queries that meet in a grid of blocks; nothing is capped. Queries whose ranges don't fill within a cell, or that found fewer than k
rows, search all rows in blocks.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, nor do rows of a null id; vectors
of different lengths never meet; rows with the query's id are no candidates; repeated rows of one id count once, with the best score of
any two of their vectors; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, drop, written

CELL = 8192
#: Numbers of trees to choose from.
TREES = (8, 16, 32, 48)
MOST_TREES = TREES[-1]
RECALL = 0.95
SAMPLE_QUERIES = 128
#: Longer common prefixes count as so many bits.
LEVELS = 48
#: Sending a row to one tree costs about as much as comparing so many pairs.
ENTRY_PAIRS = 20
#: Crowded cells are sent to workers as a list of at most so many entries; beyond it, the limit that makes a cell crowded doubles.
MOST_CROWDED = 50_000
_HIT = "query_id long, vec_id long, score double"
_HIT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """For each tree 64 random directions."""
    return np.random.default_rng([seed, dim]).normal(size=(trees, 64, dim))


def hash_strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """The 64-bit string of each vector in each tree."""
    out = np.empty((len(vectors), trees), np.uint64)
    for t, p in enumerate(planes(vectors.shape[1], trees, seed)):
        out[:, t] = np.ascontiguousarray(np.packbits(vectors @ p.T > 0, axis=1)).view(">u8")[:, 0]
    return out


def _codes(vector: Column, trees: int, seed: int) -> Column:
    @F.arrow_udf("array<long>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.offsets))
            found = np.empty((len(batch), trees), np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                found[at] = hash_strings(_matrix(batch.take(pa.array(at))), trees, seed)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * trees + 1, trees), pa.int32()), pa.array(found.ravel().view(np.int64)))

    return code(vector)


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.Table:
    """For each query its k nearest of the rows by cosine, ties to the smaller id; the query's own id left out."""
    out_q, out_v, out_s = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    if len(ids) > 1:
        fresh = np.concatenate(([True], ids[1:] != ids[:-1]))
        ids, rows = ids[fresh], rows[fresh]
    q_norm, r_norm = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    unit = (rows / r_norm[:, None]).T
    for at in range(0, len(queries), 256):
        rough = (queries[at : at + 256] / q_norm[at : at + 256, None]) @ unit
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i, line in enumerate(rough):
            q = at + i
            if len(line) > k:
                near = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k] - 1e-9)
            else:
                near = np.arange(len(line))
            near = near[line[near] > -np.inf]
            exact = (rows[near] * queries[q]).sum(axis=1) / (q_norm[q] * r_norm[near])
            best = np.lexsort((ids[near], -exact))[:k]
            out_q.append(np.full(len(best), query_ids[q]))
            out_v.append(ids[near][best])
            out_s.append(exact[best])
    join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
    return pa.Table.from_arrays([join(out_q, pa.int64()), join(out_v, pa.int64()), join(out_s, pa.float64())], schema=_HIT_ARROW)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; a hit that several trees found counts once."""
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sample_search(valid: DataFrame, sample: list, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (id, vector)."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in sample:
        ids, vectors = by.setdefault(len(v), ([], []))
        ids.append(i)
        vectors.append(v)
    ready = {d: (np.array(i, np.int64), np.array(v, np.float64)) for d, (i, v) in by.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(sizes).tolist():
                if dim in ready:
                    at = pa.array(np.flatnonzero(sizes == dim))
                    yield from nearest(*ready[dim], batch.column(0).take(at).to_numpy(), _matrix(batch.column(1).take(at)), k).to_batches()

    return _ranked(valid.select("vec_id", "v").mapInArrow(search, _HIT), k)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading bits that two strings share."""
    differ = a ^ b
    bits = np.unpackbits(np.ascontiguousarray(differ.astype(">u8")).view(np.uint8).reshape(*differ.shape, 8), axis=-1)
    return np.where(bits.any(axis=-1), bits.argmax(axis=-1), 64)


@dataclass(frozen=True)
class Plan:
    """trees; wanted: what ranges must hold in sum; depth: bits of a cell's prefix; least and most: the levels at which sampled queries stop."""

    trees: int
    wanted: int
    depth: int
    least: int
    most: int


def plan_forest(shared: np.ndarray, of: np.ndarray, totals: np.ndarray, rows: int, queries: int, recall: float = RECALL, cell: int = CELL) -> Plan:
    """The cheapest forest that finds at least recall of the sampled neighbours.

    shared: the prefix that each pair of neighbours has in each tree; of: the pair's query, a row of totals; totals: for each query and choice
    of TREES the rows within the ranges of all trees at each level, 0 to LEVELS.
    """
    if not len(shared):
        return Plan(TREES[0], 1, 0, 0, 0)
    best = None
    for n, trees in enumerate(TREES):
        level = np.minimum(shared[:, :trees].max(axis=1), LEVELS)
        sizes = np.unique(totals[:, n])
        low, high = 0, len(sizes) - 1  # the least size that finds enough: more wanted, more found
        while low < high:
            middle = (low + high) // 2
            if (level >= stops(totals[:, n], max(1, int(sizes[middle])))[of]).mean() >= recall:
                high = middle
            else:
                low = middle + 1
        wanted = max(1, int(sizes[high]))
        stop = stops(totals[np.unique(of), n], wanted)
        cost = trees * rows * ENTRY_PAIRS + queries * float(totals[np.unique(of), n, stop].mean())
        if best is None or cost < best[0]:
            density = int(math.log2(rows / cell)) if rows > cell else 0
            best = cost, Plan(trees, wanted, max(0, min(density, int(stop.min()) - 1)), int(stop.min()), int(stop.max()))
    return best[1]


def stops(totals: np.ndarray, wanted: int) -> np.ndarray:
    """The level at which each query's ascent stops: the longest prefix whose ranges hold wanted rows in sum, else 0. totals: queries by levels from 0."""
    enough = totals >= wanted
    return np.where(enough.any(axis=1), totals.shape[1] - 1 - enough[:, ::-1].argmax(axis=1), 0)


def ranges(strings: np.ndarray, queries: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the rows of a sorted array that share level bits with each query."""
    shift = (64 - np.minimum(level, 64)).astype(np.uint64)
    rest = np.where(shift == 64, np.uint64((1 << 64) - 1), (np.uint64(1) << np.minimum(shift, np.uint64(63))) - np.uint64(1))
    low = queries & ~rest
    return np.searchsorted(strings, low), np.searchsorted(strings, low | rest, side="right")


def _met(left: DataFrame, right: DataFrame, keys: list[str], block, schema: str) -> DataFrame:
    """block(queries, rows) over the queries of left and the rows of right within equal keys."""
    right = right.select(*[F.col(c).alias(f"held_{c}") for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"held_{c}" for c in keys])).applyInArrow(block, schema)


def _all_in_block(k: int):
    def block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _HIT_ARROW.empty_table()
        return nearest(queries["query_id"].to_numpy(), _matrix(queries["v"]), rows["held_vec_id"].to_numpy(), _matrix(rows["held_v"]), k)

    return block


def _candidates_in_block(k: int):
    def block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _HIT_ARROW.empty_table()
        q_id, q, r_id, r = queries["query_id"].to_numpy(), _matrix(queries["v"]), rows["held_vec_id"].to_numpy(), _matrix(rows["held_v"])
        strings, asked = rows["held_code"].to_numpy().view(np.uint64), queries["code"].to_numpy().view(np.uint64)
        order = np.argsort(strings, kind="stable")
        strings, r_id, r = strings[order], r_id[order], r[order]
        spans, which = np.unique(np.stack(ranges(strings, asked, queries["level"].to_numpy()), axis=1), axis=0, return_inverse=True)
        parts = []
        for i, (lo, hi) in enumerate(spans.tolist()):
            at = np.flatnonzero(which.ravel() == i)
            if hi > lo:
                parts.append(nearest(q_id[at], q[at], r_id[lo:hi], r[lo:hi], k))
        return pa.concat_tables(parts) if parts else _HIT_ARROW.empty_table()

    return block


def _sizes_in_block(levels: range):
    names = ["query_row", *(f"n{x}" for x in levels)]

    def block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, asked = queries["query_row"].to_numpy(), queries["code"].to_numpy().view(np.uint64)
        strings = np.sort(rows["held_code"].to_numpy().view(np.uint64))
        sizes = [np.subtract(*ranges(strings, asked, np.full(len(asked), x))[::-1]) for x in levels]
        return pa.Table.from_arrays([pa.array(a, pa.int64()) for a in (own, *sizes)], names=names)

    return block, ", ".join(f"{n} long" for n in names)


def _shared_prefixes(held: DataFrame, sample: list, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sampled query and each of its true neighbours the prefix that they share in each tree, and the query's place in the sample."""
    spark = held.sparkSession
    near = [(q, v) for q, v in _sample_search(held, sample, k).select("query_id", "vec_id").collect()]  # at most SAMPLE_QUERIES x k
    none = np.zeros((0, MOST_TREES), np.int64), np.zeros(0, np.int64)
    if not near:
        return none
    wanted = spark.createDataFrame([(v,) for v in sorted({v for _, v in near})], "wanted long")
    vectors = {i: v for i, v in held.join(F.broadcast(wanted), F.col("vec_id") == F.col("wanted"), "left_semi").groupBy("vec_id").agg(F.first("v")).collect()}  # as many rows as wanted
    place = {i: (n, v) for n, (i, v) in enumerate(sample)}
    out, of = [], []
    for q, v in near:
        n, own = place[q]
        if len(own) == len(vectors[v]):
            pair = hash_strings(np.array([own, vectors[v]], np.float64), MOST_TREES, seed)
            out.append(common_prefix(pair[0], pair[1]))
            of.append(n)
    return (np.array(out).reshape(-1, MOST_TREES), np.array(of, np.int64)) if out else none


def _sample_totals(held: DataFrame, sample: list, seed: int) -> np.ndarray:
    """For each sampled query and choice of TREES: the rows within the ranges of all trees at each level, 0 to LEVELS."""
    out = np.zeros((len(sample), len(TREES), LEVELS + 1), np.int64)
    by: dict[int, list[int]] = {}
    for n, (_, v) in enumerate(sample):
        by.setdefault(len(v), []).append(n)
    asked = {d: (np.array(at), hash_strings(np.array([sample[n][1] for n in at], np.float64), MOST_TREES, seed)) for d, at in by.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(out)
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(0).offsets))
            for dim in set(np.unique(sizes).tolist()) & set(asked):
                at, strings = asked[dim]
                rows = np.sort(hash_strings(_matrix(batch.column(0).take(pa.array(np.flatnonzero(sizes == dim)))), MOST_TREES, seed), axis=0)
                each = np.zeros((MOST_TREES, len(at), LEVELS + 1), np.int64)
                for t in range(MOST_TREES):
                    begin, end = ranges(np.ascontiguousarray(rows[:, t]), np.repeat(strings[:, t], LEVELS + 1), np.tile(np.arange(LEVELS + 1), len(at)))
                    each[t] = (end - begin).reshape(len(at), -1)
                each = each.cumsum(axis=0)
                for n, trees in enumerate(TREES):
                    sums[at, n] += each[trees - 1]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums.ravel()[some])], names=["at", "n"])

    for at, n in held.select("v").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # of fixed size
        out.reshape(-1)[at] = n
    return out


def _grid(asked: DataFrame, held: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """asked and held with slices r and s of crowded cells (t, dim, cell): each slice of rows meets each slice of queries."""
    keys = ["t", "dim", "cell"]
    counts = held.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(asked.groupBy(*keys).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
    counts = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    limit = 2 * cell
    while True:
        crowded = counts.filter((F.col("n") > limit) | (F.col("m") > limit)).limit(MOST_CROWDED + 1).collect()
        if len(crowded) <= MOST_CROWDED:
            break
        limit *= 2
    each = limit // 2
    slices = asked.sparkSession.createDataFrame([(t, d, c, max(1, -(-n // each)), max(1, -(-m // each))) for t, d, c, n, m in crowded], "t int, dim int, cell long, rs long, qs long")

    def sliced(df: DataFrame, own: str, number: str, across: str, other: str, key: str) -> DataFrame:
        df = df.join(F.broadcast(slices), keys, "left")  # at most MOST_CROWDED rows
        df = df.withColumns({"rs": F.coalesce("rs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
        return df.withColumn(own, F.pmod(F.xxhash64(key), number)).withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("rs", "qs")

    return sliced(asked, "s", "qs", "r", "rs", "query_row"), sliced(held, "r", "rs", "s", "qs", "vec_id")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = RECALL, cell: int = CELL, seed: int = 1) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query row its k nearest other rows by cosine."""
    kind = "array<float>" if df.select(col(vector_col)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    own = df.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    valid = written(own.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    copies = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))  # Spark limits the groups before the shuffle too
    held = written(valid.select("vec_id", "v").withColumn("nth", copies).filter(F.col("nth") <= k + 1).drop("nth"), "rows")
    queries = valid.filter("q").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v")
    rows, n_queries = held.count(), queries.count()
    sample = [tuple(r) for r in queries.groupBy("query_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES).collect()]
    plan = plan_forest(*_shared_prefixes(held, sample, k, seed), _sample_totals(held, sample, seed), rows, n_queries, recall, cell)

    def entries(frame: DataFrame, *columns: str) -> DataFrame:
        out = frame.select(*columns, "v", F.size("v").alias("dim"), F.posexplode(_codes(F.col("v"), plan.trees, seed)).alias("t", "code"))
        return out.withColumn("cell", F.shiftrightunsigned("code", 64 - plan.depth) if plan.depth else F.lit(0).cast("long"))

    asked, there = _grid(entries(queries, "query_row", "query_id"), entries(held, "vec_id"), cell)
    keys = ["t", "dim", "cell", "r", "s"]
    levels = range(plan.depth, min(64, plan.most + 4) + 1)
    sizes = _met(asked.select(*keys, "query_row", "code"), there.select(*keys, "code"), keys, *_sizes_in_block(levels))
    sizes = sizes.groupBy("query_row").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in levels])
    level = F.coalesce(*[F.when(F.col(f"n{x}") >= plan.wanted, x) for x in reversed(levels)], *([] if plan.depth else [F.lit(0)]))  # null: the cells don't hold enough
    stopped = written(sizes.select("query_row", level.cast("int").alias("level")), "levels")
    hits = _met(asked.join(stopped.filter("level is not null"), "query_row").select(*keys, "code", "level", "query_id", "v"), there.select(*keys, "code", "vec_id", "v"), keys, _candidates_in_block(k), _HIT)
    hits = written(_ranked(hits, k), "hits")
    found = hits.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("full"))
    short = queries.join(stopped.filter("level is not null").select("query_row"), "query_row", "left_anti").unionByName(queries.join(found, F.col("query_id") == F.col("full"), "left_anti"))
    n_short = short.count() if rows > k else 0
    if n_short:
        hits = _ranked(hits.select("query_id", "vec_id", "score").unionByName(_exact(short, held, n_short, rows, k, cell)), k)
    else:
        drop(valid, held, stopped)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _exact(queries: DataFrame, held: DataFrame, n: int, rows: int, k: int, cell: int) -> DataFrame:
    """The nearest of all rows for n queries, in blocks."""
    dim, zero = F.size("v").alias("dim"), F.lit(0).cast("long")
    rs, qs = max(1, -(-rows // cell)), max(1, -(-n // cell))
    asked = queries.select(dim, F.pmod(F.xxhash64("query_id"), F.lit(qs)).alias("s"), F.explode(F.sequence(zero, F.lit(rs - 1).cast("long"))).alias("r"), "query_id", "v")
    there = held.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(rs)).alias("r"), F.explode(F.sequence(zero, F.lit(qs - 1).cast("long"))).alias("s"), "vec_id", "v")
    return _met(asked, there, ["dim", "r", "s"], _all_in_block(k), _HIT)
