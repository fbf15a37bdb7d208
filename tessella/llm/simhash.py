"""SimHash near-duplicates through an LSH forest.

Every whole text gets a 256-bit SimHash over its distinct words, longer words weighing more. The forest is a
set of tries, each over the bits in another random order. The depth of their leaves adapts to the density, that is to the number of different
texts: from the long prefix that would isolate texts, the tries climb to that shorter one at which so many tries find a pair at the largest
distance of a link with the target recall, for the least work of sending entries and comparing those that share a leaf (``plan_forest``). A
larger table gets longer prefixes and more tries, up to ``MOST_TRIES``; beyond that leaves grow, and recall stays. Within a leaf all
pairs are verified on full signatures; a pair counts in the first trie in which it meets, so links are counted exactly once and pairs are never stored: a leaf emits link counts and the edges of a
spanning forest. Leaves of more than ``DENSE`` signatures are compared in blocks of slices, so that no task holds one whole. Equal texts, then equal signatures, are collapsed before, so a hot group of copies is one row.

Defined results: a null text is an empty text, and empty texts are copies of each other; a text without a word has itself as its only word;
repeated rows are copies; an empty table gives no rows; null ids belong to classes but name none; extra columns stay out of the
result of ``near_duplicates`` and stay in that of ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop, join_counted, written
from .components import connected_components

BITS = 256
#: Largest distance of a link for texts of FEW_WORDS[1] different words and more; for FEW_WORDS[0] and fewer it is SHORT_DISTANCE.
DISTANCE = 52
SHORT_DISTANCE = 36
FEW_WORDS = (8, 64)
LEAST_TRIES, MOST_TRIES = 16, 512
DEEPEST = 22
RECALL = 0.98
#: Sending an entry costs about as much as comparing so many pairs.
ENTRY_PAIRS = 2000
DENSE = 32_768
#: More dense leaves than this are never sent to workers: the limit DENSE doubles until they are fewer, and larger slices are compared.
MOST_PREFIXES = 100_000
#: Different words whose bits are held at once, 256 bytes each; it bounds memory only.
WORDS = 1 << 16
_WORD = re.compile(r"\w+")


def _orders() -> np.ndarray:
    """For each trie, the bits of its longest prefix, in order."""
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(BITS)[:DEEPEST] for _ in range(MOST_TRIES)])


ORDERS = _orders()


def within(words: int) -> int:
    """The largest distance of a link of a text of so many different words."""
    few, many = FEW_WORDS
    return SHORT_DISTANCE + (DISTANCE - SHORT_DISTANCE) * (min(max(words, few), many) - few) // (many - few)


def signatures(texts: list[str | None]) -> list[bytes]:
    """The signature of each whole text: 32 bytes of SimHash and one with the distance at which it still has links.

    Few words make a noisy SimHash, so texts of few different words must agree in more bits.
    """
    out: list[bytes] = []
    nth: dict[str, int] = {}
    rows: list[np.ndarray] = []
    for t in texts:
        words = set(_WORD.findall((t or "").lower())) or {t or ""}
        rows.append(np.fromiter((nth.setdefault(w, len(nth)) for w in words), np.int64, len(words)))
        if len(nth) >= WORDS:
            out += _signed(list(nth), rows)
            nth, rows = {}, []
    return out + _signed(list(nth), rows)


def _signed(words: list[str], rows: list[np.ndarray]) -> list[bytes]:
    """The signatures of texts of which each has so many of the words (rows: their numbers), WORDS words at a time."""
    import xxhash

    sums = np.zeros((len(rows), BITS), np.int32)
    for at in range(0, len(words), WORDS):
        some = words[at : at + WORDS]
        raw = [w.encode("utf-8", "surrogatepass") for w in some]
        digests = b"".join([xxhash.xxh3_128_digest(w) + xxhash.xxh3_128_digest(w, seed=1) for w in raw])
        weights = np.fromiter((max(1, min(len(w), 12) - 2) for w in some), np.int8, len(some))
        signs = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 32), axis=1).view(np.int8)
        signs = (signs * 2 - 1) * weights[:, None]
        for i, r in enumerate(rows):
            here = r if len(words) <= WORDS else r[(r >= at) & (r < at + WORDS)]
            for k in range(0, len(here), 4096):
                sums[i] += signs[here[k : k + 4096] - at].sum(axis=0, dtype=np.int32)
    return [np.packbits(s > 0).tobytes() + bytes((within(len(r)),)) for s, r in zip(sums, rows)]


def signature(text: Column) -> Column:
    """A struct (sig binary, key binary): the SimHash and a 128-bit hash of the whole text."""

    @F.arrow_udf("struct<sig:binary,key:binary>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for batch in batches:
            texts = batch.to_pylist()
            sigs = [s for at in range(0, len(texts), 500) for s in signatures(texts[at : at + 500])]
            keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8")) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())], names=["sig", "key"])

    return sign(text)


def leaves(sigs: np.ndarray, depth: int, tries: int) -> np.ndarray:
    """Per signature (rows of 33 bytes, the last no bits of it) and trie the leaf: depth permuted bits as a number."""
    bits = np.unpackbits(np.ascontiguousarray(sigs[:, :32]), axis=1)
    out = np.zeros((len(sigs), tries), np.uint32)
    for order in ORDERS[:tries, :depth].T:
        out = (out << np.uint32(1)) | bits[:, order]
    return out


def plan_forest(texts: int, distance: int) -> tuple[int, int]:
    """Depth and number of tries: those with the target recall at this distance that cost least for so many texts evenly spread.

    A pair at the distance agrees in all of depth different bits with a probability that falls with each, and must do so in one trie at least.
    """
    hit, best = 1.0, None
    for depth in range(1, DEEPEST + 1):
        hit *= (BITS - distance - depth + 1) / (BITS - depth + 1)
        miss = 1 - hit
        tries = max(LEAST_TRIES, math.ceil(math.log(1 - RECALL) / math.log(miss)) if miss > 0 else 1)
        cost = tries * (ENTRY_PAIRS + texts / 2 ** (depth + 1))
        if tries <= MOST_TRIES and (best is None or cost < best[0]):
            best = cost, depth, tries
    return best[1:]


def _sig_rows(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, 33)


def _keys(depth: int, tries: int) -> Column:
    """The leaves of a signature in all tries, as numbers trie << DEEPEST | leaf, which 31 bits hold."""
    trie = np.arange(tries, dtype=np.int32) << DEEPEST

    @F.arrow_udf("array<int>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = leaves(_sig_rows(batch), depth, tries).astype(np.int32) | trie if len(batch) else np.empty((0, tries), np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * tries + 1, tries), pa.int32()), pa.array(found.ravel()))

    return keys("sig")


def _huge_leaves(points: DataFrame, keys: Column) -> list[tuple[int, int]]:
    """Leaves (key, slices) that hold more than DENSE signatures and are compared in blocks, at most MOST_PREFIXES of them."""
    sizes = points.select(F.explode(keys).alias("key")).groupBy("key").count()
    limit = DENSE
    while True:
        found = sizes.filter(F.col("count") > limit).limit(MOST_PREFIXES + 1).collect()
        if len(found) <= MOST_PREFIXES:
            return [(key, -(-n // limit)) for key, n in found]
        limit *= 2


def _in_blocks(entries: DataFrame, huge: list[tuple[int, int]]) -> DataFrame:
    """entries with block and side: rows of a huge leaf meet those of each other slice in one block and their own slice in another."""
    slices = entries.sparkSession.createDataFrame(huge, "key int, slices long")
    cut = entries.join(F.broadcast(slices), "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))))  # at most MOST_PREFIXES rows
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1)))
    block = F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return cut.withColumns({"block": block, "side": side}).drop("slices", "own", "other")


def _near_pairs(words: np.ndarray, limit: np.ndarray, a: range, b: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows i of a and j of b, i < j, whose signatures (words, a row for each of the four) are within both limits, a tile at a time."""
    most = limit[a.start : b.stop].max()
    for i0 in range(a.start, a.stop, 64):
        i1 = min(i0 + 64, a.stop)
        for j0 in range(max(b.start, i0), b.stop, 2048):
            j1 = min(j0 + 2048, b.stop)
            far = np.bitwise_count(words[0, i0:i1, None] ^ words[0, None, j0:j1])
            for w in range(1, 4):
                far += np.bitwise_count(words[w, i0:i1, None] ^ words[w, None, j0:j1])
            i, j = np.divmod(np.flatnonzero(far <= most), j1 - j0)  # 256 wraps to 0 here, so that these are counted again
            i, j = i + i0, j + j0
            i, j = i[i < j], j[i < j]
            if len(i):
                near = np.bitwise_count(words[:, i] ^ words[:, j]).sum(axis=0, dtype=np.int64) <= np.minimum(limit[i], limit[j])
                yield i[near], j[near]


def _links(depth: int, tries: int, distance: int, blocks: bool):
    """mapInArrow over rows (key, node, n_texts, sig and, with blocks, block and side) sorted by key, block and side: link counts (node, null, n) and forest edges (node, other, 0)."""

    def found(key: np.ndarray, block: np.ndarray, side: np.ndarray, node: np.ndarray, weight: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        words, limit = np.ascontiguousarray(np.ascontiguousarray(sig[:, :32]).view(np.uint64).T), np.minimum(sig[:, 32], distance).astype(np.int64)
        links, label = np.zeros(n, np.int64), np.arange(n)

        def link(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal label
            rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            leaf = leaves(sig[rows], depth, tries)
            first = (leaf[at[: len(i)]] == leaf[at[len(i) :]]).argmax(axis=1) == key[i] >> DEEPEST  # the first trie in which the two meet counts the link
            i, j = i[first], j[first]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            while True:
                x, y = label[i], label[j]
                if (x == y).all():
                    break
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up

        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
        end = np.append(begin[1:], n)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for g0, g1 in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
            if side[g0] == 2:
                a, b = range(g0, g1), range(g0, g1)
            else:
                cut = g0 + int(np.searchsorted(side[g0:g1], 1))
                a, b = range(g0, cut), range(cut, g1)
            if not a or not b:
                continue
            for pairs in _near_pairs(words, limit, a, b):
                pending.append(pairs)
                waiting += len(pairs[0])
                if waiting * tries >= 1 << 20:
                    link(*map(np.concatenate, zip(*pending)))
                    pending, waiting = [], 0
        if waiting:
            link(*map(np.concatenate, zip(*pending)))
        some, linked = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        nodes = np.concatenate((node[some], node[linked]))
        others = pa.array([None] * len(some), pa.int64()), pa.array(node[label[linked]], pa.int64())
        counts = np.concatenate((links[some], np.zeros(len(linked), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.concat_arrays(others), pa.array(counts, pa.int64())], names=["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0

        def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            key, node, weight = (whole.column(k).to_numpy() for k in range(3))
            block, side = (whole.column(k).to_numpy() for k in (4, 5)) if blocks else (np.zeros(len(key), np.int64), np.full(len(key), 2))
            return key, block, side, node, weight, _sig_rows(whole.column(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            key, block, *rest = arrays(kept)
            before = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield found(key[:cut], block[:cut], *(x[:cut] for x in rest))
                kept = [pa.Table.from_batches(kept).slice(cut).combine_chunks().to_batches()[0]] if cut < rows else []
                rows -= cut
        if rows:
            yield found(*arrays(kept))

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one a row of df.

    class_id is the smallest id of the class, the closure of links; n_links counts the different texts within
    the distance of the row's text (those that the forest meets).
    """
    spark = df.sparkSession
    distance = min(max(distance, 0), DISTANCE)
    signed = written(df.select(col(id_col).alias("doc_id"), signature(col(text_col).cast("string")).alias("s")).select("doc_id", "s.sig", "s.key"), "signatures")
    texts = signed.groupBy("sig", "key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    points = texts.groupBy("sig").agg(F.min("first_id").alias("first_id"), F.count("*").alias("n_texts"), F.sum("n_rows").alias("n_rows"))
    points = written(points.withColumn("node", F.monotonically_increasing_id()), "points")  # written at once, so that the numbers stay
    different, rows = points.agg(F.count("*"), F.sum("n_rows")).head()
    depth, tries = plan_forest(different, distance)
    keys = _keys(depth, tries)
    huge = _huge_leaves(points, keys)
    entries = points.select(F.explode(keys).alias("key"), "node", "n_texts", "sig")
    entries, more, sides = (_in_blocks(entries, huge), ["block"], ["side"]) if huge else (entries, [], [])
    entries = entries.select("key", "node", "n_texts", "sig", *more, *sides)
    met = entries.repartition("key", *more).sortWithinPartitions("key", *more, *sides).mapInArrow(_links(depth, tries, distance, bool(huge)), "node long, other long, links long")
    met = written(met, "links")
    links = met.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.filter("other is not null"), "node", "other")
    placed = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    nodes = placed.join(classes, "root").join(links, "node", "left").select("sig", "n_rows", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    nodes = written(nodes, "classes")
    drop(points, met, roots)
    return join_counted(signed, nodes, "sig", "n_rows", rows or 0).select("doc_id", "class_id", "n_links")


def deduplicate(df: DataFrame, text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each class, with the columns of df. Rows are numbered in a written table, so that the numbers stay."""
    row = "__row_of_deduplicate"
    numbered = written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keep = near_duplicates(numbered, row, text_col, distance).filter("doc_id = class_id").select(F.col("doc_id").alias(row))
    return numbered.join(keep, row, "left_semi").select(*[col(c) for c in df.columns])
