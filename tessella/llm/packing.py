"""Packing: first-fit decreasing with a tournament tree of bin capacities, independently in randomised groups.

``cut`` tokenises whole documents and cuts each into full sequences and one remainder. ``pack`` spreads the
pieces at random (by a hash, so that a lost task gives the same rows again), splits each partition into
groups of at most ``group`` pieces and packs each by first-fit decreasing; the tournament tree finds the first
bin that still holds a piece in logarithmic time. No group depends on another, no key collects a share of the
rows and a task holds one group at a time.

Defined results: a null text is an empty document, which is the end id alone; repeated rows are packed each;
an empty table gives no rows; extra columns stay out of the result whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import binary_array, blocks, encoder, sliced
from .common import col

SEQUENCE = 4096
GROUP = 32_768
END_ID = 2

_PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECE_SPARK = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
)


class TournamentTree:
    """Remaining capacities of bins as leaves; each inner node holds the largest below it. Bins open as they are needed."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.top = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with that much room; it must exist."""
        top, at, leaves = self.top, 1, self.leaves
        while at < leaves:
            at *= 2
            if top[at] < need:
                at += 1
        return at - leaves

    def take(self, bin_: int, need: int) -> int:
        """Takes room from a bin and gives what the bin had before."""
        top, at = self.top, bin_ + self.leaves
        had = top[at]
        top[at] = had - need
        at //= 2
        while at:
            best = top[2 * at] if top[2 * at] >= top[2 * at + 1] else top[2 * at + 1]
            if top[at] == best:
                break
            top[at] = best
            at //= 2
        return had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), by first-fit decreasing; ties in the order given."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        b = tree.first(need)
        bins[i] = b
        offsets[i] = capacity - tree.take(b, need)
    return bins, offsets


def cut(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end_id: int | None = END_ID, engine: str = "index") -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids): every whole text's ids, cut at multiples of capacity; ids are little-endian uint32."""
    @F.arrow_udf(_PIECE_SPARK)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(vocabulary, engine)
        for texts, sizes in blocks(batches):
            ids, offsets = e.encode(texts)
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            totals = np.diff(offsets)
            counts = -(-totals // capacity)
            first = np.cumsum(counts) - counts
            starts = (np.arange(int(counts.sum())) - np.repeat(first, counts)) * capacity
            doc_tokens = np.repeat(totals, counts)
            lengths = np.minimum(capacity, doc_tokens - starts)
            parts = [pa.array(starts), pa.array(lengths), pa.array(doc_tokens), binary_array(ids, np.concatenate(([0], np.cumsum(lengths))))]
            rows = pa.StructArray.from_arrays(parts, fields=list(_PIECE))
            yield from sliced(pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(starts)])), pa.int32()), rows), sizes)

    return df.select(col(id_col).alias("doc_id"), F.explode(pieces(col(text_col).cast("string"))).alias("p")).select("doc_id", "p.*")


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = SEQUENCE, group: int = GROUP, seed: int = 0, spread: list[Column] | None = None) -> DataFrame:
    """The rows of pieces with sequence_id and offset (both long), in sequences of at most capacity.

    spread: what the random order is drawn from; all columns by default. Every length must be 1 to capacity.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    order = F.xxhash64(F.lit(seed), *(spread or [col(c) for c in pieces.columns]), F.spark_partition_id())  # the partition parts equal rows
    spread_out = pieces.withColumn("__order", order).repartition("__order")
    ordered = spread_out.sortWithinPartitions("__order", *[col(c) for c in pieces.columns if pieces.schema[c].dataType.typeName() not in ("map", "variant")])

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        following = TaskContext.get().partitionId() << 40
        waiting: list[pd.DataFrame] = []
        count = 0

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal following
            bins, offsets = first_fit_decreasing(frame[length_col].to_numpy(np.int64), capacity)
            out = frame.drop(columns="__order").assign(sequence_id=bins + following, offset=offsets)
            following += int(bins.max()) + 1
            return out

        for frame in frames:
            waiting.append(frame)
            count += len(frame)
            while count >= group:
                whole = pd.concat(waiting, ignore_index=True)
                yield packed(whole[:group].reset_index(drop=True))
                waiting = [whole[group:].reset_index(drop=True)]
                count -= group
        if count:
            yield packed(pd.concat(waiting, ignore_index=True))

    return ordered.mapInPandas(groups, schema)


def sequences(packed: DataFrame, capacity: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """Whole sequences (sequence_id, used, ids) from packed pieces that carry ids; padded to capacity except where used is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most capacity ids a sequence
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    blank = F.unhex(F.lit(struct.pack("<I", pad_id).hex()))
    short = F.when(F.bit_count("used") == 1, 0).otherwise(capacity - F.col("used"))
    return joined.select("sequence_id", "used", F.concat(ids, F.unhex(F.repeat(F.hex(blank), short.cast("int")))).alias("ids"))
