"""Structured Streaming input: a model's aggregation over each micro-batch, or over a watermarked stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import SemanticTable


def stream(spark: SparkSession, path: str, schema: Any, format: str = "parquet", **options: Any) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def for_each_batch(source: DataFrame, build: Callable[[DataFrame], SemanticTable], ask: Callable[[SemanticTable], Any], sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Asks a model over each micro-batch; everything that batch models can is allowed. sink gets (rows, batch id)."""

    def run(batch: DataFrame, number: int) -> None:
        sink(ask(build(batch)).to_spark(), number)

    writer = source.writeStream.foreachBatch(run)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, time: str, width: str, keys: list[str], measures: dict[str, Any], late: str = "1 hour") -> DataFrame:
    """Aggregates of tumbling event-time windows with a watermark: append-mode output once a window is closed."""
    from pyspark.sql import functions as F

    # watermarks need a zoned timestamp
    zoned = source.withColumn(time, F.col(time).cast("timestamp"))
    grouped = zoned.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return grouped.agg(*[c.alias(n) for n, c in measures.items()]).select(F.col("window.start").alias("window_start"), *keys, *measures)
