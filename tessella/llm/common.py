"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, does without: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessella-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table or for archives in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of tables that written() made and drop() hasn't removed.
_WRITTEN: set[str] = set()


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors. drop() removes it and, unless scratch is false, scratch() or release()."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch:
        _WRITTEN.add(path)
    table = df.sparkSession.read.parquet(path)
    table._tessella_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() that no later step reads."""
    for t in tables:
        if path := getattr(t, "_tessella_path", None):
            _remove(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that were written inside and that drop() hasn't removed; results must have been stored by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in sorted(_WRITTEN - before):
            _remove(spark, path)


def release(spark: SparkSession) -> None:
    """Removes all tables that results of this session still read; for when those have been used."""
    for path in sorted(_WRITTEN):
        _remove(spark, path)


#: Keys of more than 1 / HOT of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 10_000


def join_counted(rows: DataFrame, known: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join of rows with known, which has each key once with the count of its rows, without count. A hot key stays where its rows are."""
    hot = F.col(count) * HOT > F.lit(total)
    few, rest = known.filter(hot).drop(count), known.filter(~hot).drop(count)  # few: fewer than HOT rows
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(rest, key))


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows of long texts that go to Python at once; it bounds a worker's memory, and results don't depend on it.
TEXT_BATCH = 1000
#: Bytes that go to Python at once, but for a longer text, which goes alone.
TEXT_BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most TEXT_BATCH rows and about TEXT_BATCH_BYTES from here on in this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, read in bounded batches."""
    bounded_batches(spark)
    return table(spark, sf_dir, name)
