"""The corpus pipeline: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; what it gives is written as Parquet and read
again as the next stage's docs. The first four keep the columns of documents; the last gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import packing, quality_mil, quality_rules, secrets, simhash
from tessella.llm.common import bounded_batches, drop, scratch, table, written
from tessella.llm.queries import vocabulary


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    bounded_batches(spark)
    return quality_rules.quality_filter(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good; it learns from labels of the whole table, since the rules left few bad documents."""
    bounded_batches(spark)
    return quality_mil.quality_filter(docs, quality_mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    bounded_batches(spark)
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted again."""
    bounded_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences."""
    bounded_batches(spark)
    pieces = packing.cut(docs, vocabulary())
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the forest or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next has been written, what an operator wrote for itself with its stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}", scratch=False)
        docs = kept
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
