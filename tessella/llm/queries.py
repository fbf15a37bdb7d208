"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_extract, packing, quality_mil, quality_rules, secrets, sharding, simhash, warc
from .common import table, text_table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(text_table(spark, sf_dir, "documents"), vocabulary())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    cascade, _ = quality_rules.plan_cascade(docs)
    verdict = docs.select("doc_id", quality_rules.judge(F.col("text"), cascade).alias("v"))
    return verdict.select("doc_id", "v.n_words", "v.word_chars", "v.n_symbols", "v.n_dup_lines", "v.n_repeat_words", "v.base_failed", "v.kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), vocabulary()).alias("b")).select("doc_id", "b.*")
    return both.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = warc.archive(text_table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, path, manifest)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_table(spark, sf_dir, "documents").select("doc_id", secrets.secrets(F.col("text")).alias("f"))
    base = F.filter("f", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spell = lambda fs: F.array_join(F.transform(fs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("f")).alias("spans"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(text_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), quality_mil.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_mil.THRESHOLD).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(text_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
b AS (
  SELECT w.doc_id, w.text, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 4 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR (n_dup_lines >= 3 AND 2 * n_dup_lines > length(regexp_replace(text, '[^\n]', '', 'g')) + 1) OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars
    OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars OR 10 * len(list_filter(list_zip(ws[:-2], ws[2:]), lambda x: x[1] = x[2])) > 3 * n_words) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_warc": OP4_SQL}
