"""The opN_ queries over the tables of a directory, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, licenses, matroska, mixing, near_dedup, quality, token_counts, token_store, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path=tokenizer_path("piece_bpe_32k.model"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.write_media(_table(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, manifest = token_store.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_token_files(root, manifest)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, archives = warc_zip.write_archives(_table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(archives).drop("url")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('5:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *,
   CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest,
   (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS weights
   FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, rest * weight >= cap * weights AS capped FROM l),
f AS (SELECT * FROM m WHERE NOT capped ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT m.source, m.source_size,
   CASE WHEN f.ratio IS NULL OR m.ratio < f.ratio OR m.capped THEN m.cap ELSE m.weight * f.rest / f.weights END AS target
   FROM m LEFT JOIN f ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS more,
   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
   FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN whole + CAST(more > 0 AND cum - size / 2.0::DOUBLE <= more AS BIGINT) ELSE 0 END AS repeats FROM r)
SELECT doc_id, size, source_size, target, CAST(repeats * size AS BIGINT) AS taken, repeats FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_zip": op3_warc_zip,
    "op4_html_text": op4_html_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_matroska": op6_matroska,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_output": op8_token_output,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
}
OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM p
"""

ORACLE_SQL: dict[str, str] = {"op3_warc_zip": OP3_SQL, "op5_mix_sources": OP5_SQL}
