"""Evidence tables over the corpus: sources, units, artifacts, edges and an earlier inventory.

A document is a source, each of its lines that is not blank a unit, each fifth line's unit an artifact. Equal documents are strongly related, documents with the same
title less so, and the next one of the same origin weakly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import first_line, truncated


BLOCK = 4096  # ids in which neighbours are looked for at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("source_id"), "doc_id",
        F.concat(F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".txt")).alias("current_path"),
        F.sha2(text, 256).alias("fingerprint"), F.octet_length(text).cast("long").alias("file_size"),
        F.substring(first_line(text), 1, 80).alias("title"), text.alias("text"), F.col("source").alias("origin"), "lang",
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sources(spark, sf_dir).select("source_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.length(F.trim("text")) > 0).select("source_id", F.format_string("line-%04d", F.col("pos") + 1).alias("unit_id"), (F.col("pos") + 1).cast("long").alias("ordinal"), "text")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("ordinal") % 10 == 0, "chart").otherwise("table")
    return units(spark, sf_dir).where("ordinal % 5 = 0").select("source_id", "unit_id", F.concat("unit_id", F.lit(":"), kind, F.lit("-001")).alias("artifact_id"), kind.alias("artifact_type"), F.substring("text", 1, 60).alias("title"), "text")


def _followed(docs: DataFrame) -> DataFrame:
    """(source_id, related_source_id): each document's next one of its origin, by id. Neighbours are found in blocks of ids first, then the ends of blocks meet: no task has all of an origin."""
    rows = docs.withColumn("_block", F.floor(F.col("doc_id") / BLOCK))
    inner = rows.select("source_id", F.lead("source_id").over(Window.partitionBy("origin", "_block").orderBy("doc_id")).alias("related_source_id"))
    ends = rows.groupBy("origin", "_block").agg(F.max_by("source_id", "doc_id").alias("source_id"), F.min_by("source_id", "doc_id").alias("first"))
    across = ends.select("source_id", F.lead("first").over(Window.partitionBy("origin").orderBy("_block")).alias("related_source_id"))
    return inner.union(across).where("related_source_id is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, related_source_id, relation_type, strength)"""
    docs = sources(spark, sf_dir).select("source_id", "doc_id", "fingerprint", "title", "origin")

    def to_first(key: str, relation: str, strength: str) -> DataFrame:
        first = docs.groupBy(key).agg(F.min("doc_id").alias("first_id"))
        return docs.join(first, key).where("doc_id <> first_id").select("source_id", F.concat(F.lit("doc-"), "first_id").alias("related_source_id"), F.lit(relation).alias("relation_type"), F.lit(strength).alias("strength"))

    near = _followed(docs).select("*", F.lit("sequence").alias("relation_type"), F.lit("low").alias("strength"))
    return to_first("fingerprint", "duplicate", "high").union(to_first("title", "same-title", "medium")).union(near)


def previous_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the sources: by id some were elsewhere, other in content, both, absent, or there but gone since."""
    now = sources(spark, sf_dir)
    n = F.col("doc_id") % 11
    path = F.when(n == 1, F.concat(F.lit("old/"), F.col("current_path"))).when(n == 5, F.concat(F.lit("gone/"), F.col("current_path"))).otherwise(F.col("current_path"))
    print_ = F.when(n.isin(2, 5), F.sha2(F.concat(F.lit("before "), "fingerprint"), 256)).otherwise(F.col("fingerprint"))
    return now.where(n != 3).select(F.concat(F.lit("old-"), "doc_id").alias("source_id"), path.alias("current_path"), print_.alias("fingerprint"), "file_size", F.lit("txt").alias("document_type"))


def current_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).where("doc_id % 11 <> 4").select("current_path", "fingerprint", "file_size", F.lit("txt").alias("document_type"))


#: The same tables for DuckDB, as common table expressions.
DUCK_SOURCES = """sources AS (SELECT 'doc-' || doc_id AS source_id, doc_id, 'corpus/' || source || '/' || lang || '/doc-' || doc_id || '.txt' AS current_path, sha256(coalesce(text, '')) AS fingerprint,
  octet_length(encode(coalesce(text, '')))::BIGINT AS file_size, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS title, coalesce(text, '') AS text, source AS origin, lang FROM documents)"""
DUCK_UNITS = """lines AS (SELECT source_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ordinal FROM sources),
units AS (SELECT source_id, 'line-' || lpad(ordinal::VARCHAR, 4, '0') AS unit_id, ordinal::BIGINT AS ordinal, text FROM lines WHERE length(trim(text)) > 0)"""
DUCK_ARTIFACTS = """artifacts AS (SELECT source_id, unit_id, unit_id || ':' || CASE WHEN ordinal % 10 = 0 THEN 'chart' ELSE 'table' END || '-001' AS artifact_id,
  CASE WHEN ordinal % 10 = 0 THEN 'chart' ELSE 'table' END AS artifact_type, substr(text, 1, 60) AS title, text FROM units WHERE ordinal % 5 = 0)"""
DUCK_EDGES = """edges AS (
  SELECT source_id, 'doc-' || first_id AS related_source_id, 'duplicate' AS relation_type, 'high' AS strength FROM (SELECT *, min(doc_id) OVER (PARTITION BY fingerprint) AS first_id FROM sources) WHERE doc_id <> first_id
  UNION ALL SELECT source_id, 'doc-' || first_id, 'same-title', 'medium' FROM (SELECT *, min(doc_id) OVER (PARTITION BY title) AS first_id FROM sources) WHERE doc_id <> first_id
  UNION ALL SELECT source_id, n, 'sequence', 'low' FROM (SELECT source_id, lead(source_id) OVER (PARTITION BY origin ORDER BY doc_id) AS n FROM sources) WHERE n IS NOT NULL)"""
DUCK_PREVIOUS = """prev AS (SELECT 'old-' || doc_id AS source_id, CASE doc_id % 11 WHEN 1 THEN 'old/' || current_path WHEN 5 THEN 'gone/' || current_path ELSE current_path END AS current_path,
  CASE WHEN doc_id % 11 IN (2, 5) THEN sha256('before ' || fingerprint) ELSE fingerprint END AS fingerprint FROM sources WHERE doc_id % 11 <> 3),
now AS (SELECT current_path, fingerprint FROM sources WHERE doc_id % 11 <> 4)"""
