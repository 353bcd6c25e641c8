"""Queries that validate the evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import rules
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_ARTIFACTS, DUCK_EDGES, DUCK_SOURCES, DUCK_UNITS


def _citations(spark, sf_dir):
    """What benchmark item n cites: lines 1, 4 and 9 of documents 3n and 3n + 1 in 200."""
    items = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.col("item_id") * 3, F.col("item_id") * 3 + 100000)).alias("doc"))
    return items.select("item_id", F.concat(F.lit("doc-"), "doc").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("n")).select("item_id", "source_id", F.format_string("line-%04d", "n").alias("unit_id"))


def unresolved_citations(spark, sf_dir):
    return rules.unresolved(_citations(spark, sf_dir), corpus.units(spark, sf_dir), ["source_id", "unit_id"])


def validation_report(spark, sf_dir):
    docs, edges = corpus.sources(spark, sf_dir), corpus.edges(spark, sf_dir)
    labels = corpus.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), "quality", "toxic")
    declared = corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), "n_chars", F.char_length("text").alias("length"))
    twice = docs.groupBy("fingerprint").agg(F.min("source_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return rules.report(
        rules.broken(docs, "missing-text", F.length(F.trim("text")) == 0),
        rules.broken(docs, "short-text", F.length("text") < 60),
        rules.broken(docs, "placeholder", F.col("text").rlike(r"(?i)\b(lorem ipsum|todo|tbd|placeholder)\b")),
        rules.broken(declared, "length-differs", F.col("n_chars") != F.col("length")),
        rules.broken(docs.join(twice, "fingerprint"), "repeated-content", F.col("source_id") != F.col("least")),
        rules.broken(rules.unresolved(edges.withColumnRenamed("source_id", "from_id").withColumnRenamed("related_source_id", "source_id"), docs, ["source_id"]).select(F.col("from_id").alias("source_id")), "unknown-relation", F.lit(True)),
        rules.broken(labels, "low-quality", F.col("quality") == 0),
        rules.broken(labels, "toxic", F.col("toxic") == 1),
    )


def validation_status(spark, sf_dir):
    """The state of each quarter of the corpus: of all, of what has no pending text, of what has no blocking rule, of what has no rule at all."""
    reported = validation_report(spark, sf_dir)
    pending = corpus.sources(spark, sf_dir).where(F.col("text").rlike(r"(?i)\bTODO\b")).select("source_id")
    none, parts = pending.limit(0), []
    for name, (rows, waiting) in {"all": (reported, pending), "no pending": (reported, none), "no blocking": (reported.where("status = 'warnings'"), none), "no rule": (reported.limit(0), none)}.items():
        parts.append(rules.overall(rows, waiting).withColumn("part", F.lit(name)))
    return reduce(DataFrame.union, parts)


def coverage_totals(spark, sf_dir):
    """Units, artifacts and relations of each origin."""
    docs = corpus.sources(spark, sf_dir).select("source_id", "origin")
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    joined = docs.join(count(corpus.units(spark, sf_dir), "units"), "source_id", "left").join(count(corpus.artifacts(spark, sf_dir), "artifacts"), "source_id", "left").join(count(corpus.edges(spark, sf_dir), "relations"), "source_id", "left")
    return joined.groupBy("origin").agg(F.count("*").alias("sources"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("units", "artifacts", "relations")), F.count_if(F.col("artifacts").isNull()).alias("without_artifacts"))


QUERIES = {f.__name__: f for f in (unresolved_citations, validation_report, validation_status, coverage_totals)}

ORACLES = {
    "unresolved_citations": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, i AS (SELECT item_id, unnest([item_id * 3, item_id * 3 + 100000]) AS doc FROM benchmark),
c AS (SELECT item_id, 'doc-' || doc AS source_id, 'line-' || lpad(unnest([1, 4, 9])::VARCHAR, 4, '0') AS unit_id FROM i) SELECT * FROM c ANTI JOIN units USING (source_id, unit_id)""",
    "validation_report": rf"""WITH {DUCK_SOURCES}, {DUCK_EDGES}, v AS (
  SELECT source_id, 'missing-text' AS rule FROM sources WHERE length(trim(text)) = 0 UNION SELECT source_id, 'short-text' FROM sources WHERE length(text) < 60
  UNION SELECT source_id, 'placeholder' FROM sources WHERE regexp_matches(text, '(?i)\b(lorem ipsum|todo|tbd|placeholder)\b')
  UNION SELECT 'doc-' || doc_id, 'length-differs' FROM documents WHERE n_chars <> length(text)
  UNION SELECT source_id, 'repeated-content' FROM (SELECT source_id, min(source_id) OVER (PARTITION BY fingerprint) AS least FROM sources) WHERE source_id <> least
  UNION SELECT source_id, 'unknown-relation' FROM edges WHERE related_source_id NOT IN (SELECT source_id FROM sources)
  UNION SELECT 'doc-' || doc_id, 'low-quality' FROM labels WHERE quality = 0 UNION SELECT 'doc-' || doc_id, 'toxic' FROM labels WHERE toxic = 1)
SELECT source_id, count(*) AS n_rules, CASE WHEN bool_or(rule IN ('missing-text', 'duplicate-path', 'unknown-relation')) THEN 'blocking-errors' ELSE 'warnings' END AS status, string_agg(rule, ',' ORDER BY rule) AS rules FROM v GROUP BY 1""",
    "coverage_totals": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, {DUCK_ARTIFACTS}, {DUCK_EDGES}, j AS (SELECT s.source_id, origin, u, a, r FROM sources s LEFT JOIN (SELECT source_id, count(*) AS u FROM units GROUP BY 1) USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS a FROM artifacts GROUP BY 1) USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS r FROM edges GROUP BY 1) USING (source_id))
SELECT origin, count(*) AS sources, coalesce(sum(u), 0)::BIGINT AS units, coalesce(sum(a), 0)::BIGINT AS artifacts, coalesce(sum(r), 0)::BIGINT AS relations, count(*) FILTER (a IS NULL) AS without_artifacts FROM j GROUP BY origin""",
}
_report = ORACLES["validation_report"]
ORACLES["validation_status"] = rf"""WITH r AS ({_report}), c AS (SELECT (SELECT count(*) FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)\bTODO\b')) AS p, count(*) FILTER (status = 'blocking-errors') AS b, count(*) FILTER (status = 'warnings') AS w FROM r),
x AS (SELECT 'all' AS part, p AS pending, b AS blocking, w AS warnings FROM c UNION ALL SELECT 'no pending', 0, b, w FROM c UNION ALL SELECT 'no blocking', 0, 0, w FROM c UNION ALL SELECT 'no rule', 0, 0, 0)
SELECT part, pending, blocking, warnings, CASE WHEN pending > 0 THEN 'pending-synthesis' WHEN blocking > 0 THEN 'blocking-errors' WHEN warnings > 0 THEN 'warnings' ELSE 'valid' END AS status FROM x"""
