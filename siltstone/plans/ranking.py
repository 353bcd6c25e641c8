"""The whole ranking over the corpus, for the standing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens
from siltstone.operators import ranking, retrieval
from siltstone.plans.retrieval import STANDING, _citations, _terms_sql
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_ARTIFACTS, DUCK_EDGES, DUCK_SOURCES, DUCK_UNITS

#: Channels that queries prefer, and what the references of two of them were resolved to.
PREFERRED = {"q2": ["media"], "q4": ["structure", "text"]}
RESOLVED = {"q3": ("doc-7", "line-0001", "exact"), "q5": ("doc-11", None, "approximate")}


def _records(spark, sf_dir):
    """Entities are long words, claims are lines with numbers, key points are short lines; a unit with numbers has an overlay, every artifact is the page image of its unit."""
    docs, units, artifacts = corpus.sources(spark, sf_dir), corpus.units(spark, sf_dir), corpus.artifacts(spark, sf_dir)
    density = retrieval.density(_citations(spark, sf_dir), units).select("source_id", F.col("density").alias("citation_density"))
    lines, number = F.split("text", "\n"), "[0-9]"
    channels = F.array_compact(F.array(F.lit("text"), F.when(F.contains("text", F.lit("\n")), "structure"), F.when(F.col("text").rlike(number), "media")))
    none = F.lit(None).cast("string")
    sources = docs.select(
        "source_id", "title", F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]{12,}"), F.lit(0)), "\n").alias("entities"), F.col("text").alias("summary"), F.array_join(F.filter(lines, lambda x: x.rlike(number)), "\n").alias("claims"),
        F.array_join(F.filter(lines, lambda x: F.char_length(x) < 80), "\n").alias("key_points"), F.concat_ws(" ", "lang", "origin").alias("affordance"), F.concat(F.lit("source "), "origin").alias("document_context"), F.col("current_path").alias("path"),
        channels.alias("channels"), F.lit(0.2).alias("trust"), F.lit("corpus").alias("family"), none.alias("policy"), none.alias("prior"), none.alias("kind"), F.lit(False).alias("relevant"),
    ).join(density, "source_id", "left")
    size, figures = F.char_length("text"), F.col("text").rlike(number)
    units = units.select(
        "source_id", "unit_id", F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1).alias("title"), "text", F.when(F.contains("text", F.lit("?")), "question").otherwise("statement").alias("affordance"), F.concat(F.lit("line "), F.col("ordinal").cast("string")).alias("context"),
        F.when(figures, F.concat(F.lit("figures "), F.regexp_extract("text", "^([A-Za-z]+)", 1))).alias("labels"), F.array(F.lit("text")).alias("channels"), F.when(size > 100, "high").when(size > 40, "medium").otherwise("low").alias("confidence"),
        F.when(F.col("ordinal") == 1, 1.0).alias("citation_density"), F.concat("unit_id", F.when(F.col("ordinal") % 10 == 0, ":chart-001").when(F.col("ordinal") % 5 == 0, ":table-001")).alias("page_image"),
    )
    artifacts = artifacts.select(
        "source_id", "artifact_id", "unit_id", "title", F.replace("unit_id", F.lit("-"), F.lit(" ")).alias("aliases"), "text", F.concat_ws(" of ", "artifact_type", "source_id").alias("context"), none.alias("labels"),
        "artifact_type", (F.col("artifact_type") == "chart").alias("captioned"), (size > 60).alias("promoted"),
    )
    return sources, units, artifacts


def evidence_rank(spark, sf_dir):
    """The first ten sources of every query, with what their totals are made of."""
    rows = retrieval.ranked(ranking.scores(*_records(spark, sf_dir), STANDING, PREFERRED, RESOLVED), 10)
    return rows.select("query_id", "place", "source_id", "total", *(F.round(c, 6).alias(c) for c in ("lexical_source", "lexical_units", "lexical_artifacts", "metadata", "context", "overlay", "memory")), "result_count")


QUERIES = {"evidence_rank": evidence_rank}


def _fields_sql(name: str, records: str, keys: str, fields: dict[str, float], parts: list[str]) -> str:
    stacked = " UNION ALL ".join(f"SELECT {keys}, '{f}' AS field, {w}::DOUBLE AS weight, unnest({duck_tokens(f)}) AS token FROM {records}" for f, w in fields.items())
    tenths = f"least(hits, {retrieval.TERM_CAP}) * round(weight * 10)::BIGINT"
    shares = "".join(f", coalesce(sum({tenths}) FILTER (field = '{p}'), 0)::BIGINT / 10::DOUBLE AS of_{p}" for p in parts)
    return f"""{name}_hits AS (SELECT {keys}, field, weight, token, count(*) AS hits FROM ({stacked}) GROUP BY ALL),
{name} AS (SELECT query_id, {keys}, sum({tenths})::BIGINT / 10::DOUBLE AS lexical{shares} FROM {name}_hits JOIN terms USING (token) GROUP BY query_id, {keys})"""


_asked = ", ".join(
    f"('{q}', {PREFERRED.get(q, [])}::VARCHAR[], {', '.join('NULL' if x is None else repr(x) for x in RESOLVED.get(q, (None, None, None)))}, {len({'table', 'chart', 'kpi', 'metric'} & {*t.lower().split()}) > 0})" for q, t in STANDING.items()
)
ORACLES = {
    "evidence_rank": rf"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, {DUCK_ARTIFACTS}, {DUCK_EDGES}, {_terms_sql()},
asked(query_id, wanted, to_source, to_unit, how, tabular) AS (VALUES {_asked}),
rs AS (SELECT source_id, title, array_to_string(regexp_extract_all(text, '[A-Za-z]{{12,}}'), chr(10)) AS entities, text AS summary, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')), chr(10)) AS claims,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) < 80), chr(10)) AS key_points, concat_ws(' ', lang, origin) AS affordance, 'source ' || origin AS document_context, current_path AS path,
  list_filter(['text', CASE WHEN contains(text, chr(10)) THEN 'structure' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'media' END], lambda x: x IS NOT NULL) AS channels FROM sources),
ru AS (SELECT source_id, unit_id, regexp_extract(text, '^(\S+ \S+ \S+)', 1) AS title, text, CASE WHEN contains(text, '?') THEN 'question' ELSE 'statement' END AS affordance, 'line ' || ordinal AS context,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 'figures ' || regexp_extract(text, '^([A-Za-z]+)', 1) END AS labels, CASE WHEN length(text) > 100 THEN 0.4 WHEN length(text) > 40 THEN 0.2 ELSE -0.1 END::DOUBLE + CASE WHEN ordinal = 1 THEN 0.2 ELSE 0 END::DOUBLE AS meta,
  CASE WHEN ordinal % 10 = 0 THEN unit_id || ':chart-001' WHEN ordinal % 5 = 0 THEN unit_id || ':table-001' END AS page_image FROM units),
ra AS (SELECT *, replace(unit_id, '-', ' ') AS aliases, artifact_type || ' of ' || source_id AS context, NULL::VARCHAR AS labels FROM artifacts),
{_fields_sql("s", "rs", "source_id", ranking.SOURCE_FIELDS, ["document_context"])},
{_fields_sql("u", "ru", "source_id, unit_id", ranking.UNIT_FIELDS, ["context", "labels"])},
{_fields_sql("a", "ra", "source_id, artifact_id", ranking.ARTIFACT_FIELDS, ["context", "labels"])},
us AS (SELECT q.query_id, r.source_id, r.unit_id, coalesce(u.lexical, 0)::DOUBLE AS lexical, coalesce(u.of_context, 0)::DOUBLE AS of_context, coalesce(u.of_labels, 0)::DOUBLE AS of_labels, coalesce(r.source_id = q.to_source AND r.unit_id = q.to_unit, false) AS meant,
  r.meta + 0.25 * list_contains(q.wanted, 'text')::INT + CASE WHEN r.source_id = q.to_source AND r.unit_id = q.to_unit THEN CASE q.how WHEN 'exact' THEN 12 ELSE 6 END ELSE 0 END AS meta
  FROM asked q JOIN ru r ON true LEFT JOIN u ON u.query_id = q.query_id AND u.source_id = r.source_id AND u.unit_id = r.unit_id
  WHERE (u.lexical IS NOT NULL OR (r.source_id = q.to_source AND r.unit_id = q.to_unit)) AND NOT coalesce(r.source_id = q.to_source AND q.how = 'exact' AND q.to_unit IS NOT NULL AND r.unit_id <> q.to_unit, false)),
ub AS (SELECT query_id, source_id, sum(lexical) AS lu, sum(meta) AS mu, sum(of_context) AS cu, sum(of_labels) AS ou FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY meant DESC, round(lexical + meta, 9) DESC, unit_id) AS place FROM us) WHERE place <= 3 GROUP BY 1, 2),
sa AS (SELECT a.query_id, a.source_id, a.artifact_id, r.unit_id, a.of_context, a.of_labels, a.lexical + CASE WHEN length(r.text) > 60 THEN 0.4 ELSE 0 END + CASE WHEN (a.query_id, r.artifact_type) IN (SELECT (query_id, token) FROM terms) THEN 0.5 ELSE 0 END
    + CASE WHEN r.artifact_type = 'chart' AND a.of_context > 0 THEN 1.4 ELSE 0 END + CASE WHEN q.tabular THEN 0.35 ELSE 0 END AS score
  FROM a JOIN ra r USING (source_id, artifact_id) JOIN asked q USING (query_id) WHERE NOT coalesce(a.source_id = q.to_source AND q.how = 'exact' AND q.to_unit IS NOT NULL AND r.unit_id <> q.to_unit, false)),
ea AS (SELECT query_id, source_id, artifact_id, score, of_context, of_labels FROM sa UNION ALL SELECT q.query_id, r.source_id, r.page_image, 0.15, 0, 0 FROM asked q JOIN ru r ON r.page_image IS NOT NULL AND trim(coalesce(r.labels, '')) <> ''
  WHERE (q.query_id, r.source_id, r.unit_id) NOT IN (SELECT (query_id, source_id, unit_id) FROM sa)),
ab AS (SELECT query_id, source_id, sum(score) AS la, sum(of_context) AS ca, sum(of_labels) AS oa FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY round(score, 9) DESC, artifact_id) AS place FROM ea) WHERE place <= 5 GROUP BY 1, 2),
d AS (SELECT source_id, least(coalesce(c, 0) / n, 3.0)::DOUBLE AS density FROM (SELECT source_id, count(*) AS n FROM units GROUP BY 1) LEFT JOIN (SELECT related_source_id AS source_id, count(*) AS c FROM edges GROUP BY 1) USING (source_id)),
k AS (SELECT query_id, source_id FROM s UNION SELECT query_id, source_id FROM ub UNION SELECT query_id, source_id FROM ab UNION SELECT query_id, to_source FROM asked WHERE to_source IS NOT NULL),
t AS (SELECT k.query_id, k.source_id, coalesce(s.lexical, 0) AS lexical_source, coalesce(lu, 0) AS lexical_units, coalesce(la, 0) AS lexical_artifacts,
  0.3 * coalesce(density, 0) + 0.2 + 0.35 * len(list_intersect(rs.channels, wanted)) + CASE WHEN k.source_id = to_source THEN CASE how WHEN 'exact' THEN 5.0 ELSE 2.5 END ELSE 0 END + coalesce(mu, 0) AS metadata,
  coalesce(of_document_context, 0) + coalesce(cu, 0) + coalesce(ca, 0) AS context, coalesce(ou, 0) + coalesce(oa, 0) AS overlay
  FROM k JOIN rs USING (source_id) JOIN asked USING (query_id) LEFT JOIN s USING (query_id, source_id) LEFT JOIN ub USING (query_id, source_id) LEFT JOIN ab USING (query_id, source_id) LEFT JOIN d USING (source_id)),
f AS (SELECT *, floor(round(lexical_source + lexical_units + lexical_artifacts + metadata, 9) * 1000 + 0.5) / 1000 AS total FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, lexical_source DESC, source_id) AS place, count(*) OVER (PARTITION BY query_id) AS result_count FROM f WHERE total > 0)
SELECT query_id, place, source_id, total, round(lexical_source, 6) AS lexical_source, round(lexical_units, 6) AS lexical_units, round(lexical_artifacts, 6) AS lexical_artifacts, round(metadata, 6) AS metadata, round(context, 6) AS context, round(overlay, 6) AS overlay, 0.0::DOUBLE AS memory, result_count
FROM o WHERE place <= 10""",
}
