"""Queries that ground the passages of ``benchmark`` (as answers, a segment a line) in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import STOPWORDS, coverage, duck_tokens, significant_terms, tokens
from siltstone.operators import grounding
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES


def _segments(spark, sf_dir):
    items = corpus.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("a-"), "item_id").alias("answer_id"), F.posexplode(F.split("text", "\n")).alias("segment", "text"))
    return items.where(F.length(F.trim("text")) > 0).select("answer_id", F.col("segment").cast("long").alias("segment"), "text")


def _evidence(spark, sf_dir):
    return corpus.sources(spark, sf_dir).select("source_id", F.explode(significant_terms(F.col("text"))).alias("token"))


def term_coverage(spark, sf_dir):
    """How much of each segment the document with the same number covers."""
    docs = corpus.sources(spark, sf_dir).select(F.concat(F.lit("a-"), "doc_id").alias("answer_id"), tokens(F.col("text")).alias("words"))
    rows = _segments(spark, sf_dir).join(docs, "answer_id")
    return rows.select("answer_id", "segment", F.size(significant_terms(F.col("text"))).cast("long").alias("n_terms"), F.round(coverage(significant_terms(F.col("text")), F.col("words")), 6).alias("coverage"))


def grounding_status(spark, sf_dir):
    traced = grounding.statuses(_segments(spark, sf_dir), _evidence(spark, sf_dir))
    return traced.drop("supporting").withColumns({c: F.round(c, 6) for c in ("top_coverage", "set_coverage")})


def answer_state_rollup(spark, sf_dir):
    return grounding.answer_states(grounding.statuses(_segments(spark, sf_dir), _evidence(spark, sf_dir))).select("answer_id", "segments", "grounded", "partial", "unresolved", "state")


def support_summary(spark, sf_dir):
    """How often each source is the best support of a segment, by final status."""
    traced = grounding.statuses(_segments(spark, sf_dir), _evidence(spark, sf_dir)).where("source_id is not null")
    return traced.groupBy("source_id", "final_status").agg(F.count("*").alias("segments"), F.countDistinct("answer_id").alias("answers"))


def support_dedup(spark, sf_dir):
    """The sources that an answer rests on: each once, where it comes first."""
    found = grounding.support(_segments(spark, sf_dir), _evidence(spark, sf_dir))
    return found.groupBy("answer_id", "source_id").agg(F.min("segment").alias("first_segment"), F.count("*").alias("times"))


def segment_budget(spark, sf_dir):
    """Documents with a paragraph a line, as answers, in 24 segments at most."""
    answers = corpus.sources(spark, sf_dir).select(F.col("source_id").alias("answer_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return grounding.segments(answers).groupBy("answer_id").agg(F.count("*").alias("segments"), F.max("before").alias("before"), F.max(F.length("text")).cast("long").alias("longest"))


QUERIES = {f.__name__: f for f in (term_coverage, grounding_status, answer_state_rollup, support_summary, support_dedup, segment_budget)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = lambda text: f"list_filter(list_distinct({duck_tokens(text)}), lambda t: t NOT IN ({_STOP}) AND (regexp_full_match(t, '[0-9]+') OR length(t) >= 2))"
_BASE = f"""{DUCK_SOURCES}, l AS (SELECT 'a-' || item_id AS answer_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS segment FROM benchmark),
g AS (SELECT answer_id, segment::BIGINT AS segment, text, {_TERMS('text')} AS terms FROM l WHERE length(trim(text)) > 0)"""
_TRACED = f"""{_BASE}, ev AS (SELECT source_id, unnest({_TERMS('text')}) AS token FROM sources), w AS (SELECT answer_id, segment, unnest(terms) AS token FROM g),
h AS (SELECT answer_id, segment, source_id, count(*) AS matched FROM w JOIN ev USING (token) GROUP BY 1, 2, 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, segment ORDER BY matched DESC, source_id) AS place FROM h) WHERE place <= 3),
b AS (SELECT answer_id, segment, count(DISTINCT token) AS by_set FROM w JOIN ev USING (token) SEMI JOIN p USING (answer_id, segment, source_id) GROUP BY 1, 2),
r AS (SELECT g.answer_id, g.segment, p.source_id, len(terms)::BIGINT AS n_terms, p.matched * 12 / 10 AS total, CASE WHEN len(terms) > 0 THEN coalesce(p.matched / len(terms), 0) ELSE 0 END::DOUBLE AS top_coverage,
  CASE WHEN len(terms) > 0 THEN coalesce(by_set / len(terms), 0) ELSE 0 END::DOUBLE AS set_coverage FROM g LEFT JOIN p ON g.answer_id = p.answer_id AND g.segment = p.segment AND p.place = 1 LEFT JOIN b ON g.answer_id = b.answer_id AND g.segment = b.segment),
t AS (SELECT *, CASE WHEN total >= 6 AND top_coverage >= 0.75 THEN 'grounded' WHEN total >= 2.5 AND top_coverage >= 0.35 THEN 'partially-grounded' ELSE 'unresolved' END AS top_status FROM r),
f AS (SELECT *, CASE WHEN top_status = 'unresolved' AND set_coverage >= 0.6 AND coalesce(total, 0) >= 2.5 THEN 'partially-grounded' ELSE top_status END AS final_status FROM t)"""
ORACLES = {
    "term_coverage": f"WITH {_BASE} SELECT g.answer_id, g.segment, len(g.terms)::BIGINT AS n_terms, round(CASE WHEN len(g.terms) = 0 THEN 0 ELSE len(list_intersect(g.terms, {duck_tokens('s.text')})) / len(g.terms) END::DOUBLE, 6) AS coverage FROM g JOIN sources s ON g.answer_id = 'a-' || s.doc_id",
    "grounding_status": f"""WITH {_TRACED} SELECT answer_id, segment, source_id, n_terms, round(top_coverage, 6) AS top_coverage, round(set_coverage, 6) AS set_coverage, top_status, final_status,
  array_to_string(list_filter([CASE WHEN total IS NULL THEN 'no-canonical-support' END, CASE WHEN total < 2.5 THEN 'low-top-result-score' END, CASE WHEN total IS NOT NULL AND top_coverage < 0.35 THEN 'low-top-result-coverage' END,
    CASE WHEN top_status = 'unresolved' AND final_status = 'partially-grounded' THEN 'support-set-partial-support' END, CASE WHEN top_status = 'partially-grounded' AND final_status = 'partially-grounded' THEN 'top-result-partial-support' END,
    CASE WHEN set_coverage < 0.6 AND final_status = 'unresolved' THEN 'weak-support-set-coverage' END, CASE WHEN final_status = 'grounded' THEN 'strong-top-result-support' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""",
    "answer_state_rollup": f"""WITH {_TRACED}, c AS (SELECT answer_id, count(*) AS segments, count(*) FILTER (final_status = 'grounded') AS grounded, count(*) FILTER (final_status = 'partially-grounded') AS partial, count(*) FILTER (final_status = 'unresolved') AS unresolved FROM f GROUP BY 1)
SELECT *, CASE WHEN grounded = segments THEN 'grounded' WHEN grounded + partial > 0 THEN 'partially-grounded' ELSE 'unresolved' END AS state FROM c""",
    "support_summary": f"WITH {_TRACED} SELECT source_id, final_status, count(*) AS segments, count(DISTINCT answer_id) AS answers FROM f WHERE source_id IS NOT NULL GROUP BY 1, 2",
    "support_dedup": f"WITH {_TRACED} SELECT answer_id, source_id, min(segment) AS first_segment, count(*) AS times FROM p GROUP BY 1, 2",
}
