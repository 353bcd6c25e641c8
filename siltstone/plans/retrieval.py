"""Queries on ranking and on the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens, guessed_language, query_tokens, tokens
from siltstone.operators import graph, retrieval
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_ARTIFACTS, DUCK_EDGES, DUCK_SOURCES, DUCK_UNITS

#: The standing queries: every query plan below ranks for all of them at once.
STANDING = {
    "q1": "the of and thonin erst",
    "q2": "licensed under the Apache License, Version 2.0",
    "q3": "est la une que des",
    "q4": "compare the public license with all rights reserved",
    "q5": "der die und nicht",
}


def _terms_sql() -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, t in sorted({(q, t) for q, text in STANDING.items() for t in query_tokens(text)}))
    return f"terms(query_id, token) AS (VALUES {rows})"


def _lexical_sql(name: str, records: str, keys: str, fields: dict[str, float]) -> str:
    stacked = " UNION ALL ".join(f"SELECT {keys}, '{f}' AS field, {w}::DOUBLE AS weight, unnest({duck_tokens(f)}) AS token FROM {records}" for f, w in fields.items())
    return f"""{name}_hits AS (SELECT {keys}, field, weight, token, count(*) AS hits FROM ({stacked}) GROUP BY ALL),
{name} AS (SELECT query_id, {keys}, sum(least(hits, {retrieval.TERM_CAP}) * round(weight * 10)::BIGINT)::BIGINT / 10::DOUBLE AS lexical FROM {name}_hits JOIN terms USING (token) GROUP BY query_id, {keys})"""


#: The source table with the names of the scored fields.
_FIELDS_SQL = "scored AS (SELECT source_id, title, text AS summary, current_path AS path FROM sources)"
_ALL_SQL = ",\n".join(
    [DUCK_SOURCES, DUCK_UNITS, DUCK_ARTIFACTS, DUCK_EDGES, _terms_sql(), _FIELDS_SQL]
    + [_lexical_sql("s", "scored", "source_id", retrieval.SOURCE_FIELDS), _lexical_sql("u", "units", "source_id, unit_id", retrieval.UNIT_FIELDS), _lexical_sql("a", "artifacts", "source_id, artifact_id", retrieval.ARTIFACT_FIELDS)]
    + [
        """density AS (SELECT source_id, coalesce(citations, 0)::BIGINT AS citations, n_units, least(coalesce(citations, 0) / n_units, 3.0)::DOUBLE AS density
  FROM (SELECT source_id, count(*) AS n_units FROM units GROUP BY 1) LEFT JOIN (SELECT related_source_id AS source_id, count(*) AS citations FROM edges GROUP BY 1) USING (source_id))""",
        f"""bu AS (SELECT query_id, source_id, sum(round(lexical * 10)::BIGINT)::BIGINT / 10::DOUBLE AS lexical_units FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY lexical DESC, unit_id) AS place FROM u) WHERE place <= {retrieval.TOP_UNITS} GROUP BY 1, 2)""",
        f"""ba AS (SELECT query_id, source_id, sum(round(lexical * 10)::BIGINT)::BIGINT / 10::DOUBLE AS lexical_artifacts FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY lexical DESC, artifact_id) AS place FROM a) WHERE place <= {retrieval.TOP_ARTIFACTS} GROUP BY 1, 2)""",
        """parts AS (SELECT query_id, source_id, coalesce(s.lexical, 0) AS lexical_source, coalesce(lexical_units, 0) AS lexical_units, coalesce(lexical_artifacts, 0) AS lexical_artifacts,
  0.3 * coalesce(density, 0) + greatest(0.0, 0.3 - 0.05 * 2)::DOUBLE AS metadata FROM s FULL JOIN bu USING (query_id, source_id) FULL JOIN ba USING (query_id, source_id) LEFT JOIN density USING (source_id))""",
        "scores AS (SELECT *, lexical_source + lexical_units + lexical_artifacts + metadata AS total FROM parts)",
    ]
)


def _scored_sources(spark, sf_dir):
    return corpus.sources(spark, sf_dir).select("source_id", "title", F.col("text").alias("summary"), F.col("current_path").alias("path"))


def _citations(spark, sf_dir):
    return corpus.edges(spark, sf_dir).select(F.col("related_source_id").alias("source_id"))


def _scores(spark, sf_dir):
    units = corpus.units(spark, sf_dir)
    return retrieval.source_scores(_scored_sources(spark, sf_dir), units, corpus.artifacts(spark, sf_dir), retrieval.density(_citations(spark, sf_dir), units), STANDING)


def _shown(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def retrieve_basic(spark, sf_dir):
    """The lexical score of every source for every standing query."""
    return _shown(retrieval.lexical(_scored_sources(spark, sf_dir), ["source_id"], retrieval.SOURCE_FIELDS, STANDING), "lexical")


def retrieve_units_top3(spark, sf_dir):
    scored = retrieval.lexical(corpus.units(spark, sf_dir), ["source_id", "unit_id"], retrieval.UNIT_FIELDS, STANDING)
    return _shown(retrieval.best(scored, ["query_id", "source_id"], [F.desc("lexical"), "unit_id"], retrieval.TOP_UNITS), "lexical")


def retrieve_artifacts_top5(spark, sf_dir):
    scored = retrieval.lexical(corpus.artifacts(spark, sf_dir), ["source_id", "artifact_id"], retrieval.ARTIFACT_FIELDS, STANDING)
    return _shown(retrieval.best(scored, ["query_id", "source_id"], [F.desc("lexical"), "artifact_id"], retrieval.TOP_ARTIFACTS), "lexical")


def retrieve_full_rank(spark, sf_dir):
    ranked = retrieval.ranked(_scores(spark, sf_dir), 10)
    return ranked.select("query_id", "place", "source_id", "total", "lexical_source", F.round("lexical_units", 6).alias("lexical_units"), F.round("lexical_artifacts", 6).alias("lexical_artifacts"), F.round("metadata", 6).alias("metadata"), "result_count")


def citation_density(spark, sf_dir):
    return _shown(retrieval.density(_citations(spark, sf_dir), corpus.units(spark, sf_dir)), "density")


def graph_hop1_single_origin(spark, sf_dir):
    """What neighbours gain from the best source of each query."""
    best = retrieval.ranked(_scores(spark, sf_dir), 1).select("query_id", "source_id", "total")
    return graph.one_hop(best, corpus.edges(spark, sf_dir))


def graph_hop1_all(spark, sf_dir):
    """What every source gains from all scored neighbours."""
    return graph.one_hop(_scores(spark, sf_dir).select("query_id", "source_id", "total"), corpus.edges(spark, sf_dir))


def graph_propagation_seq(spark, sf_dir):
    scores = _scores(spark, sf_dir).where("lexical_source + lexical_units + lexical_artifacts > 0")
    return _shown(graph.in_order(scores, corpus.edges(spark, sf_dir), ["relation_type", "source_id", "related_source_id"]), "total", "graph_bonus")


def compare_bonus(spark, sf_dir):
    gained = retrieval.compare_gains(_scores(spark, sf_dir))
    return gained.select("query_id", "source_id", "compare_bonus", F.round("total", 6).alias("total"))


def memory_gate(spark, sf_dir):
    """Conversation turns as remembered interactions, by role and text."""
    turns = corpus.table(spark, sf_dir, "conversations")
    n = F.size(tokens(F.col("text")))
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))
    rows = turns.select(
        "conv_id", "turn", pick(F.col("conv_id"), "interaction-memory", "interaction-pending", "corpus").alias("family"), pick(F.col("turn"), "contextual-only", "direct").alias("policy"),
        pick(F.col("conv_id") + F.col("turn"), "high", "medium", "low").alias("prior"), pick(F.col("turn") + 1, "operator-intent", "working-note", "decision").alias("kind"),
        (F.col("role") == "user").alias("relevant"), pick(n, "minimal", "contextual", "strong").alias("mode"), pick(n + F.col("turn"), "external-factual", "workspace-corpus", "general-stable", "composition").alias("domain"),
        (F.pmod(n, F.lit(9)) * 0.75).alias("lexical"),
    )
    return _shown(retrieval.memory_gate(rows).select("conv_id", "turn", "admitted", "adjustment"), "adjustment")


def support_tiers(spark, sf_dir):
    """Which units stand for each of the first ten sources of a query."""
    found = retrieval.ranked(_scores(spark, sf_dir), 10).select("query_id", "source_id")
    units, arts = corpus.units(spark, sf_dir), corpus.artifacts(spark, sf_dir)
    scored = retrieval.lexical(units, ["source_id", "unit_id"], retrieval.UNIT_FIELDS, STANDING).withColumnRenamed("lexical", "weight").join(found, ["query_id", "source_id"], "left_semi")
    with_art = found.join(arts.select("source_id", "unit_id"), "source_id").withColumn("weight", F.lit(0.0))
    cited = found.join(units.where("ordinal <= 3").select("source_id", "unit_id"), "source_id").withColumn("weight", F.lit(0.0))
    return retrieval.support_units(scored, with_art, cited)


def token_stats(spark, sf_dir):
    toks = tokens(F.col("text"))
    per = corpus.sources(spark, sf_dir).select("origin", F.size(toks).alias("n"), F.size(F.array_distinct(toks)).alias("d"))
    return per.groupBy("origin").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("n_tokens"), F.max("n").cast("long").alias("longest"), F.sum("d").cast("long").alias("distinct_in_docs"))


def language_guess(spark, sf_dir):
    return corpus.sources(spark, sf_dir).groupBy("lang", guessed_language(F.col("text")).alias("guessed")).agg(F.count("*").alias("docs"))


QUERIES = {f.__name__: f for f in (retrieve_basic, retrieve_units_top3, retrieve_artifacts_top5, retrieve_full_rank, citation_density, graph_hop1_single_origin, graph_hop1_all, graph_propagation_seq, compare_bonus, memory_gate, support_tiers, token_stats, language_guess)}

_RANKED_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, lexical_source DESC, source_id) AS place, count(*) OVER (PARTITION BY query_id) AS result_count
  FROM (SELECT query_id, source_id, floor(total * 1000 + 0.5) / 1000 AS total, lexical_source, lexical_units, lexical_artifacts, metadata FROM scores) WHERE total > 0)"""
_LINKS_SQL = """adj AS (SELECT source_id, related_source_id AS neighbor, strength FROM edges UNION ALL SELECT related_source_id, source_id, strength FROM edges),
links AS (SELECT source_id, neighbor, max(CASE strength WHEN 'high' THEN 1.5 WHEN 'medium' THEN 0.8 ELSE 0.5 END)::DOUBLE AS weight FROM adj WHERE source_id <> neighbor GROUP BY 1, 2)"""
_GAIN_SQL = "SELECT query_id, neighbor AS source_id, sum((total * 0.15::DOUBLE * weight)::DECIMAL(18,9))::DOUBLE AS graph_bonus FROM {rows} JOIN links USING (source_id) WHERE total > 0 GROUP BY 1, 2"

ORACLES = {
    "retrieve_basic": f"WITH {_ALL_SQL} SELECT query_id, source_id, round(lexical, 6) AS lexical FROM s",
    "retrieve_units_top3": f"WITH {_ALL_SQL} SELECT query_id, source_id, unit_id, round(lexical, 6) AS lexical, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY lexical DESC, unit_id) AS place FROM u) WHERE place <= 3",
    "retrieve_artifacts_top5": f"WITH {_ALL_SQL} SELECT query_id, source_id, artifact_id, round(lexical, 6) AS lexical, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY lexical DESC, artifact_id) AS place FROM a) WHERE place <= 5",
    "retrieve_full_rank": f"WITH {_ALL_SQL}, {_RANKED_SQL} SELECT query_id, place::INT AS place, source_id, total, lexical_source, round(lexical_units, 6) AS lexical_units, round(lexical_artifacts, 6) AS lexical_artifacts, round(metadata, 6) AS metadata, result_count FROM ranked WHERE place <= 10",
    "citation_density": f"WITH {_ALL_SQL} SELECT source_id, citations, n_units, round(density, 6) AS density FROM density",
    "graph_hop1_single_origin": f"WITH {_ALL_SQL}, {_RANKED_SQL}, {_LINKS_SQL} " + _GAIN_SQL.format(rows="(SELECT * FROM ranked WHERE place = 1)"),
    "graph_hop1_all": f"WITH {_ALL_SQL}, {_LINKS_SQL} " + _GAIN_SQL.format(rows="scores"),
    "compare_bonus": f"""WITH {_ALL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, source_id) AS place FROM scores),
b AS (SELECT *, CASE WHEN lexical_source + lexical_units + lexical_artifacts > 0.5 THEN CASE place WHEN 2 THEN 1.2 WHEN 3 THEN 0.6 ELSE 0 END ELSE 0 END::DOUBLE AS compare_bonus FROM p)
SELECT query_id, source_id, compare_bonus, round(total + compare_bonus, 6) AS total FROM b WHERE compare_bonus > 0""",
    "memory_gate": f"""WITH t AS (SELECT *, len({duck_tokens('text')}) AS n FROM conversations),
r AS (SELECT conv_id, turn, ['interaction-memory', 'interaction-pending', 'corpus'][conv_id % 3 + 1] AS family, ['contextual-only', 'direct'][turn % 2 + 1] AS policy, ['high', 'medium', 'low'][(conv_id + turn) % 3 + 1] AS prior,
  ['operator-intent', 'working-note', 'decision'][(turn + 1) % 3 + 1] AS kind, role = 'user' AS relevant, ['minimal', 'contextual', 'strong'][n % 3 + 1] AS mode,
  ['external-factual', 'workspace-corpus', 'general-stable', 'composition'][(n + turn) % 4 + 1] AS domain, (n % 9) * 0.75 AS lexical FROM t),
g AS (SELECT *, family = 'corpus' OR NOT (domain = 'external-factual' OR (domain = 'workspace-corpus' AND mode = 'minimal') OR (mode = 'minimal' AND lexical < 2)
  OR (domain = 'general-stable' AND policy = 'contextual-only' AND lexical < 4) OR (domain = 'workspace-corpus' AND kind IN ('operator-intent', 'working-note') AND lexical < 3)) AS admitted FROM r)
SELECT conv_id, turn, admitted, round(CASE WHEN family <> 'corpus' AND admitted THEN CASE prior WHEN 'high' THEN 1.2 WHEN 'medium' THEN 0.5 ELSE 0.0 END
  + CASE mode WHEN 'strong' THEN 0.4 + CASE WHEN relevant THEN 0.6 ELSE 0 END WHEN 'contextual' THEN 0.15 + CASE WHEN relevant THEN 0.35 ELSE 0 END - CASE WHEN policy = 'contextual-only' THEN 0.1 ELSE 0 END
    ELSE CASE WHEN policy = 'contextual-only' THEN -1.0 ELSE -0.4 END END ELSE 0 END::DOUBLE, 6) AS adjustment FROM g""",
    "support_tiers": f"""WITH {_ALL_SQL}, {_RANKED_SQL}, f AS (SELECT query_id, source_id FROM ranked WHERE place <= 10),
t AS (SELECT query_id, source_id, unit_id, lexical AS weight, 1 AS tier FROM u SEMI JOIN f USING (query_id, source_id)
  UNION ALL SELECT query_id, source_id, unit_id, 0, 2 FROM f JOIN artifacts USING (source_id) UNION ALL SELECT query_id, source_id, unit_id, 0, 3 FROM f JOIN units USING (source_id) WHERE ordinal <= 3),
k AS (SELECT *, min(tier) OVER (PARTITION BY query_id, source_id) AS first FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY weight DESC, unit_id) AS place FROM k WHERE tier = first)
SELECT query_id, source_id, unit_id, tier, place::INT AS place FROM o WHERE place <= 3""",
    "token_stats": f"""WITH {DUCK_SOURCES}, t AS (SELECT origin, {duck_tokens('text')} AS t FROM sources)
SELECT origin, count(*) AS docs, sum(len(t))::BIGINT AS n_tokens, max(len(t))::BIGINT AS longest, sum(len(list_distinct(t)))::BIGINT AS distinct_in_docs FROM t GROUP BY origin""",
    "language_guess": f"""WITH {DUCK_SOURCES} SELECT lang, CASE WHEN length(trim(text)) = 0 THEN 'unknown' WHEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1) > 0.95 THEN 'en' ELSE 'other' END AS guessed, count(*) AS docs FROM sources GROUP BY 1, 2""",
}
