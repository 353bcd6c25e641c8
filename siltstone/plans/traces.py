"""Queries on states of traces. Events stand for traces: their fields are picked by value, hour and key."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import traces
from siltstone.sources import corpus

MODES = ["exact", "approximate", "none"]
BASES = ["kb-grounded", "mixed", "external-source-verified", "model-knowledge", None]
STATES = ["grounded", "partially-grounded", "unresolved", "abstained"]


def _pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _events(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    own = F.concat(F.lit("s"), (u % 9).cast("string"))
    rows = corpus.table(spark, sf_dir, "events").select(
        "event_id", own.alias("source"), F.when(e % 3 > 0, F.concat(F.lit("s"), (e % 9).cast("string"))).alias("target"), (e % 7 == 0).alias("compare"), (e % 11 == 0).alias("hard"), (e % 2 == 0).alias("narrowing"), _pick(e, MODES).alias("match"),
        F.when(e % 4 == 0, F.lit(0.0)).otherwise(F.round("value", 3)).alias("lexical"), (e % 10).cast("double").alias("reference"), F.when(e % 13 == 0, "interaction-memory").otherwise("corpus").alias("family"),
        F.when(e % 14 == 0, F.array()).otherwise(F.array(F.lit("s1"), F.lit("s4"))).cast("array<string>").alias("compared"), F.array(own, F.concat(F.lit("s"), (e % 9).cast("string"))).alias("supporting"),
        _pick(e, BASES).alias("basis"), F.when(e % 3 == 1, "m.json").when(e % 3 == 2, "").alias("manifest"), _pick(u + e, STATES[:3]).alias("kb_state"), F.when(e % 17 == 0, _pick(u, STATES)).alias("declared"),
        (F.col("event_type") == "error").alias("abstained"), (e % 5 > 1).alias("required"), F.when(e % 6 > 0, e % 6 > 2).alias("sufficient"), F.when(e % 8 > 0, e % 8 > 6).alias("escalation"), (u % 3).alias("unresolved"), (u % 2 == 0).alias("explainable"),
    )
    return rows.withColumn("mode", traces.scope_mode(*map(F.col, ("compare", "hard", "target", "narrowing", "match"))))


def trace_states(spark, sf_dir):
    c = F.col
    rows = _events(spark, sf_dir).withColumn("direct", traces.direct_score(c("lexical"), c("reference")))
    rows = rows.withColumn("state", traces.final_state(c("declared"), c("abstained"), c("basis"), c("manifest"), c("kb_state")))
    rows = rows.withColumn("satisfied", traces.scope_satisfied(c("mode"), c("state"), c("target"), c("compared"), c("supporting")))
    names = ("mode", "basis", "satisfied", "sufficient", "escalation", "state", "unresolved", "manifest", "explainable")
    found = traces.issues({n: c(n) for n in names} | {"compare_status": F.when(c("match") == "none", "unresolved").otherwise(c("match"))})
    return rows.select(
        "event_id", "mode", "direct", traces.admissible(c("family"), c("direct"), c("mode"), c("source"), c("target"), c("compared")).alias("canonical"), "state", "satisfied",
        traces.trace_status(c("state"), c("basis"), c("manifest")).alias("status"), traces.render_required(c("required"), c("basis"), c("state"), c("manifest")).alias("render"), found.alias("issues"),
        F.coalesce((c("sufficient") == F.lit(False)) | (c("escalation") == F.lit(True)), F.lit(False)).alias("gap"),
    )


def support_ids(spark, sf_dir):
    """The sources, units and artifacts that the events of a user name, each once in order of time."""
    e = F.col("event_id")
    rows = corpus.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(e % 7 > 0, F.concat(F.lit("s"), (e % 5).cast("string"))).alias("sources"), F.concat(F.lit("u"), (e % 4).cast("string")).alias("units"), F.when(e % 3 == 0, "").otherwise(F.col("event_type")).alias("artifacts"))
    return traces.ordered_ids(rows, "user_id", "event_id", ["sources", "units", "artifacts"])


QUERIES = {f.__name__: f for f in (trace_states, support_ids)}

_l = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
_IDS = lambda c: f"(SELECT coalesce(string_agg(v, ',' ORDER BY pos), '') FROM (SELECT {c} AS v, min(event_id) AS pos FROM r x WHERE x.user_id = k.user_id AND {c} <> '' GROUP BY 1))"
ORACLES = {
    "trace_states": f"""WITH r AS (SELECT event_id, event_id AS e, user_id AS u, 's' || user_id % 9 AS source, CASE WHEN event_id % 3 > 0 THEN 's' || event_id % 9 END AS target, {_l(MODES)}[event_id % 3 + 1] AS match, CASE WHEN event_id % 4 = 0 THEN 0 ELSE round(value, 3) END::DOUBLE AS lexical,
  CASE WHEN event_id % 14 = 0 THEN [] ELSE ['s1', 's4'] END::VARCHAR[] AS compared, {_l(BASES)}[event_id % 5 + 1] AS basis, CASE event_id % 3 WHEN 1 THEN 'm.json' WHEN 2 THEN '' END AS manifest, {_l(STATES[:3])}[(user_id + event_id) % 3 + 1] AS kb, CASE WHEN event_id % 17 = 0 THEN {_l(STATES)}[user_id % 4 + 1] END AS declared,
  CASE WHEN event_id % 6 > 0 THEN event_id % 6 > 2 END AS sufficient, CASE WHEN event_id % 8 > 0 THEN event_id % 8 > 6 END AS escalation, event_type FROM events),
m AS (SELECT *, CASE WHEN e % 7 = 0 THEN 'compare' WHEN e % 11 = 0 THEN 'source-scoped-hard' WHEN target IS NOT NULL AND e % 2 = 0 AND match <> 'none' THEN 'source-scoped-soft' ELSE 'global' END AS mode, CASE WHEN lexical > 0 THEN lexical WHEN e % 10 >= 6 THEN e % 10 ELSE 0 END::DOUBLE AS direct,
  CASE WHEN declared IS NOT NULL THEN declared WHEN event_type = 'error' THEN 'abstained' WHEN basis = 'external-source-verified' AND manifest <> '' THEN 'grounded' WHEN basis = 'mixed' AND manifest <> '' AND kb = 'unresolved' THEN 'partially-grounded' ELSE kb END AS state, coalesce(manifest <> '', false) AS held FROM r),
s AS (SELECT *, CASE WHEN mode = 'global' OR state = 'abstained' THEN true WHEN mode = 'compare' THEN CASE WHEN len(compared) > 0 THEN list_has_any([source, 's' || e % 9], compared) ELSE source <> 's' || e % 9 END ELSE coalesce(target IN (source, 's' || e % 9), false) END AS satisfied FROM m)
SELECT event_id, mode, direct, e % 13 <> 0 AND direct > 0 AND CASE WHEN mode LIKE 'source%' AND target IS NOT NULL THEN source = target WHEN mode = 'compare' AND len(compared) > 0 THEN list_contains(compared, source) ELSE true END AS canonical, state, satisfied,
  CASE WHEN CASE WHEN state = 'abstained' THEN true WHEN basis = 'mixed' THEN state IN ('grounded', 'partially-grounded') OR held WHEN basis IN ('external-source-verified', 'model-knowledge') THEN state IN ('grounded', 'partially-grounded') ELSE state = 'grounded' END THEN 'ready' ELSE 'degraded' END AS status,
  e % 5 > 1 AND NOT (state = 'abstained' OR coalesce(basis IN ('external-source-verified', 'model-knowledge'), false) OR (coalesce(basis = 'mixed', false) AND state = 'unresolved' AND held)) AS render,
  array_to_string(list_filter([CASE WHEN sufficient = false THEN 'published-artifacts-gap' END, CASE WHEN escalation THEN 'source-escalation-required' END, CASE WHEN mode LIKE 'source%' AND NOT satisfied THEN 'source-scope-missing-target-support' END,
    CASE WHEN mode = 'compare' AND NOT satisfied THEN 'compare-source-coverage-missing' END, CASE WHEN mode = 'compare' AND match = 'approximate' THEN 'compare-source-approximate' END, CASE WHEN mode = 'compare' AND match = 'none' THEN 'compare-source-unresolved' END,
    CASE WHEN state = 'grounded' AND (basis IS NULL OR basis IN ('kb-grounded', 'mixed')) AND u % 3 > 0 THEN 'trace-answer-state-mismatch' END, CASE WHEN basis = 'mixed' AND NOT held AND u % 2 <> 0 THEN 'mixed-support-unexplained' END], lambda x: x IS NOT NULL), ',') AS issues,
  coalesce(sufficient = false, false) OR coalesce(escalation, false) AS gap FROM s""",
    "support_ids": f"""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 7 > 0 THEN 's' || event_id % 5 END AS sources, 'u' || event_id % 4 AS units, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS artifacts FROM events), k AS (SELECT DISTINCT user_id FROM r)
SELECT user_id, {_IDS('sources')} AS sources, {_IDS('units')} AS units, {_IDS('artifacts')} AS artifacts FROM k""",
}
