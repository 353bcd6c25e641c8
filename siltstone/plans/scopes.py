"""Queries on what questions mean and whether answers keep to it, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions.text import duck_tokens
from siltstone.operators import grounding, scopes
from siltstone.plans import grounding as answers
from siltstone.plans import interactions
from siltstone.plans import retrieval as ranking
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS

MODES = [scopes.GLOBAL, scopes.SOFT, scopes.HARD, scopes.COMPARE]
BASES = ["kb-grounded", "mixed", "external-source-verified", "model-knowledge", "unknown", "governed-boundary"]
STATES = ["grounded", "partially-grounded", "unresolved", "abstained", "done"]


def _pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _questions(spark, sf_dir):
    """Benchmark items as questions of seven forms about a document and the next one."""
    docs = corpus.sources(spark, sf_dir)
    last = docs.agg((F.max("doc_id") + 1).alias("last"))
    k, n = F.col("item_id"), F.col("item_id") * 7919 % F.col("last")
    items = corpus.table(spark, sf_dir, "benchmark").join(F.broadcast(last)).select("item_id", n.alias("n"), ((n + 1) % F.col("last")).alias("n2"))  # one row
    one, two = docs.select(F.col("doc_id").alias("n"), "current_path", "title"), docs.select(F.col("doc_id").alias("n2"), F.col("current_path").alias("other"))
    line = (k % 9 + 1).cast("string")
    forms = [
        F.concat(F.lit("what does line "), line, F.lit(" of "), "current_path", F.lit(" say")), F.concat(F.lit("Summarise: "), "title"), F.concat(F.lit('use only the document "'), "current_path", F.lit('" and its line '), line),
        F.concat(F.lit('use only the file "missing-'), k, F.lit('.pdf"')), F.concat(F.lit('compare "'), "current_path", F.lit('" with "'), "other", F.lit('"')), F.concat(F.lit('compare "'), "current_path", F.lit('" with "nothing-'), k, F.lit('.pdf"')),
        F.concat(F.lit("what does line "), line, F.lit(" say about the diagram")),
    ]
    text = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    return items.join(one, "n").join(two, "n2").select(F.concat(F.lit("q-"), "item_id").alias("question_id"), text.alias("text"))


def reference_resolution(spark, sf_dir):
    docs = corpus.sources(spark, sf_dir)
    aliases = docs.select("source_id", F.col("current_path").alias("alias"), F.lit("path").alias("basis")).union(docs.select("source_id", F.col("title").alias("alias"), F.lit("title").alias("basis")))
    units = corpus.units(spark, sf_dir).select("source_id", "unit_id", F.col("ordinal").alias("line_start"), F.col("ordinal").alias("line_end"))
    found = scopes.resolved(_questions(spark, sf_dir), aliases, units)
    return found.withColumns({"held_to": F.array_join("held_to", ","), "expected": F.col("expected").cast("long"), "missing": F.col("missing").cast("long")})


def scoped_support(spark, sf_dir):
    """Answers with a scope each: whether every segment keeps to it, and the state, status and issues that follow."""
    segments, evidence = answers._segments(spark, sf_dir), answers._evidence(spark, sf_dir)
    traced = grounding.statuses(segments, evidence).select("answer_id", "segment", "source_id", "final_status", "supporting")
    best = traced.groupBy("answer_id").agg(F.min("source_id").alias("best"))
    k, none = F.regexp_extract("answer_id", "[0-9]+", 0).cast("long"), F.array().cast("array<string>")
    rows = traced.drop("source_id").join(best, "answer_id", "left").withColumns({"k": k, "scope": _pick(k, MODES)})
    own = F.concat(F.lit("doc-"), "k")
    rows = rows.withColumns({"target": F.when(F.col("scope") == scopes.SOFT, F.col("best")).when(F.col("scope") == scopes.HARD, own), "compared": F.when((F.col("scope") == scopes.COMPARE) & F.col("best").isNotNull(), F.array_distinct(F.array(F.col("best"), own))).otherwise(none)})
    kept = scopes.segment_satisfied(F.col("scope"), F.col("final_status"), F.col("target"), F.col("compared"), F.col("supporting"))
    count = lambda s: F.count_if(F.col("final_status") == s)
    rolled = rows.withColumn("kept", kept).groupBy("answer_id", "k", "scope").agg(
        F.count("*").alias("segments"), count("grounded").alias("grounded"), count("partially-grounded").alias("partial"), count("unresolved").alias("unresolved"), F.bool_and("kept").alias("kept"),
        F.max(F.array_contains("supporting", F.try_element_at("compared", F.lit(1)))).alias("has_first"), F.max(F.coalesce(F.array_contains("supporting", F.try_element_at("compared", F.lit(2))), F.lit(False))).alias("has_second"),
    )
    both = (F.col("scope") != scopes.COMPARE) | (F.coalesce("has_first", F.lit(False)) & F.col("has_second"))
    known = F.when(F.col("grounded") == F.col("segments"), "grounded").when(F.col("grounded") + F.col("partial") > 0, "partially-grounded").otherwise("unresolved")
    basis, manifest, k = F.when(F.col("k") % 6 < 4, _pick(F.col("k"), BASES)), F.col("k") % 3 == 0, F.col("k")
    rolled = rolled.withColumns({"satisfied": F.col("kept") & both, "basis": basis, "state": scopes.final_state(known, k % 11 == 5, basis, manifest, F.when(k % 13 == 6, "unresolved"))})
    wrong = scopes.issue_codes(F.col("state"), F.col("scope"), F.col("satisfied"), _pick(k, ["exact", "approximate", "unresolved"]), F.col("unresolved"), F.col("basis"), k % 7 != 0, k % 5 == 0, manifest)
    return rolled.select(
        "answer_id", "scope", "segments", "satisfied", "state", scopes.trace_status(F.col("state"), F.coalesce("basis", F.lit("")), manifest).alias("status"),
        scopes.needs_render(k % 2 == 0, F.col("state"), F.col("basis"), manifest).alias("render"), wrong.alias("issues"),
    )


def support_admission(spark, sf_dir):
    """How many results of each standing query may be canonical support under each scope."""
    n = F.regexp_extract("source_id", "[0-9]+", 0).cast("long")
    scope, target = _pick(n, MODES), F.concat(F.lit("doc-"), n - n % 3)
    direct = scopes.direct_support(F.col("lexical_source") + F.col("lexical_units") + F.col("lexical_artifacts"), (n % 9).cast("double"))
    may = scopes.admitted(F.when(n % 10 > 0, "corpus").otherwise("interaction"), direct, scope, F.col("source_id"), target, F.array(target))
    return ranking._scores(spark, sf_dir).groupBy("query_id", scope.alias("scope")).agg(F.count("*").alias("results"), F.count_if(may).alias("admitted"))


def log_bindings(spark, sf_dir):
    """Events as log records of runs and turns: how many are bound to their turn, and why the others are not."""
    events = corpus.table(spark, sf_dir, "events").withColumn("turn", F.dayofmonth("ts").cast("long") % 8)
    runs = events.where("event_id % 60 < 50").groupBy((F.col("event_id") % 60).alias("run")).agg(F.min_by(F.struct("user_id", "turn", "event_type"), "event_id").alias("r"))
    runs = runs.select(F.concat(F.lit("run-"), "run").alias("run_id"), F.col("r.user_id").alias("run_user"), F.col("r.turn").alias("run_turn"), (F.col("r.event_type") != "view").alias("front"))
    key = F.col("conv_id") + F.col("turn")
    turns = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", (F.col("turn") % 4 != 3).alias("canonical"), F.concat(F.lit("run-"), key % 60).alias("committed"), F.when(key % 3 == 0, F.concat(F.lit("run-"), key % 50)).otherwise("").alias("active"))
    own = F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("run-"), F.col("event_id") % 60))
    rows = events.withColumn("run_id", own).join(runs, "run_id", "left").join(turns, ["user_id", "turn"], "left")
    fits = (F.col("run_user") == F.col("user_id")) & (F.col("run_turn") == F.col("turn"))
    state = scopes.binding(F.col("run_id"), F.col("canonical").isNotNull(), F.col("run_user").isNotNull(), fits, F.col("front"), F.col("canonical"), F.col("committed"), F.col("active"))
    return rows.groupBy(state.alias("binding")).agg(F.count("*").alias("records"), F.min("event_id").alias("first"))


def commit_contracts(spark, sf_dir):
    e = F.col("event_id")
    wrong = scopes.commit_errors(_pick(e, STATES), _pick(e, BASES), F.when(e % 4 > 0, "m").otherwise(""), F.when(e % 7 > 0, F.col("event_type")))
    return corpus.table(spark, sf_dir, "events").select("event_id", wrong.alias("errors"))


QUERIES = {f.__name__: f for f in (reference_resolution, scoped_support, support_admission, log_bindings, commit_contracts)}


def _leader(rows: str, exact_counts: bool) -> str:
    sure = " OR (score > runner_up AND exact AND NOT other)" if exact_counts else ""
    return f"""SELECT *, coalesce(CASE WHEN runner_up IS NULL THEN score > 0 ELSE (score > runner_up AND (score - runner_up >= 8 OR score >= 1.25 * runner_up)){sure} END, false) AS clear
  FROM (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS runner_up, lead(exact) OVER w AS other FROM ({rows}) WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, exact DESC, source_score DESC, source_id)) WHERE place = 1"""


_quote = lambda s: "'" + s.replace("'", "''").replace("一-鿿", chr(0x4E00) + "-" + chr(0x9FFF)) + "'"
_list = lambda xs: "[" + ", ".join(map(_quote, xs)) + "]"
_RESOLVED = rf"""{DUCK_SOURCES}, {DUCK_UNITS},
it AS (SELECT item_id AS k, item_id * 7919 % (SELECT max(doc_id) + 1 FROM documents) AS n, (item_id * 7919 % (SELECT max(doc_id) + 1 FROM documents) + 1) % (SELECT max(doc_id) + 1 FROM documents) AS n2 FROM benchmark),
fo AS (SELECT k, ['what does line ' || (k % 9 + 1) || ' of ' || a.current_path || ' say', 'Summarise: ' || a.title, 'use only the document "' || a.current_path || '" and its line ' || (k % 9 + 1), 'use only the file "missing-' || k || '.pdf"',
  'compare "' || a.current_path || '" with "' || b.current_path || '"', 'compare "' || a.current_path || '" with "nothing-' || k || '.pdf"', 'what does line ' || (k % 9 + 1) || ' say about the diagram'][k % 7 + 1] AS asked
  FROM it JOIN sources a ON a.doc_id = n JOIN sources b ON b.doc_id = n2),
hn AS (SELECT 'q-' || k AS q, asked, regexp_matches(asked, {_quote(P.COMPARE_SCOPE)}) AS compare, regexp_extract_all(asked, '"([^"]+)"', 1) AS names, regexp_matches(asked, {_quote(P.SINGLE_SOURCE)}) AS single,
  try_cast(nullif(regexp_extract(lower(asked), '\blines?[ #-]*0*([0-9]+)', 1), '') AS BIGINT) AS line FROM fo),
hi0 AS (SELECT *, CASE WHEN compare AND len(names) >= 2 THEN names[1:2] ELSE [] END AS declared, CASE WHEN NOT (compare AND len(names) >= 2) THEN names[1] END AS requested FROM hn),
qs AS (SELECT q || '#0' AS question_id, coalesce(requested, asked) AS text FROM hi0 UNION ALL SELECT q || '#1', declared[1] FROM hi0 WHERE len(declared) > 0 UNION ALL SELECT q || '#2', declared[2] FROM hi0 WHERE len(declared) > 0)
{interactions.MATCHED},
be AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source_id ORDER BY score DESC, (basis = 'path') DESC) AS r FROM ma) WHERE r = 1),
ca AS (SELECT q AS question_id, be.source_id, basis, score AS source_score, exact, u.unit_id, score + CASE WHEN u.unit_id IS NULL THEN 0 ELSE 58 END AS score FROM be JOIN hi0 ON be.question_id = q || '#0' LEFT JOIN units u ON u.source_id = be.source_id AND u.ordinal = line
  UNION ALL SELECT q, f.source_id, NULL, 0, false, 'line-' || lpad(line::VARCHAR, 4, '0'), 58 FROM hi0 JOIN (SELECT ordinal, min(source_id) AS source_id FROM units GROUP BY 1) f ON ordinal = line),
ex AS ({_leader('SELECT * FROM ca WHERE exact', False)}), ap AS ({_leader('SELECT * FROM ca WHERE source_score > 0', True)}), fa AS ({_leader('SELECT * FROM ca', False)}),
cn AS (SELECT question_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (source_score > 0) AS n_known, count(unit_id) AS n_unit FROM ca GROUP BY 1),
ch AS (SELECT hi0.*, coalesce(n_exact, 0) AS n_exact, coalesce(ex.clear, false) AS sure,
  requested IS NOT NULL OR regexp_matches(asked, {_quote(scopes.DOCUMENT_HINT)}) OR coalesce(n_exact, 0) > 0 OR line IS NOT NULL OR len(declared) > 0 AS detected,
  CASE WHEN coalesce(ex.clear, false) THEN 'e' WHEN coalesce(n_known, 0) > 0 AND NOT (requested IS NOT NULL AND n_exact >= 2) THEN CASE WHEN ap.clear THEN 'a' END WHEN coalesce(n_unit, 0) > 0 THEN 'f' END AS way,
  CASE way WHEN 'e' THEN ex.source_id WHEN 'a' THEN ap.source_id WHEN 'f' THEN fa.source_id END AS s, CASE way WHEN 'e' THEN ex.unit_id WHEN 'a' THEN ap.unit_id WHEN 'f' THEN fa.unit_id END AS u,
  CASE way WHEN 'e' THEN ex.basis WHEN 'a' THEN ap.basis WHEN 'f' THEN fa.basis END AS bs
  FROM hi0 LEFT JOIN cn ON cn.question_id = q LEFT JOIN ex ON ex.question_id = q LEFT JOIN ap ON ap.question_id = q LEFT JOIN fa ON fa.question_id = q),
sh AS (SELECT ch.* REPLACE (CASE WHEN detected THEN s END AS s), coalesce(len(list_intersect({duck_tokens('asked')}, {duck_tokens('alias')})) / nullif(len(list_distinct({duck_tokens('asked')})), 0), 0) AS share FROM ch LEFT JOIN ak ON ak.source_id = s AND ak.basis = bs),
st AS (SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN sure THEN 'exact' ELSE 'approximate' END WHEN detected THEN 'unresolved' ELSE 'none' END AS match, s IS NOT NULL AND (line IS NOT NULL OR requested IS NULL) AND u IS NOT NULL AS unit,
  s IS NOT NULL AND sure AND NOT compare AND (regexp_matches(asked, {_quote(scopes.DOCUMENT_HINT)}) OR line IS NOT NULL OR share >= 0.5 OR NOT regexp_matches(asked, {_quote(scopes.ARTIFACT_HINT)})) AS narrowing FROM sh),
sp AS (SELECT *, single AND requested IS NOT NULL AND match <> 'exact' AS stopped, CASE WHEN match = 'exact' AND line IS NOT NULL AND NOT unit THEN 'approximate' ELSE match END AS status0 FROM st),
dc AS (SELECT question_id, source_id, score, exact, score AS source_score FROM be WHERE NOT ends_with(question_id, '#0')),
de AS ({_leader('SELECT * FROM dc WHERE exact', False)}), da AS ({_leader('SELECT * FROM dc', True)}),
dm AS (SELECT regexp_extract(qs.question_id, '^[^#]+') AS q, CASE WHEN coalesce(de.clear, false) THEN de.source_id WHEN da.clear THEN da.source_id END AS source_id, coalesce(de.clear, false) AS sure
  FROM qs LEFT JOIN de USING (question_id) LEFT JOIN da ON da.question_id = qs.question_id WHERE NOT ends_with(qs.question_id, '#0')),
dr AS (SELECT q, count(*) AS expected, count(DISTINCT source_id) AS met, count(*) FILTER (sure) AS n_sure, list_sort(list_distinct(list(source_id) FILTER (source_id IS NOT NULL))) AS ids FROM dm GROUP BY 1),
cs AS (SELECT q, expected, expected - met AS missing, CASE WHEN met = expected AND n_sure = expected THEN 'exact' ELSE 'unresolved' END AS cst, ids FROM dr),
fi AS (SELECT sp.q AS question_id, detected, coalesce(cst, CASE WHEN stopped THEN 'unresolved' ELSE status0 END) AS status,
  CASE WHEN cst = 'exact' AND (stopped OR match = 'unresolved') THEN 'none' WHEN stopped THEN 'unresolved' ELSE match END AS source_match,
  CASE WHEN unit AND NOT stopped THEN 'exact' WHEN line IS NOT NULL AND (detected OR stopped) THEN 'unresolved' ELSE 'none' END AS unit_match, CASE WHEN NOT stopped THEN s END AS source_id, CASE WHEN NOT stopped AND unit THEN u END AS unit_id, narrowing,
  CASE WHEN cst = 'unresolved' THEN 'compare-source-unresolved' WHEN cst IS NOT NULL THEN NULL WHEN stopped THEN CASE WHEN n_exact >= 2 THEN 'ambiguous-source' ELSE 'missing-source' END WHEN status0 = 'approximate' THEN 'soft-approximation' WHEN status0 = 'unresolved' THEN 'ambiguous-source' END AS reason,
  coalesce(cst <> 'exact', stopped) AS hard_boundary, CASE WHEN compare THEN 'compare' WHEN single THEN 'source-scoped-hard' WHEN NOT stopped AND s IS NOT NULL AND narrowing THEN 'source-scoped-soft' ELSE 'global' END AS scope,
  coalesce(expected, 0)::BIGINT AS expected, coalesce(missing, 0)::BIGINT AS missing, coalesce(ids, []) AS ids FROM sp LEFT JOIN cs USING (q))"""
_pk = lambda key, values: f"{_list(values)}[{key} % {len(values)} + 1]"
_join = lambda cases: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in cases.items()) + "], lambda x: x IS NOT NULL), ',')"
_SCOPED = f"""{answers._TRACED}, su AS (SELECT answer_id, segment, list(source_id) AS supporting FROM p GROUP BY 1, 2), bt AS (SELECT answer_id, min(source_id) AS best FROM p WHERE place = 1 GROUP BY 1),
ro AS (SELECT f.answer_id, segment, final_status, regexp_extract(f.answer_id, '[0-9]+')::BIGINT AS k, {_pk('k', MODES)} AS scope, coalesce(supporting, []) AS supporting, best FROM f LEFT JOIN su USING (answer_id, segment) LEFT JOIN bt ON bt.answer_id = f.answer_id),
sg AS (SELECT *, CASE scope WHEN 'source-scoped-soft' THEN coalesce(list_contains(supporting, best), false) WHEN 'source-scoped-hard' THEN list_contains(supporting, 'doc-' || k)
  WHEN 'compare' THEN CASE WHEN best IS NULL THEN len(supporting) >= 2 ELSE list_has_any(supporting, [best, 'doc-' || k]) END ELSE true END AS kept FROM ro),
an AS (SELECT answer_id, k, scope, count(*) AS segments, count(*) FILTER (final_status = 'grounded') AS grounded, count(*) FILTER (final_status = 'partially-grounded') AS part, count(*) FILTER (final_status = 'unresolved') AS unresolved, bool_and(kept) AS kept,
  bool_or(coalesce(list_contains(supporting, best), false)) AS one, bool_or(list_contains(supporting, 'doc-' || k)) AND any_value(best) IS DISTINCT FROM 'doc-' || k AS two FROM sg GROUP BY 1, 2, 3),
ba AS (SELECT *, kept AND (scope <> 'compare' OR (one AND two)) AS satisfied, CASE WHEN k % 6 < 4 THEN {_pk('k', BASES)} END AS basis, k % 3 = 0 AS manifest,
  CASE WHEN grounded = segments THEN 'grounded' WHEN grounded + part > 0 THEN 'partially-grounded' ELSE 'unresolved' END AS known FROM an),
fs AS (SELECT *, CASE WHEN k % 13 = 6 THEN 'unresolved' WHEN k % 11 = 5 THEN 'abstained' WHEN basis = 'external-source-verified' AND manifest THEN 'grounded' WHEN basis = 'mixed' AND manifest AND known = 'unresolved' THEN 'partially-grounded' ELSE known END AS state FROM ba)"""
_ISSUES = {
    "published-artifacts-gap": "k % 7 = 0", "source-escalation-required": "k % 5 = 0", "source-scope-missing-target-support": "scope LIKE 'source-scoped-%' AND NOT satisfied", "compare-source-coverage-missing": "scope = 'compare' AND NOT satisfied",
    "compare-source-approximate": "scope = 'compare' AND k % 3 = 1", "compare-source-unresolved": "scope = 'compare' AND k % 3 = 2", "trace-answer-state-mismatch": "state = 'grounded' AND coalesce(basis IN ('kb-grounded', 'mixed'), true) AND unresolved > 0",
    "mixed-support-unexplained": "basis = 'mixed' AND NOT manifest",
}
_BASIS = _pk("event_id", BASES)
ORACLES = {
    "reference_resolution": f"WITH {_RESOLVED} SELECT * EXCLUDE ids, array_to_string(CASE WHEN scope = 'compare' AND len(ids) > 0 THEN ids WHEN source_id IS NOT NULL AND (scope LIKE 'source-scoped-%' OR (source_match = 'exact' AND narrowing) OR (source_match = 'approximate' AND unit_match = 'exact')) THEN [source_id] ELSE [] END, ',') AS held_to FROM fi",
    "scoped_support": f"""WITH {_SCOPED} SELECT answer_id, scope, segments, satisfied, state,
  CASE WHEN state = 'abstained' OR (basis = 'mixed' AND (state IN ('grounded', 'partially-grounded') OR manifest)) OR (basis IN ('external-source-verified', 'model-knowledge') AND state IN ('grounded', 'partially-grounded')) OR (coalesce(basis, 'kb-grounded') = 'kb-grounded' AND state = 'grounded') THEN 'ready' ELSE 'degraded' END AS status,
  k % 2 = 0 AND NOT (state = 'abstained' OR coalesce(basis IN ('external-source-verified', 'model-knowledge') OR (basis = 'mixed' AND state = 'unresolved' AND manifest), false)) AS render, {_join(_ISSUES)} AS issues FROM fs""",
    "support_admission": f"""WITH {ranking._ALL_SQL}, rn AS (SELECT *, regexp_extract(source_id, '[0-9]+')::BIGINT AS n FROM scores), rs AS (SELECT *, {_pk('n', MODES)} AS scope FROM rn)
SELECT query_id, scope, count(*) AS results, count(*) FILTER (n % 10 > 0 AND (lexical_source + lexical_units + lexical_artifacts > 0 OR n % 9 >= 6) AND (scope = 'global' OR source_id = 'doc-' || (n - n % 3))) AS admitted FROM rs GROUP BY 1, 2""",
    "log_bindings": f"""WITH e AS (SELECT *, day(ts) % 8 AS turn, CASE WHEN event_id % 13 > 0 THEN 'run-' || (event_id % 60) END AS run_id FROM events),
r AS (SELECT 'run-' || (event_id % 60) AS run_id, arg_min(user_id, event_id) AS ru, arg_min(turn, event_id) AS rt, arg_min(event_type, event_id) <> 'view' AS front FROM e WHERE event_id % 60 < 50 GROUP BY 1),
t AS (SELECT conv_id AS user_id, turn, turn % 4 <> 3 AS canonical, 'run-' || ((conv_id + turn) % 60) AS committed, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'run-' || ((conv_id + turn) % 50) ELSE '' END AS active FROM conversations)
SELECT CASE WHEN e.run_id IS NULL THEN 'no-run' WHEN canonical IS NULL THEN 'no-turn' WHEN ru IS NULL THEN 'no-run-record' WHEN ru <> e.user_id OR rt <> e.turn THEN 'foreign-run' WHEN NOT front THEN 'run-origin' WHEN NOT canonical THEN 'turn-state'
  WHEN committed = e.run_id THEN 'after-commit' WHEN active <> '' AND active <> e.run_id THEN 'inactive-run' ELSE 'canonical' END AS binding, count(*) AS records, min(event_id) AS first FROM e LEFT JOIN r USING (run_id) LEFT JOIN t ON t.user_id = e.user_id AND t.turn = e.turn GROUP BY 1""",
    "commit_contracts": f"SELECT event_id, {_join({'answer-state': 'event_id % 5 = 4', 'support-basis': 'event_id % 6 = 4', 'support-manifest': f'{_BASIS} IN (' + chr(39) + 'external-source-verified' + chr(39) + ', ' + chr(39) + 'mixed' + chr(39) + ') AND event_id % 4 = 0', 'captured-at': 'event_id % 7 = 0'})} AS errors FROM events",
}
