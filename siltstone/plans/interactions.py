"""Queries on conversations, references, layout and the queue of closer looks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens
from siltstone.operators import freshness, hybrid, interactions, layout, references
from siltstone.plans.freshness import CONTINUATIONS, _pick
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS


def _log(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations")


def turn_reconstruction(spark, sf_dir):
    return interactions.turns(_log(spark, sf_dir))


def interaction_dedup(spark, sf_dir):
    """Rows of the same role and text, one of each."""
    log = _log(spark, sf_dir).withColumn("promoted", F.col("turn") % 3 == 0)
    kept = interactions.without_duplicates(log, [F.col("role"), F.coalesce("text", F.lit(""))], "promoted", [F.col("conv_id"), F.col("turn")])
    return kept.select("conv_id", "turn", "signature", "copies", "any_promoted")


def memory_semantics_fold(spark, sf_dir):
    """Entries of users, with what they mean by default; some name a kind that is unknown."""
    k = F.col("conv_id") + F.col("turn") * 7
    fields = freshness.semantics(_pick(k, [*interactions.KINDS, ""]), _pick(k, CONTINUATIONS), F.char_length(F.coalesce("text", F.lit(""))) % 3, {"durability": F.when(k % 8 == 3, "durable"), "uncertainty": F.when(F.contains("text", F.lit("?")), "stated-uncertain")})
    kind = F.when(k % 10 == 9, "rumour").otherwise(fields.pop("kind"))
    return interactions.folded_memories(_log(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", kind.alias("kind"), *(c.alias(name) for name, c in fields.items())))


def overlay_union(spark, sf_dir):
    """Units with those of conversations laid over documents of the same number, counted by origin of the row."""
    base = corpus.units(spark, sf_dir).select("source_id", "unit_id", F.md5("text").alias("digest"), F.lit("corpus").alias("family"))
    over = _log(spark, sf_dir).select(F.concat(F.lit("doc-"), "conv_id").alias("source_id"), F.format_string("line-%04d", F.col("turn").cast("int") + 1).alias("unit_id"), F.md5("text").alias("digest"), F.lit("interaction").alias("family"))
    return interactions.overlaid(base, over, ["source_id", "unit_id"])


def _questions(spark, sf_dir):
    """Benchmark items as questions that name a document's path or line."""
    docs = corpus.sources(spark, sf_dir).select("doc_id", F.col("doc_id").alias("n"), "source_id", "title", "current_path")
    last = docs.agg((F.max("doc_id") + 1).alias("last"))
    items = corpus.table(spark, sf_dir, "benchmark").join(F.broadcast(last)).withColumn("n", F.col("item_id") * 7919 % F.col("last"))  # one row
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("what does line "), (F.col("item_id") % 9 + 1).cast("string"), F.lit(" of "), "current_path", F.lit(" say"))).otherwise(F.concat(F.lit("Summarise: "), "title"))
    return items.select("item_id", "n").join(docs, "n").select(F.concat(F.lit("q-"), "item_id").alias("question_id"), "source_id", text.alias("text"))


def _matches(spark, sf_dir):
    docs = corpus.sources(spark, sf_dir)
    aliases = docs.select("source_id", F.col("current_path").alias("alias"), F.lit("path").alias("basis")).union(docs.select("source_id", F.col("title").alias("alias"), F.lit("title").alias("basis")))
    return references.alias_matches(_questions(spark, sf_dir), aliases)


def alias_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("score", F.round("score", 6))


def clear_winner(spark, sf_dir):
    return references.winners(_matches(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("score", "runner_up")})


def locator_match(spark, sf_dir):
    units = corpus.units(spark, sf_dir).select("source_id", "unit_id", F.col("ordinal").alias("line_start"), F.col("ordinal").alias("line_end"))
    return references.located_units(_questions(spark, sf_dir), units)


def column_profile(spark, sf_dir):
    """Suppliers fill sheets with quantities, taxes, days of shipping and states of their items; some cells are empty."""
    number = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    of = {"quantity": F.when(F.col("l_linenumber") % 5 > 0, number("l_quantity")).otherwise(""), "tax": number("l_tax"), "Shipping date": F.date_format("l_shipdate", "yyyy-MM-dd"), "state": F.concat("l_returnflag", "l_linestatus")}
    columns = F.array(*(F.struct(F.lit(k).alias("column"), v.alias("value")) for k, v in of.items()))
    cells = corpus.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("sheet"), F.col("l_partkey").alias("row"), "l_orderkey", "l_linenumber", F.explode(columns).alias("c")).select("sheet", "c.column", "c.value", "l_orderkey", "l_linenumber", "row")
    return layout.column_profile(cells, "sheet", "column", ["l_orderkey", "l_linenumber", "row", "value"]).withColumn("mean", F.round("mean", 6))


def _boxes(spark, sf_dir, caption: bool):
    """Line items laid out on pages: every fourth is a caption."""
    items = corpus.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    x, y = (k * 37 % 400).cast("double"), (k * 53 % 700).cast("double")
    rows = items.select(F.floor(k / 16).alias("page"), k.alias("id"), x.alias("x0"), y.alias("y0"), (x + (k * 11 % 150) + 20).alias("x1"), (y + 12 + (k * 7 % 60)).alias("y1"))
    return rows.where((F.col("id") % 4 == 0) if caption else (F.col("id") % 4 != 0))


def caption_nearest(spark, sf_dir):
    return layout.nearest_captions(_boxes(spark, sf_dir, True), _boxes(spark, sf_dir, False))


def continuation_links(spark, sf_dir):
    parts = corpus.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("doc"), F.floor(F.col("l_orderkey") / 100).alias("page"), F.col("l_returnflag").alias("kind"))
    return layout.continuations(parts, "doc", "page", ["kind"])


def _queue(spark, sf_dir):
    units = corpus.units(spark, sf_dir).withColumn("source_path", F.concat(F.lit("units/"), "source_id"))
    n = F.length("text") % 7
    state = F.when(n < 2, "covered").when(n == 2, "stale").when(n == 3, "blocked").otherwise("pending")
    return units.select("source_id", "source_path", "unit_id", F.length("text").cast("long").alias("priority"), state.alias("state"))


def lane_batch(spark, sf_dir):
    return hybrid.batch(_queue(spark, sf_dir).where("state = 'pending'"))


def hybrid_coverage(spark, sf_dir):
    return hybrid.coverage(_queue(spark, sf_dir), "source_id")


def channel_plan(spark, sf_dir):
    """Conversations ask for channels by their length, their rows offer some by role."""
    log = _log(spark, sf_dir)
    channels = F.array(*map(F.lit, hybrid.CHANNELS))
    wanted = log.groupBy(F.col("conv_id").alias("query_id")).agg(F.count("*").alias("n")).select("query_id", F.slice(channels, 1, (F.col("n") % 4 + 1).cast("int")).alias("channels"))
    offered = log.select(F.col("conv_id").alias("query_id"), F.when(F.col("role") == "user", "text").when(F.col("turn") % 4 == 1, "structure").otherwise("render").alias("channel"))
    return hybrid.channel_plan(wanted, offered)


QUERIES = {
    f.__name__: f
    for f in (turn_reconstruction, interaction_dedup, memory_semantics_fold, overlay_union, alias_match, clear_winner, locator_match, column_profile, caption_nearest, continuation_links, lane_batch, hybrid_coverage, channel_plan)
}

_Q = f"""{DUCK_SOURCES}, qs AS (SELECT 'q-' || item_id AS question_id, source_id, CASE WHEN item_id % 2 = 0 THEN 'what does line ' || (item_id % 9 + 1) || ' of ' || current_path || ' say' ELSE 'Summarise: ' || title END AS text FROM benchmark JOIN sources ON doc_id = item_id * 7919 % (SELECT max(doc_id) + 1 FROM documents))"""
#: Alias matches of ``qs`` (question_id, text) over ``sources``.
MATCHED = f""", ak AS (SELECT source_id, current_path AS alias, 'path' AS basis FROM sources UNION ALL SELECT source_id, title, 'title' FROM sources),
kn AS (SELECT source_id, alias, basis, list_distinct({duck_tokens('alias')}) AS w FROM ak), kw AS (SELECT source_id, alias, basis, len(w) AS n, unnest(w) AS word FROM kn),
aw AS (SELECT question_id, unnest(list_distinct({duck_tokens('text')})) AS word FROM qs),
hi AS (SELECT question_id, source_id, basis, alias, n, count(*) AS met FROM kw JOIN aw USING (word) GROUP BY ALL),
ha AS (SELECT *, CASE WHEN basis = 'path' THEN 90 ELSE 72 END::DOUBLE AS weight, array_to_string({duck_tokens('alias')}, ' ') AS phrase, met / n AS share FROM hi),
hx AS (SELECT ha.*, contains(' ' || array_to_string({duck_tokens('qs.text')}, ' ') || ' ', ' ' || phrase || ' ')
  AND NOT (n = 1 AND (length(phrase) <= 1 OR (length(phrase) = 2 AND regexp_full_match(phrase, '[a-z]+') AND NOT regexp_matches(alias, '[/.]')))) AS exact FROM ha JOIN qs USING (question_id)),
hs AS (SELECT *, CASE WHEN exact THEN weight WHEN n >= 2 AND share >= 0.5 THEN round(weight * share, 3) END AS score FROM hx),
ma AS (SELECT question_id, source_id, basis, max(score) AS score, arg_max(exact, score * 2 + exact::INT) AS exact FROM hs WHERE score IS NOT NULL GROUP BY ALL)"""
_M = _Q + MATCHED
_U = f"""{DUCK_SOURCES}, {DUCK_UNITS}, qu AS (SELECT source_id, unit_id, length(text)::BIGINT AS priority, CASE WHEN length(text) % 7 < 2 THEN 'covered' WHEN length(text) % 7 = 2 THEN 'stale' WHEN length(text) % 7 = 3 THEN 'blocked' ELSE 'pending' END AS state FROM units)"""
ORACLES = {
    "turn_reconstruction": """WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
h AS (SELECT conv_id, turn_no::BIGINT AS turn_no, min(turn) AS opened, max(turn) AS closed, count(*) FILTER (role = 'assistant') AS answers, sum(length(text))::BIGINT AS n_chars FROM n GROUP BY 1, 2)
SELECT *, CASE WHEN turn_no = 0 THEN 'preamble' WHEN answers > 0 THEN 'completed' WHEN turn_no = max(turn_no) OVER (PARTITION BY conv_id) THEN 'open' ELSE 'superseded' END AS closure FROM h""",
    "interaction_dedup": """WITH k AS (SELECT *, sha256(role || '|' || coalesce(text, '')) AS signature, turn % 3 = 0 AS promoted FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY conv_id, turn) AS place, count(*) OVER (PARTITION BY signature) AS copies, bool_or(promoted) OVER (PARTITION BY signature) AS any_promoted FROM k)
SELECT conv_id, turn, signature, copies, any_promoted FROM r WHERE place = 1""",
    "memory_semantics_fold": f"""WITH c AS (SELECT *, conv_id + turn * 7 AS k FROM conversations WHERE role = 'user'),
d AS (SELECT *, CASE WHEN k % 9 < 8 THEN {[*interactions.KINDS]}[k % 9 + 1] WHEN k % 4 = 1 THEN 'constraint' WHEN length(coalesce(text, '')) % 3 > 0 THEN 'operator-intent' ELSE 'working-note' END AS own FROM c),
e AS (SELECT *, CASE WHEN k % 10 = 9 THEN 'rumour' ELSE own END AS kind, CASE WHEN k % 8 = 3 OR own IN {tuple(freshness.DURABLE)} THEN 'durable' WHEN own IN {tuple(freshness.SITUATIONAL)} THEN 'situational' ELSE 'ephemeral' END AS durability,
  CASE WHEN contains(text, '?') THEN 'stated-uncertain' WHEN own = 'working-note' THEN 'inferred' ELSE 'confirmed' END AS uncertainty, CASE WHEN own IN {tuple(freshness.DIRECT)} THEN 'direct-support' ELSE 'contextual-only' END AS policy,
  CASE WHEN own IN {tuple(freshness.HIGH)} THEN 'high' WHEN own IN {tuple(freshness.MEDIUM)} THEN 'medium' ELSE 'low' END AS prior FROM d),
b AS (SELECT conv_id, arg_min(struct_pack(kind, durability, policy, prior), {{'r': list_position({[*interactions.KINDS]}, kind), 't': turn}}) AS best FROM e WHERE list_position({[*interactions.KINDS]}, kind) < 8 GROUP BY conv_id)
SELECT conv_id, count(*) AS entries, coalesce(any_value(best.kind), 'working-note') AS kind, coalesce(any_value(best.durability), 'ephemeral') AS durability,
  CASE WHEN bool_or(uncertainty = 'stated-uncertain') THEN 'stated-uncertain' WHEN bool_or(uncertainty = 'inferred') THEN 'inferred' ELSE 'confirmed' END AS uncertainty, coalesce(any_value(best.policy), 'contextual-only') AS policy, coalesce(any_value(best.prior), 'low') AS prior,
  sha256(string_agg(sha256(turn || '|' || kind), '' ORDER BY turn)) AS digest FROM e LEFT JOIN b USING (conv_id) GROUP BY conv_id""",
    "overlay_union": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, o AS (SELECT 'doc-' || conv_id AS source_id, 'line-' || lpad((turn + 1)::VARCHAR, 4, '0') AS unit_id, md5(text) AS digest, 'interaction' AS family FROM conversations)
SELECT source_id, unit_id, md5(text) AS digest, 'corpus' AS family FROM units ANTI JOIN o USING (source_id, unit_id) UNION ALL SELECT * FROM o""",
    "alias_match": f"WITH {_M} SELECT question_id, source_id, basis, exact, round(score, 6) AS score FROM ma",
    "clear_winner": f"""WITH {_M}, b AS (SELECT question_id, source_id, max(score) AS score, arg_max(exact, score * 2 + exact::INT) AS exact FROM ma GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS runner_up, lead(exact) OVER w AS other FROM b WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, exact DESC, source_id))
SELECT question_id, source_id, round(score, 6) AS score, round(runner_up, 6) AS runner_up, CASE WHEN (runner_up IS NULL AND score > 0) OR (score > runner_up AND ((exact AND NOT other) OR score - runner_up >= 8 OR score >= 1.25 * runner_up)) THEN 'exact' ELSE 'ambiguous' END AS status FROM r WHERE place = 1""",
    "locator_match": rf"""WITH {_Q}, {DUCK_UNITS}, a AS (SELECT question_id, source_id, try_cast(nullif(regexp_extract(lower(text), '\blines?[ #-]*0*([0-9]+)', 1), '') AS BIGINT) AS line FROM qs)
SELECT question_id, source_id, unit_id FROM a JOIN units USING (source_id) WHERE line = ordinal""",
    "column_profile": """WITH c AS (SELECT l_suppkey % 50 AS sheet, l_orderkey, l_linenumber, l_partkey, unnest([{'c': 'quantity', 'v': CASE WHEN l_linenumber % 5 > 0 THEN l_quantity::DECIMAL(12,2)::VARCHAR ELSE '' END}, {'c': 'tax', 'v': l_tax::DECIMAL(12,2)::VARCHAR},
  {'c': 'Shipping date', 'v': strftime(l_shipdate, '%Y-%m-%d')}, {'c': 'state', 'v': l_returnflag || l_linestatus}]) AS x FROM lineitem),
r AS (SELECT sheet, x.c AS "column", x.v AS value, row_number() OVER (PARTITION BY sheet, x.c ORDER BY l_orderkey, l_linenumber, l_partkey, x.v) AS n FROM c),
p AS (SELECT sheet, "column", count(*) AS n_values, count(try_cast(value AS DOUBLE)) AS n_numbers, min(try_cast(value AS DOUBLE)) AS least, max(try_cast(value AS DOUBLE)) AS most, sum(try_cast(value AS DECIMAL(24,4)))::DOUBLE / count(try_cast(value AS DOUBLE)) AS mean FROM r WHERE n <= 25 AND value <> '' GROUP BY 1, 2)
SELECT sheet, "column", n_values, n_numbers, least, most, round(mean, 6) AS mean, CASE WHEN n_numbers > 0 THEN 'numeric' WHEN contains(lower("column"), 'date') THEN 'time-axis' ELSE 'text' END AS kind,
  coalesce(n_numbers > 1 AND mean <> 0 AND (most > 1.8 * mean OR least < 0.2 * mean), false) AS odd FROM p""",
    "caption_nearest": """WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem), b AS (SELECT id // 16 AS page, id, (id * 37 % 400)::DOUBLE AS x0, (id * 53 % 700)::DOUBLE AS y0 FROM k),
x AS (SELECT *, x0 + (id * 11 % 150) + 20 AS x1, y0 + 12 + (id * 7 % 60) AS y1 FROM b),
n AS (SELECT c.page, c.id AS caption_id, f.id AS figure_id, least(abs(f.y0 - c.y1), abs(c.y0 - f.y1))::DOUBLE AS gap FROM x c JOIN x f ON c.page = f.page AND c.id % 4 = 0 AND f.id % 4 <> 0 AND least(c.x1, f.x1) - greatest(c.x0, f.x0) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY page, caption_id ORDER BY gap, figure_id) AS place FROM n WHERE gap <= 88) SELECT page, caption_id, figure_id, gap, gap <= 36 AS sure FROM o WHERE place = 1""",
    "continuation_links": """WITH d AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey // 100 AS page, l_returnflag AS kind FROM lineitem), r AS (SELECT *, page - row_number() OVER (PARTITION BY doc, kind ORDER BY page) AS run FROM d)
SELECT doc, kind, min(page) AS first_page, count(*) AS pages FROM r GROUP BY doc, kind, run HAVING count(*) > 1""",
    "lane_batch": f"""WITH {_U}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY priority DESC, unit_id) AS place FROM qu WHERE state = 'pending') WHERE place <= 3),
f AS (SELECT source_id, max(priority) AS best, count(*) AS remaining, least(count(*), 3) AS n FROM qu WHERE state = 'pending' GROUP BY 1 ORDER BY best DESC, remaining DESC, source_id LIMIT 4),
g AS (SELECT *, row_number() OVER (ORDER BY best DESC, remaining DESC, source_id) AS source_place, sum(n) OVER (ORDER BY best DESC, remaining DESC, source_id ROWS UNBOUNDED PRECEDING) AS so_far FROM f)
SELECT source_id, unit_id, source_place::INT AS source_place, place::INT AS place FROM s JOIN g USING (source_id) WHERE so_far <= 12""",
    "hybrid_coverage": f"""WITH {_U}, c AS (SELECT source_id, count(*) AS units, count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'blocked') AS blocked, count(*) FILTER (state NOT IN ('covered', 'blocked')) AS remaining FROM qu GROUP BY 1)
SELECT *, CASE WHEN remaining = 0 AND blocked = 0 THEN 'covered' WHEN covered = 0 AND blocked = 0 THEN 'candidate-prepared' ELSE 'partially-covered' END AS mode FROM c""",
    "channel_plan": """WITH w AS (SELECT conv_id AS query_id, ['text', 'render', 'structure', 'notes', 'media'][1 : count(*) % 4 + 1] AS channels, list_distinct(list(CASE WHEN role = 'user' THEN 'text' WHEN turn % 4 = 1 THEN 'structure' ELSE 'render' END)) AS got FROM conversations GROUP BY conv_id),
m AS (SELECT *, list_sort(list_filter(channels, lambda x: NOT list_contains(got, x))) AS missing FROM w)
SELECT query_id, len(channels)::BIGINT AS wanted, (len(channels) - len(missing))::BIGINT AS matched, array_to_string(missing, ',') AS missing, len(missing) = 0 AS sufficient FROM m""",
}
