"""Queries on overlays, derived sources and entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import freshness
from siltstone.operators.freshness import SLOTS
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_ARTIFACTS, DUCK_PREVIOUS, DUCK_SOURCES, DUCK_UNITS

CONTINUATIONS = ["follow-up", "constraint-update", "mixed", "fresh"]
HINTS = ["", "preference", "correction", "rumour", "stakeholder-context", "clarification"]
WORDS = ["this is incorrect", "please extend it", "", "additional rows", "look here"]


def _pick(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _candidates(spark, sf_dir):
    o = F.col("ordinal")
    required = F.slice(F.array(*map(F.lit, SLOTS)), (o % 4 + 1).cast("int"), 2)
    return corpus.units(spark, sf_dir).select("source_id", "unit_id", "ordinal", required.alias("required"), F.md5("source_id").alias("source_print"), F.md5("text").alias("unit_print"))


def _overlays(spark, sf_dir):
    """An overlay for three units in four; by number some are stale, name unknown slots, units or artifacts, or lack a field."""
    o, none = F.col("ordinal"), F.array().cast("array<string>")
    n = F.regexp_extract("source_id", "[0-9]+", 0).cast("long")
    return _candidates(spark, sf_dir).where("ordinal % 4 <> 0").select(
        "source_id", F.when(o % 9 == 4, F.concat("unit_id", F.lit("x"))).otherwise(F.col("unit_id")).alias("unit_id"), F.when(n % 7 > 0, F.col("source_print")).otherwise("").alias("of_source"),
        F.when(o % 5 != 2, F.col("unit_print")).otherwise("old").alias("of_unit"), F.when(o % 3 == 0, F.array(_pick(o, SLOTS), F.lit("no-such-slot"))).otherwise(none).alias("stated"),
        F.when(o % 3 == 1, F.concat(_pick(o * 2, SLOTS), F.lit(" seen"))).alias("labels"), (o % 8 == 5).alias("related"), F.when(o % 10 == 9, F.array(F.lit("chart-intent"))).otherwise(none).alias("hints"),
        F.when(o % 6 == 1, F.array(_pick(o % 4 + 1, SLOTS))).otherwise(none).alias("blocked"), F.when(n % 11 > 0, "semantic-overlay").otherwise("note").alias("kind"), _pick(o, ["hybrid", "agent-authored", "by-hand"]).alias("mode"),
        F.when(o % 7 > 0, "sync-hybrid").alias("origin"), F.when(o % 13 > 0, "r").otherwise(" ").alias("reason"), F.array(F.concat("unit_id", F.lit(":table-001"))).alias("artifact_ids"),
    )


def overlay_coverage(spark, sf_dir):
    found = freshness.overlay_coverage(_candidates(spark, sf_dir), _overlays(spark, sf_dir))
    return found.withColumns({c: F.array_join(F.array_sort(c), ",") for c in ("covered", "blocked", "remaining")})


def overlay_errors(spark, sf_dir):
    units = corpus.units(spark, sf_dir).select("source_id", "unit_id")
    return freshness.overlay_errors(_overlays(spark, sf_dir), units, corpus.artifacts(spark, sf_dir).select("source_id", "artifact_id"))


def entry_semantics(spark, sf_dir):
    k = F.col("conv_id") + F.col("turn")
    continuation = _pick(k, CONTINUATIONS)
    fields = freshness.semantics(_pick(k, HINTS), continuation, k % 5, {"durability": F.when(k % 8 == 3, "durable"), "prior": F.when(k % 9 == 4, "huge").when(k % 9 == 5, "medium")})
    said = F.concat_ws(" ", "text", _pick(k, WORDS))
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", *(c.alias(name) for name, c in fields.items()), freshness.relation(said, F.when(k % 7 == 2, 1).otherwise(0), continuation).alias("relation"))


def derived_changes(spark, sf_dir):
    id_of = lambda c: F.regexp_extract(c, "doc-([0-9]+)", 1).alias("source_id")
    now = corpus.current_inventory(spark, sf_dir).select(id_of("current_path"), "current_path", "fingerprint")
    before = corpus.previous_inventory(spark, sf_dir).select(id_of("current_path"), F.col("current_path").alias("old_path"), F.col("fingerprint").alias("old_print"), F.array(F.lit("first/place.txt")).alias("prior_paths"))
    return freshness.derived_changes(now, before).withColumn("prior_paths", F.array_join("prior_paths", ","))


def render_references(spark, sf_dir):
    page = lambda size: F.concat(F.lit("render-"), F.floor(F.col("ordinal") / size), F.lit(".png"))
    units = corpus.units(spark, sf_dir)
    found = freshness.render_references(units.select("source_id", page(10).alias("render")), units.where("ordinal % 5 = 0").select("source_id", page(3).alias("render")))
    return found.select("source_id", F.size("renders").cast("long").alias("n"), F.array_join("renders", ",").alias("renders"))


QUERIES = {f.__name__: f for f in (overlay_coverage, overlay_errors, entry_semantics, derived_changes, render_references)}

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_pk = lambda key, xs: f"{_list(xs)}[({key}) % {len(xs)} + 1]"
_S = _list(SLOTS)
_OVERLAYS = f"""{DUCK_SOURCES}, {DUCK_UNITS}, {DUCK_ARTIFACTS},
ca AS (SELECT source_id, unit_id, ordinal AS o, regexp_extract(source_id, '[0-9]+')::BIGINT AS n, {_S}[ordinal % 4 + 1:ordinal % 4 + 2] AS required, md5(text) AS up FROM units),
ov0 AS (SELECT source_id, unit_id || CASE WHEN o % 9 = 4 THEN 'x' ELSE '' END AS unit_id, unit_id AS u0, o, n, up, CASE WHEN o % 3 = 0 THEN [{_pk('o', SLOTS)}, 'no-such-slot'] ELSE [] END AS stated,
  CASE WHEN o % 3 = 1 THEN {_pk('o * 2', SLOTS)} || ' seen' ELSE '' END AS labels, CASE WHEN o % 6 = 1 THEN [{_pk('o % 4 + 1', SLOTS)}] ELSE [] END AS blocked FROM ca WHERE o % 4 <> 0),
ov AS (SELECT *, CASE WHEN o % 3 = 0 THEN [stated[1]] ELSE list_distinct(list_concat(list_filter({_S}, lambda s: contains(labels, s)), CASE WHEN o % 8 = 5 THEN ['cross-region-relation'] ELSE [] END, CASE WHEN o % 10 = 9 THEN ['chart-intent'] ELSE [] END)) END AS slots FROM ov0)"""
_kind = f"CASE WHEN {_pk('k', HINTS)} IN {tuple(freshness.KINDS)} THEN {_pk('k', HINTS)} WHEN k % 4 = 1 THEN 'constraint' WHEN k % 5 > 0 THEN 'operator-intent' ELSE 'working-note' END"
ORACLES = {
    "overlay_coverage": f"""WITH {_OVERLAYS}, f AS (SELECT ca.source_id, ca.unit_id, required, ov.o IS NOT NULL AS present, ov.o IS NOT NULL AND ca.n % 7 > 0 AND ca.o % 5 <> 2 AS fresh, slots, ov.blocked AS bl FROM ca LEFT JOIN ov USING (source_id, unit_id)),
g AS (SELECT *, CASE WHEN fresh THEN slots ELSE [] END AS c, CASE WHEN fresh THEN bl ELSE [] END AS b FROM f), h AS (SELECT *, list_filter(required, lambda s: NOT list_contains(c, s) AND NOT list_contains(b, s)) AS r FROM g)
SELECT source_id, unit_id, present, fresh, array_to_string(list_sort(c), ',') AS covered, array_to_string(list_sort(b), ',') AS blocked, array_to_string(list_sort(r), ',') AS remaining,
  CASE WHEN NOT fresh THEN 'candidate-prepared' WHEN len(r) = 0 THEN CASE WHEN len(c) > 0 THEN 'covered' ELSE 'blocked' END WHEN len(c) + len(b) > 0 THEN 'partially-covered' ELSE 'candidate-prepared' END AS status FROM h""",
    "overlay_errors": f"""WITH {_OVERLAYS} SELECT source_id, unit_id, error FROM (SELECT *, unnest(list_filter([CASE WHEN n % 11 = 0 THEN 'kind' END, CASE WHEN o % 3 = 2 THEN 'mode' END, CASE WHEN o % 7 = 0 THEN 'origin' END, CASE WHEN n % 7 = 0 THEN 'source print' END,
  CASE WHEN o % 13 = 0 THEN 'reason' END, CASE WHEN o % 3 = 0 THEN 'covered slot' END, CASE WHEN len(slots) = 0 AND len(blocked) = 0 THEN 'no slot' END], lambda x: x IS NOT NULL)) AS error FROM ov)
UNION ALL SELECT source_id, unit_id, 'unknown unit' FROM ov ANTI JOIN units USING (source_id, unit_id)
UNION ALL SELECT source_id, unit_id, 'unknown artifact ' || artifact_id FROM (SELECT source_id, unit_id, u0 || ':table-001' AS artifact_id FROM ov) ANTI JOIN artifacts USING (source_id, artifact_id)""",
    "entry_semantics": f"""WITH c AS (SELECT *, conv_id + turn AS k, lower(concat_ws(' ', text, {_pk('conv_id + turn', WORDS)})) AS said FROM conversations), e AS (SELECT *, {_kind} AS kind FROM c)
SELECT conv_id, turn, kind, CASE WHEN k % 8 = 3 OR kind IN {tuple(freshness.DURABLE)} THEN 'durable' WHEN kind IN {tuple(freshness.SITUATIONAL)} THEN 'situational' ELSE 'ephemeral' END AS durability, CASE WHEN kind = 'working-note' THEN 'inferred' ELSE 'confirmed' END AS uncertainty,
  CASE WHEN kind IN {tuple(freshness.DIRECT)} THEN 'direct-support' ELSE 'contextual-only' END AS policy, CASE WHEN k % 9 = 5 THEN 'medium' WHEN kind IN {tuple(freshness.HIGH)} THEN 'high' WHEN kind IN {tuple(freshness.MEDIUM)} THEN 'medium' ELSE 'low' END AS prior,
  CASE WHEN contains(said, 'correct') THEN 'corrects-source' WHEN k % 7 = 2 THEN 'visual-reference-for' WHEN k % 4 = 1 THEN 'constraint-for' WHEN k % 4 = 2 THEN 'clarifies-source' WHEN contains(said, 'extend') OR contains(said, 'additional') THEN 'extends-source' ELSE 'derived-from-turn' END AS relation FROM e""",
    "derived_changes": f"""WITH {DUCK_SOURCES}, {DUCK_PREVIOUS}, a AS (SELECT regexp_extract(current_path, 'doc-([0-9]+)', 1) AS source_id, * FROM now), b AS (SELECT regexp_extract(current_path, 'doc-([0-9]+)', 1) AS source_id, current_path AS op, fingerprint AS ofp FROM prev)
SELECT source_id, CASE WHEN op IS NULL THEN 'added' WHEN ofp <> fingerprint THEN 'modified' WHEN op = current_path THEN 'unchanged' ELSE 'moved-or-renamed' END AS change,
  concat_ws(',', CASE WHEN op <> current_path THEN 'path_changed' END, CASE WHEN ofp <> fingerprint THEN 'binary_changed' END) AS traits, concat_ws(',', CASE WHEN op IS NOT NULL THEN 'first/place.txt' END, CASE WHEN op <> current_path THEN op END) AS prior_paths FROM a LEFT JOIN b USING (source_id)""",
    "render_references": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, r AS (SELECT source_id, 'render-' || (ordinal // 10) || '.png' AS render FROM units UNION SELECT source_id, 'render-' || (ordinal // 3) || '.png' FROM units WHERE ordinal % 5 = 0)
SELECT source_id, count(*) AS n, string_agg(render, ',' ORDER BY render) AS renders FROM r GROUP BY 1""",
}
