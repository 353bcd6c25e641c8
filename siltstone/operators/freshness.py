"""Whether overlays and derived sources still fit their evidence, which slots they cover, and what interaction entries mean by default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.predicates import has_any

#: Slots of overlays, kinds of memory, and what a kind stands for where nothing is stated.
SLOTS = ["page-summary", "diagram-summary", "flow-steps", "ui-screen-summary", "chart-intent", "table-intent", "manual-step-sequence", "architecture-relationship-hints", "cross-region-relation"]
KINDS = ["constraint", "preference", "stakeholder-context", "political-context", "clarification", "correction", "operator-intent", "working-note"]
DURABLE, SITUATIONAL = ["constraint", "preference", "stakeholder-context", "political-context"], ["clarification", "correction", "operator-intent"]
DIRECT = ["constraint", "preference", "clarification", "correction"]
HIGH, MEDIUM = ["constraint", "preference", "correction"], ["clarification", "stakeholder-context", "political-context"]


def _known(slots: Column) -> Column:
    return F.array_distinct(F.array_intersect(F.coalesce(slots, F.array().cast("array<string>")), F.array(*map(F.lit, SLOTS))))


def covered_slots(stated: Column, labels: Column, related: Column, hints: Column) -> Column:
    """The known slots that an overlay states; if it states none, those that its labels name, that of its relations, and those of its reason. Nulls state nothing."""
    own = _known(stated)
    text = F.coalesce(labels, F.lit(""))
    named = F.array_compact(F.array(*(F.when(text.contains(s), F.lit(s)) for s in SLOTS), F.when(related, F.lit(SLOTS[-1]))))
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.concat(named, _known(hints))))


def overlay_coverage(candidates: DataFrame, overlays: DataFrame) -> DataFrame:
    """Every candidate (source_id, unit_id, required, source_print, unit_print) with its overlay's coverage.

    An overlay counts only while both of its prints are those of the evidence. ``overlays``: source_id, unit_id, of_source, of_unit, stated, labels, related, hints, blocked; one a unit.
    """
    none = F.array().cast("array<string>")
    rows = candidates.join(overlays.withColumn("present", F.lit(True)), ["source_id", "unit_id"], "left")
    present = F.coalesce("present", F.lit(False))
    fresh = present & F.coalesce((F.col("of_source") == F.col("source_print")) & (F.col("of_unit") == F.col("unit_print")), F.lit(False))
    rows = rows.withColumns({"present": present, "fresh": fresh})
    rows = rows.withColumns({
        "covered": F.when(F.col("fresh"), covered_slots(F.col("stated"), F.col("labels"), F.coalesce("related", F.lit(False)), F.col("hints"))).otherwise(none),
        "blocked": F.when(F.col("fresh"), _known(F.col("blocked"))).otherwise(none),
    })
    rows = rows.withColumn("remaining", F.array_except(F.array_except("required", "covered"), "blocked"))
    some = (F.size("covered") > 0) | (F.size("blocked") > 0)
    done = F.when(F.size("covered") > 0, "covered").otherwise("blocked")
    status = F.when(~F.col("fresh"), "candidate-prepared").when(F.size("remaining") == 0, done).when(some, "partially-covered").otherwise("candidate-prepared")
    return rows.select("source_id", "unit_id", "present", "fresh", "covered", "blocked", "remaining", status.alias("status"))


def overlay_errors(overlays: DataFrame, units: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(source_id, unit_id, error) of overlays that break their contract. ``overlays`` as above, with kind, mode, origin, reason and artifact_ids."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    other = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    slots = covered_slots(F.col("stated"), F.col("labels"), F.coalesce("related", F.lit(False)), F.col("hints"))
    strange = lambda c: F.size(F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, SLOTS)))) > 0
    rules = {
        "kind": other("kind", ["semantic-overlay"]), "mode": other("mode", ["agent-authored", "hybrid"]), "origin": other("origin", ["sync-hybrid", "ask-hybrid"]), "source print": empty("of_source"), "unit print": empty("of_unit"),
        "reason": empty("reason"), "covered slot": strange("stated"), "blocked slot": strange("blocked"), "no slot": (F.size(slots) == 0) & (F.size(_known(F.col("blocked"))) == 0),
    }
    broken = overlays.select("source_id", "unit_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("error"))
    unknown = overlays.join(units, ["source_id", "unit_id"], "left_anti").select("source_id", "unit_id", F.lit("unknown unit").alias("error"))
    named = overlays.select("source_id", "unit_id", F.explode(F.array_distinct("artifact_ids")).alias("artifact_id"))
    lost = named.join(artifacts, ["source_id", "artifact_id"], "left_anti").select("source_id", "unit_id", F.concat(F.lit("unknown artifact "), "artifact_id").alias("error"))
    return broken.union(unknown).union(lost)


def semantics(hint: Column, continuation: Column, commands: Column, stated: dict[str, Column]) -> dict[str, Column]:
    """The five fields of an entry's meaning. A field that is stated with a known value stands; the rest follow from the kind, and the kind from the turn."""
    kind = F.coalesce(F.when(hint.isin(*KINDS), hint), F.when(continuation == "constraint-update", "constraint"), F.when(commands > 0, "operator-intent"), F.lit("working-note"))
    by_kind = {
        "durability": (F.when(kind.isin(*DURABLE), "durable").when(kind.isin(*SITUATIONAL), "situational").otherwise("ephemeral"), ["durable", "situational", "ephemeral"]),
        "uncertainty": (F.when(kind == "working-note", "inferred").otherwise("confirmed"), ["confirmed", "stated-uncertain", "inferred"]),
        "policy": (F.when(kind.isin(*DIRECT), "direct-support").otherwise("contextual-only"), ["direct-support", "contextual-only"]),
        "prior": (F.when(kind.isin(*HIGH), "high").when(kind.isin(*MEDIUM), "medium").otherwise("low"), ["high", "medium", "low"]),
    }
    said = lambda name, values: F.when(stated[name].isin(*values), stated[name]) if name in stated else F.lit(None).cast("string")
    return {"kind": kind} | {name: F.coalesce(said(name, values), default) for name, (default, values) in by_kind.items()}


def relation(text: Column, attachments: Column, continuation: Column) -> Column:
    """How an entry relates to the source it names: the first rule that holds."""
    rules = {
        "corrects-source": has_any(F.coalesce(text, F.lit("")), ["correct", "incorrect"]), "visual-reference-for": attachments > 0, "constraint-for": continuation == "constraint-update", "clarifies-source": continuation == "mixed",
        "extends-source": has_any(F.coalesce(text, F.lit("")), ["extend", "additional"]),
    }
    return F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items()), F.lit("derived-from-turn"))


def derived_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_id, change, traits, prior_paths) of derived sources, which keep their id: the content decides, then the path.

    ``now``: source_id, current_path, fingerprint. ``before``: source_id, old_path, old_print, prior_paths; paths that a source had before stay, each once.
    """
    rows = now.join(before.withColumn("known", F.lit(True)), "source_id", "left")
    moved, other = F.coalesce(F.col("old_path") != F.col("current_path"), F.lit(False)), F.coalesce(F.col("old_print") != F.col("fingerprint"), F.lit(False))
    same = F.coalesce(F.col("old_print") == F.col("fingerprint"), F.lit(False))
    change = F.when(F.col("known").isNull(), "added").when(~same, "modified").when(F.coalesce(F.col("old_path") == F.col("current_path"), F.lit(False)), "unchanged").otherwise("moved-or-renamed")
    traits = F.array_join(F.array_compact(F.array(F.when(moved, "path_changed"), F.when(other, "binary_changed"))), ",")
    prior = F.array_distinct(F.concat(F.coalesce("prior_paths", F.array().cast("array<string>")), F.when(moved, F.array("old_path")).otherwise(F.array().cast("array<string>"))))
    return rows.select("source_id", change.alias("change"), traits.alias("traits"), prior.alias("prior_paths"))


def render_references(*parts: DataFrame) -> DataFrame:
    """(source_id, renders): the renders that any part of a source refers to, each once, sorted."""
    rows = reduce(DataFrame.unionByName, (p.select("source_id", "render") for p in parts)).where("render <> ''").distinct()
    return rows.groupBy("source_id").agg(F.array_sort(F.collect_list("render")).alias("renders"))  # of one source
