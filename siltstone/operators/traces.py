"""States of traced answers: scope, direct support, what may count as support, final states and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPED = ("source-scoped-hard", "source-scoped-soft")


def scope_mode(compare: Column, hard: Column, target: Column, narrowing: Column, match: Column) -> Column:
    """How far a question binds its answer to sources: to several, to one strictly, to one softly, or not."""
    soft = target.isNotNull() & narrowing & match.isin("exact", "approximate")
    return F.when(compare, "compare").when(hard, SCOPED[0]).when(soft, SCOPED[1]).otherwise("global")


def direct_score(lexical: Column, reference: Column) -> Column:
    """Words that match, else a strong reference bonus (6 or more), else nothing."""
    return F.when(lexical > 0, lexical).when(reference >= 6.0, reference).otherwise(0.0)


def admissible(family: Column, score: Column, mode: Column, source: Column, target: Column, compared: Column) -> Column:
    """Whether a result may be canonical support: of the corpus, with a direct score, and one that the scope names."""
    named = F.when(mode.isin(*SCOPED) & target.isNotNull(), source == target).when((mode == "compare") & (F.size(compared) > 0), F.array_contains(compared, source)).otherwise(True)
    return (family == "corpus") & (score > 0) & named


def scope_satisfied(mode: Column, status: Column, target: Column, compared: Column, supporting: Column) -> Column:
    """Whether the sources under a segment are those that the scope asks for; abstaining always satisfies."""
    several = F.when(F.size(compared) > 0, F.arrays_overlap(supporting, compared)).otherwise(F.size(F.array_distinct(supporting)) >= 2)
    one = F.coalesce(F.array_contains(supporting, target), F.lit(False))
    return F.when(~mode.isin(*SCOPED, "compare") | (status == "abstained"), True).when(mode == "compare", several).otherwise(one)


def final_state(declared: Column, abstained: Column, basis: Column, manifest: Column, state: Column) -> Column:
    """What was declared, an abstention in words, grounded by a verified outside source, mixed support, or the state by the corpus."""
    held = manifest.isNotNull() & (manifest != "")
    outside = F.when((basis == "external-source-verified") & held, "grounded").when((basis == "mixed") & held & (state == "unresolved"), "partially-grounded").otherwise(state)
    return F.when(declared.isNotNull(), declared).when(abstained, "abstained").otherwise(outside)


def trace_status(state: Column, basis: Column, manifest: Column) -> Column:
    held = F.coalesce(manifest != "", F.lit(False))
    some = state.isin("grounded", "partially-grounded")
    ready = F.when(state == "abstained", True).when(basis == "mixed", some | held).when(basis.isin("external-source-verified", "model-knowledge"), some).otherwise(state == "grounded")
    return F.when(ready, "ready").otherwise("degraded")


def render_required(required: Column, basis: Column, state: Column, manifest: Column) -> Column:
    held = F.coalesce(manifest != "", F.lit(False))
    free = (state == "abstained") | F.coalesce(basis.isin("external-source-verified", "model-knowledge"), F.lit(False)) | F.coalesce((basis == "mixed") & (state == "unresolved") & held, F.lit(False))
    return required & ~free


def issues(row: dict[str, Column]) -> Column:
    """Codes of what stands against a trace, each once, joined by commas: gaps, scope, comparison, state, mixed support."""
    mode, basis = row["mode"], row["basis"]
    unmet = ~row["satisfied"]
    codes = {
        "published-artifacts-gap": row["sufficient"] == F.lit(False), "source-escalation-required": row["escalation"] == F.lit(True),
        "source-scope-missing-target-support": mode.isin(*SCOPED) & unmet, "compare-source-coverage-missing": (mode == "compare") & unmet,
        "compare-source-approximate": (mode == "compare") & (row["compare_status"] == "approximate"), "compare-source-unresolved": (mode == "compare") & (row["compare_status"] == "unresolved"),
        "trace-answer-state-mismatch": (row["state"] == "grounded") & (basis.isNull() | basis.isin("kb-grounded", "mixed")) & (row["unresolved"] > 0),
        "mixed-support-unexplained": (basis == "mixed") & ~F.coalesce(row["manifest"] != "", F.lit(False)) & ~row["explainable"],
    }
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items()))), ",")


def ordered_ids(rows: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """(key, columns): the distinct non-empty values of each column, first come first, joined by commas.

    Values are reduced to their first place before they are collected, so a row holds each value once.
    """
    out = rows.select(key).distinct()
    for c in columns:
        first = rows.where((F.col(c) != "") & F.col(c).isNotNull()).groupBy(key, c).agg(F.min(place).alias("_at"))
        joined = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", F.col(c).alias("_v")))).getField("_v"), ",").alias(c))
        out = out.join(joined, key, "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out
