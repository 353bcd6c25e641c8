"""Captured conversations: turns from event logs, duplicates, memories and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of memories, most important first.
KINDS = ["constraint", "preference", "correction", "clarification", "stakeholder-context", "political-context", "operator-intent", "working-note"]


def turns(log: DataFrame) -> DataFrame:
    """(conv_id, turn_no, opened, closed, answers, n_chars, closure): a user row opens a turn that holds the rows up to the next one.

    Rows before the first user row belong to turn 0, which no user opened. ``log``: conv_id, turn (order), role, text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    number = F.sum((F.col("role") == "user").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = log.withColumn("turn_no", number).groupBy("conv_id", "turn_no").agg(
        F.min("turn").alias("opened"), F.max("turn").alias("closed"), F.count_if(F.col("role") == "assistant").alias("answers"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"), F.max("turn_no").alias("_n"),
    ).drop("_n")
    last = F.max("turn_no").over(Window.partitionBy("conv_id")) == F.col("turn_no")
    closure = F.when(F.col("turn_no") == 0, "preamble").when(F.col("answers") > 0, "completed").when(last, "open").otherwise("superseded")
    return held.withColumn("closure", closure)


def without_duplicates(entries: DataFrame, signature: list[Column], promoted: str, order: list[Column]) -> DataFrame:
    """One entry for each signature, the first in ``order``; it is promoted if any of them was."""
    keyed = entries.withColumn("signature", F.sha2(F.concat_ws("|", *signature), 256))
    one = keyed.groupBy("signature").agg(F.min_by(F.struct(*(F.col(c) for c in entries.columns)), F.struct(*order)).alias("_first"), F.count("*").alias("copies"), F.bool_or(promoted).alias("any_promoted"))
    return one.select("_first.*", "signature", "copies", "any_promoted")


def folded_memories(entries: DataFrame) -> DataFrame:
    """(conv_id, entries, kind, durability, uncertainty, policy, prior, digest) of ``entries`` (conv_id, turn, kind, durability, uncertainty, policy, prior).

    The most important kind of a conversation counts, a working note if there is none of another known kind. The entries that were more important than all before them say the rest, the last one
    that says something. What one entry states as uncertain is uncertain, else inferred if one is. The digest is taken of the turns and kinds in order. A conversation is one window.
    """
    known = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair))
    rank = F.coalesce(F.try_element_at(known, F.coalesce("kind", F.lit("working-note"))), F.lit(99))
    before = F.min("rank").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    marked = entries.withColumn("rank", rank).withColumn("leads", F.col("rank") < F.least(F.lit(len(KINDS) - 1), F.coalesce(before, F.lit(99))))
    said = lambda c, default: F.coalesce(F.max_by(c, F.when(F.col("leads") & (F.coalesce(c, F.lit("")) != ""), F.col("turn"))), F.lit(default)).alias(c)
    one = lambda value: F.bool_or(F.coalesce(F.col("uncertainty") == value, F.lit(False)))
    uncertainty = F.when(one("stated-uncertain"), "stated-uncertain").when(one("inferred"), "inferred").otherwise("confirmed")
    line = F.struct("turn", F.sha2(F.concat_ws("|", F.col("turn").cast("string"), "kind"), 256).alias("line"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), ""), 256)
    return marked.groupBy("conv_id").agg(
        F.count("*").alias("entries"), F.coalesce(F.max_by("kind", F.when(F.col("leads"), F.col("turn"))), F.lit("working-note")).alias("kind"),
        said("durability", "ephemeral"), uncertainty.alias("uncertainty"), said("policy", "contextual-only"), said("prior", "low"), digest.alias("digest"),
    )


def overlaid(base: DataFrame, overlay: DataFrame, key: list[str]) -> DataFrame:
    """``base`` where ``overlay`` has no row of the same key, and all of ``overlay``."""
    return base.join(overlay.select(*key).distinct(), key, "left_anti").unionByName(overlay, allowMissingColumns=True)
