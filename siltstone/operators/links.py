"""Joining evidence: words near boxes, commands and paths, overlays and both ends, affordances and sources, calls and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_near(words: DataFrame, boxes: DataFrame, padding: float, most: int = 24) -> DataFrame:
    """(page, box_id, near, first): how many words overlap a box with padding on every side, and the first ``most`` of them in order.

    ``words``: page, word_id, x0, y0, x1, y1; ``boxes`` the same with box_id. They meet on pages, which are bounded.
    """
    w = words.select("page", "word_id", *(F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")))
    apart = (F.col("wx1") + padding < F.col("x0")) | (F.col("x1") < F.col("wx0") - padding) | (F.col("wy1") + padding < F.col("y0")) | (F.col("y1") < F.col("wy0") - padding)
    met = boxes.join(w, "page").where(~apart)
    place = F.row_number().over(Window.partitionBy("page", "box_id").orderBy("word_id"))
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("word_id")))).cast("array<string>"), " ")
    return met.withColumn("place", place).groupBy("page", "box_id").agg(F.count("*").alias("near"), listed.alias("first"))


def normalized_box(c: Column, size: Column) -> Column:
    """A coordinate as a share of the page, to six places; null without a size."""
    return F.when(size > 0, F.round(c / size, 6))


def named_sources(commands: DataFrame, catalog: DataFrame) -> DataFrame:
    """(command_id, source_id): sources whose whole path stands in a command, at word borders. Commands and paths meet on the words of a command, an equi-join.

    ``commands``: command_id, text. ``catalog``: source_id, current_path.
    """
    said = commands.select("command_id", F.explode(F.array_distinct(F.split(F.regexp_replace("text", "[\"'`,;]", " "), r"\s+"))).alias("current_path"))
    return said.join(catalog.select("source_id", "current_path"), "current_path").select("command_id", "source_id").distinct()


def overlaid_artifacts(artifacts: DataFrame, relations: DataFrame) -> DataFrame:
    """Artifacts with the number of relations that name them at either end, and the strongest confidence (3 high to 1 low) of these.

    ``relations``: source_id, from_id, to_id, confidence. A relation from an artifact to itself counts once.
    """
    ends = relations.select("source_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("artifact_id"), "confidence")
    rolled = ends.groupBy("source_id", "artifact_id").agg(F.count("*").alias("relations"), F.max("confidence").alias("confidence"))
    return artifacts.join(rolled, ["source_id", "artifact_id"], "left").withColumn("relations", F.coalesce("relations", F.lit(0)).cast("long"))


def inherited(units: DataFrame, own: DataFrame, of_source: DataFrame) -> DataFrame:
    """Units with their confidence: their own affordance's, else their source's, else low. ``own``: source_id, unit_id, confidence; ``of_source``: source_id, source_confidence."""
    both = units.join(own, ["source_id", "unit_id"], "left").join(of_source, "source_id", "left")
    return both.withColumn("confidence", F.coalesce("confidence", "source_confidence", F.lit("low"))).drop("source_confidence")


def merged_calls(calls: DataFrame) -> DataFrame:
    """One row for each call: of each field the first value in order of ``seq`` that isn't null."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return calls.groupBy("call_id").agg(*(first(c) for c in calls.columns if c not in ("call_id", "seq")), F.count("*").alias("seen"))


def best_or_ambiguous(scored: DataFrame) -> DataFrame:
    """(source_id, unit_id, score, status): the best unit of a source; ambiguous without one if two share the best score. ``scored``: source_id, unit_id, score."""
    top = scored.groupBy("source_id").agg(F.max("score").alias("score"))
    met = scored.join(top, ["source_id", "score"]).groupBy("source_id", "score").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"))
    return met.select("source_id", F.when(F.col("n") == 1, F.col("unit_id")).alias("unit_id"), "score", F.when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("status"))


def window_ends(turns: DataFrame) -> DataFrame:
    """Turns with the start of the next one of their conversation, or the end of the session for the last. ``turns``: conv_id, turn, session_end."""
    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("window_end", F.coalesce(following, F.col("session_end")))


def source_packets(queue: DataFrame) -> DataFrame:
    """(source_id, candidates, remaining, blocked, highest_remaining): the queue by source; sources without remaining units have a highest priority of 0."""
    remains = ~F.col("state").isin("covered", "blocked")
    return queue.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if(remains).alias("remaining"), F.count_if(F.col("state") == "blocked").alias("blocked"), F.coalesce(F.max(F.when(remains, F.col("priority"))), F.lit(0)).cast("long").alias("highest_remaining"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc, page, body_size, widest): the median size of a page's lines, and the most frequent number of cells (the smallest of equals)."""
    sizes = lines.groupBy("doc", "page").agg(F.median("size").alias("body_size"))
    widths = lines.groupBy("doc", "page", "cells").agg(F.count("*").alias("n")).groupBy("doc", "page").agg(F.max(F.struct("n", (-F.col("cells")).alias("c"))).alias("m"))
    return sizes.join(widths.select("doc", "page", (-F.col("m.c")).alias("cells")), ["doc", "page"])
