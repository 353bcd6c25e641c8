"""Lines of texts as blocks and sections, and records of turns, jobs, channels and logs: merged, resolved and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels of published evidence, bonuses of confidence, and how long a job may be silent.
CHANNELS = ["text", "render", "structure", "notes", "media"]
CONFIDENCE_BONUS = {"high": 0.4, "medium": 0.2, "low": -0.1}
STALE_MINUTES = 10


def lines_of(texts: DataFrame) -> DataFrame:
    """(doc, line_no, line) of (doc, text); lines count from 1."""
    return texts.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def blocks(lines: DataFrame) -> DataFrame:
    """(doc, block, line_start, line_end, text): runs of lines that are not blank, numbered from 1."""
    blank = ~F.col("line").rlike(r"\S")
    island = F.count_if(blank).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    held = lines.withColumn("_island", island).where(~blank).groupBy("doc", "_island").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line"))).getField("line"), "\n").alias("text")
    )
    return held.withColumn("block", F.row_number().over(Window.partitionBy("doc").orderBy("line_start"))).drop("_island")


def front_matter(lines: DataFrame) -> DataFrame:
    """(doc, key, value): ``key: value`` lines between a first line of dashes and the next one; comments and empty values are left out, of a key the last counts."""
    dashes = F.trim("line") == "---"
    ends = lines.groupBy("doc").agg(F.max((F.col("line_no") == 1) & dashes).alias("_opens"), F.min(F.when((F.col("line_no") > 1) & dashes, F.col("line_no"))).alias("_closes"))
    inside = lines.join(ends.where("_opens and _closes is not null"), "doc").where("line_no > 1 and line_no < _closes")
    line = F.trim("line")
    key, value = F.trim(F.substring_index(line, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(line, "^[^:]*:", "")), "^['\"]+|['\"]+$", "")
    found = inside.where(line.contains(":") & ~line.startswith("#")).select("doc", "line_no", key.alias("key"), value.alias("value")).where("key <> '' and value <> ''")
    return found.groupBy("doc", "key").agg(F.max_by("value", "line_no").alias("value"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], lists: list[str], scalars: list[str]) -> DataFrame:
    """Rows of both by key: lists are united (old values first, each once), of scalars the new one counts if there is one."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    none = F.array().cast("array<string>")
    merged = [F.array_distinct(F.concat(F.coalesce(f"o.{c}", none), F.coalesce(f"n.{c}", none))).alias(c) for c in lists]
    return both.select(*key, *merged, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in scalars))


def resolved_ids(explicit: Column, current: Column, found: Column) -> Column:
    """Ids as given, else those that a turn has, else the only one that was found."""
    given = F.array_distinct(F.filter(explicit, lambda x: x != ""))
    held = F.array_distinct(F.filter(current, lambda x: x != ""))
    return F.when(explicit.isNotNull(), given).when(F.coalesce(F.size(held), F.lit(0)) > 0, held).when(F.size(found) == 1, found).otherwise(F.array().cast("array<string>"))


def backlog(pending: Column, domain: Column, mode: Column, warnings: Column, relevant: Column, narrowed: Column) -> Column:
    """Whether pending memories block an answer, are mentioned, or ignored."""
    softly = F.when(narrowed, "advisory").otherwise("blocking")
    return F.when((pending <= 0) | (domain != "workspace-corpus"), "ignored").when(mode.isin("source-scoped-hard", "compare"), "advisory").when(warnings | relevant, softly).otherwise("ignored")


def lone_confirmations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, job): conversations with exactly one pending turn, if that has exactly one job. ``turns``: conv_id, turn, status, jobs."""
    waiting = turns.where("status = 'pending'").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("turn"), F.first("jobs").alias("jobs"))
    return waiting.where((F.col("n") == 1) & (F.size("jobs") == 1)).select("conv_id", "turn", F.element_at("jobs", 1).alias("job"))


def channels_of(values: Column) -> Column:
    """The known channels of a list, each once, in the list's order."""
    known = F.array(*map(F.lit, CHANNELS))
    return F.array_distinct(F.filter(values, lambda v: F.array_contains(known, v)))


def channel_text(described: Column) -> Column:
    """The descriptions of a map from channels to lists, in the order of the channels, a line each."""
    none = F.array().cast("array<string>")
    return F.array_join(F.flatten(F.array(*(F.coalesce(described[c], none) for c in CHANNELS))), "\n")


def confidence_bonus(label: Column) -> Column:
    out = F.lit(0.0)
    for name, bonus in CONFIDENCE_BONUS.items():
        out = F.when(label == name, bonus).otherwise(out)
    return out


def channel_bonus(offered: Column, preferred: Column, each: float) -> Column:
    """``each`` for every preferred channel that is offered."""
    return F.size(F.array_intersect(offered, preferred)) * F.lit(each)


def consumers(citations: DataFrame) -> DataFrame:
    """(source_id, unit_id, uses, kinds): what rests on a unit, by kind of statement, for every unit that is cited."""
    by_kind = citations.groupBy("source_id", "unit_id", "kind").agg(F.count("*").alias("n"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",")
    return by_kind.groupBy("source_id", "unit_id").agg(F.sum("n").alias("uses"), named.alias("kinds"))


def stale(rows: DataFrame, at: str, now: Column, live: Column) -> DataFrame:
    """Open rows that have been silent for over ten minutes and whose owner does not live."""
    return rows.where((F.col(at) < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")) & ~live)


def newest(rows: DataFrame, section: str, at: list[Column], n: int = 10) -> DataFrame:
    """The newest n rows of each section, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*at))).where(F.col("place") <= n)


def tolerant(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON objects of lines; lines that are broken or no objects are left out."""
    keep = [c for c in lines.columns if c != text]
    parsed = lines.where(F.ltrim(text).startswith("{")).withColumn("_r", F.from_json(text, schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return parsed.where("_r is not null and _r._broken is null").select(*keep, "_r.*").drop("_broken")
