"""The queue of units that need a closer look: coverage, batches, and plans of evidence channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a batch, and the channels of evidence.
UNITS_MOST, SOURCES_MOST, UNITS_PER_SOURCE = 12, 4, 3
CHANNELS = ["text", "render", "structure", "notes", "media"]


def batch(queue: DataFrame) -> DataFrame:
    """(source_id, unit_id, source_place, place): the next units, of the first sources by priority, some of each.

    ``queue``: source_id, source_path, unit_id, priority (of the unit). Sources come by their highest priority, then by how many units remain, path and id.
    """
    within = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("priority"), "unit_id"))
    short = queue.withColumn("place", within).where(F.col("place") <= UNITS_PER_SOURCE)
    keys = [F.desc("best"), F.desc("remaining"), F.col("source_path"), F.col("source_id")]
    left = queue.groupBy("source_id").agg(F.max("priority").alias("best"), F.count("*").alias("remaining"), F.min("source_path").alias("source_path"))
    first = left.withColumn("n", F.least("remaining", F.lit(UNITS_PER_SOURCE))).orderBy(*keys).limit(SOURCES_MOST)
    order = Window.orderBy(*keys)  # SOURCES_MOST rows
    fitting = first.withColumns({"source_place": F.row_number().over(order), "so_far": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("so_far") <= UNITS_MOST)
    return short.join(fitting.select("source_id", "source_place"), "source_id").select("source_id", "unit_id", "source_place", "place")


def coverage(queue: DataFrame, by: str) -> DataFrame:
    """(by, units, covered, blocked, remaining, mode): how far each group has come. A unit that is neither covered nor blocked remains."""
    count = lambda s: F.count_if(F.col("state") == s)
    rolled = queue.groupBy(by).agg(F.count("*").alias("units"), count("covered").alias("covered"), count("blocked").alias("blocked"))
    rolled = rolled.withColumn("remaining", F.col("units") - F.col("covered") - F.col("blocked"))
    mode = (
        F.when(F.col("units") == 0, "not-needed").when((F.col("remaining") == 0) & (F.col("blocked") == 0), "covered")
        .when((F.col("covered") == 0) & (F.col("blocked") == 0), "candidate-prepared").otherwise("partially-covered")
    )
    return rolled.withColumn("mode", mode)


def channel_plan(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(query_id, wanted, matched, missing, sufficient): channels that a query asks for and its results do not have.

    ``wanted``: query_id, channels (array). ``offered``: query_id, channel.
    """
    got = offered.groupBy("query_id").agg(F.collect_set("channel").alias("got"))
    rows = wanted.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except("channels", "got"))
    return rows.select("query_id", F.size("channels").cast("long").alias("wanted"), F.size(F.array_intersect("channels", "got")).cast("long").alias("matched"), F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("sufficient"))
