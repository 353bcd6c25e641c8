"""Builds that keep what did not change: digests of artifacts rolled up to sources and roots, compared with those of the build before.

A source is used again if its fingerprint is the one of the last build and the build has all artifacts that the contract asks for; only the others are computed. Of these, one whose artifacts come out as
they were is stable: what rests on them holds. A root (whatever sources are grouped by) is computed again only if a source has joined or left it or the digest of one has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources import snapshots
from siltstone.storage import settled

ARTIFACTS, SOURCES = "source_id string, kind string, content string", "source_id string, root string, fingerprint string, digest string, status string"


def source_digests(artifacts: DataFrame) -> DataFrame:
    """(source_id, digest): of a source's kinds in order, with the digests of their contents."""
    line = F.concat_ws(":", "kind", F.md5(F.coalesce("content", F.lit(""))))
    return artifacts.groupBy("source_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "|")).alias("digest"))


def root_digests(sources: DataFrame) -> DataFrame:
    """(root, sources, digest): a sum over the sources of a root, so that no list of them is made."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", "source_id", "digest")), 1, 15), 16, 10).cast("decimal(38,0)")
    return sources.groupBy("root").agg(F.count("*").alias("sources"), F.sum(bits).cast("string").alias("digest"))


def rebuilt(sources: DataFrame, root: str, contract: list[str], compute: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame], DataFrame], at: str) -> tuple[DataFrame, DataFrame]:
    """Bring the build in the folder ``root`` up to ``sources`` (source_id, root, fingerprint, ...); what became of sources and of roots.

    ``compute`` makes artifacts (source_id, kind, content) of rows of ``sources``, ``fold`` makes (root, value) of artifacts (root, source_id, kind, content). Both see only what has to be made again.
    (source_id, root, fingerprint, digest, status): reused, stable, rebuilt or added. (root, value, status): reused or rebuilt. Sources that left have no row. ``at`` is the time of the publication.
    """
    spark = sources.sparkSession
    last = snapshots.tables(spark, root)
    artifacts, before = last.get("artifacts", spark.createDataFrame([], ARTIFACTS)), last.get("sources", spark.createDataFrame([], SOURCES))
    values = last.get("roots", spark.createDataFrame([], "root string, value string, digest string, status string"))
    whole = artifacts.where(F.col("kind").isin(contract)).groupBy("source_id").agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") == len(contract)).select("source_id")
    known = before.select("source_id", F.col("fingerprint").alias("old_print"), F.col("digest").alias("old_digest"))
    looked = sources.join(known, "source_id", "left").join(whole.withColumn("whole", F.lit(True)), "source_id", "left")
    looked = looked.withColumn("same", F.coalesce((F.col("old_print") == F.col("fingerprint")) & F.col("whole"), F.lit(False)))
    kept = artifacts.join(looked.where("same").select("source_id"), "source_id", "left_semi")
    made = settled(compute(looked.where("not same").drop("old_print", "old_digest", "whole", "same")).select("source_id", "kind", "content"))
    now = settled(kept.select("source_id", "kind", "content").union(made))
    status = F.when(F.col("same"), "reused").when(F.col("old_print").isNull(), "added").when(F.col("old_digest").eqNullSafe(F.col("digest")), "stable").otherwise("rebuilt")
    states = settled(looked.join(source_digests(now), "source_id", "left").select("source_id", "root", "fingerprint", "digest", status.alias("status")))

    was = values.select("root", F.col("digest").alias("old_digest"), F.col("value").alias("old_value"))
    roots = settled(root_digests(states).drop("sources").join(was, "root", "left").withColumn("same", F.col("old_digest").eqNullSafe(F.col("digest"))))
    again = states.select("source_id", "root").join(roots.where("not same").select("root"), "root", "left_semi").join(now, "source_id")
    folded = fold(again.select("root", "source_id", "kind", "content")).select("root", "value")
    out = settled(roots.join(folded, "root", "left").select("root", F.when(F.col("same"), F.col("old_value")).otherwise(F.col("value")).alias("value"), "digest", F.when(F.col("same"), "reused").otherwise("rebuilt").alias("status")))
    signature = snapshots.measured(states.select("source_id", "fingerprint"))[1]
    snapshots.publish({"artifacts": now, "sources": states, "roots": out}, root, signature, at, "build")
    return states, out
