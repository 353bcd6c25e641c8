"""Propagating scores along the edges between sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.retrieval import HOP_SHARE, OTHER_STRENGTH, STRENGTH
from siltstone.storage import settled


def adjacency(edges: DataFrame) -> DataFrame:
    """(source_id, neighbor, strength): every edge both ways."""
    return edges.select("source_id", F.col("related_source_id").alias("neighbor"), "strength").union(edges.select("related_source_id", "source_id", "strength"))


def strength_weight():
    return reduce(lambda c, kv: c.when(F.col("strength") == kv[0], kv[1]), STRENGTH.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_STRENGTH)


def one_hop(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, source_id, graph_bonus): what neighbours of the scored sources gain; of parallel edges the strongest counts.

    All gains follow from the scores as given, in one relational pass.
    """
    links = adjacency(edges).withColumn("weight", strength_weight()).groupBy("source_id", "neighbor").agg(F.max("weight").alias("weight")).where("source_id <> neighbor")
    gains = scores.where("total > 0").join(links, "source_id")
    return gains.groupBy("query_id", F.col("neighbor").alias("source_id")).agg(F.sum((F.col("total") * HOP_SHARE * F.col("weight")).cast("decimal(18,9)")).cast("double").alias("graph_bonus"))


def in_order(scores: DataFrame, edges: DataFrame, edge_order: list[str], exact: float = 1e-12) -> DataFrame:
    """(query_id, source_id, total, graph_bonus): one hop in the order of the origins, a source passes on what it has gained before its turn.

    Origins are the rows of ``scores`` (query_id, source_id distinct, total > 0), highest first, ties by id. What origin i has at its turn is v(i) = s(i) + the sum of
    v(j) * share(j, i) over origins j before i: a triangular system. A round passes on what the round before has brought, for all origins of all queries: it reaches the
    origins at the end of one more link, ever fewer of them, and adds only what is positive, so the order of a sum never keeps the rounds going. They end when nothing, or nothing above ``exact``,
    is passed on. Then every origin pays all of its neighbours. Of parallel edges the first in ``edge_order`` counts; an edge from a source to itself pays as well.
    """
    origins = settled(scores.where("total > 0").select("query_id", "source_id", "total"))
    position = F.struct(*edge_order)
    both = edges.select("source_id", F.col("related_source_id").alias("neighbor"), "strength", position.alias("at")).union(edges.select("related_source_id", "source_id", "strength", position))
    share = (F.lit(HOP_SHARE) * strength_weight()).alias("share")
    links = settled(both.groupBy("source_id", "neighbor").agg(F.min_by("strength", "at").alias("strength")).select("source_id", "neighbor", share))
    named = lambda df, names: df.select(*(F.col(a).alias(b) for a, b in names.items()))
    payers = named(origins, {"query_id": "query_id", "source_id": "source_id", "total": "payer_total"}).join(links, "source_id")
    before = (F.col("payer_total") > F.col("total")) | ((F.col("payer_total") == F.col("total")) & (F.col("source_id") < F.col("neighbor")))
    earlier = payers.join(named(origins, {"query_id": "query_id", "source_id": "neighbor", "total": "total"}), ["query_id", "neighbor"]).where(before)
    earlier = settled(earlier.select("query_id", "source_id", "neighbor", "share"))
    brought = origins.withColumnRenamed("total", "value")
    parts = [brought]
    while True:
        brought = settled(earlier.join(brought, ["query_id", "source_id"]).groupBy("query_id", F.col("neighbor").alias("source_id")).agg(F.sum(F.col("value") * F.col("share")).alias("value")))
        most = brought.agg(F.max("value")).first()[0]
        if not most:
            break
        parts.append(brought)
        if most <= exact:
            break
    value = settled(reduce(DataFrame.union, parts).groupBy("query_id", "source_id").agg(F.sum("value").alias("value")))
    gains = value.join(links, "source_id").groupBy("query_id", F.col("neighbor").alias("source_id")).agg(F.sum(F.col("value") * F.col("share")).alias("graph_bonus"))
    shown = origins.select("query_id", "source_id", "total").join(gains, ["query_id", "source_id"], "full")
    bonus = F.coalesce("graph_bonus", F.lit(0.0))
    return shown.select("query_id", "source_id", (F.coalesce("total", F.lit(0.0)) + bonus).alias("total"), bonus.alias("graph_bonus"))
