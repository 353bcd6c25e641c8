"""The whole ranking of sources: all scored fields of sources, units and artifacts, their bonuses, page images, memories, for many queries at once.

Hits of query terms are aggregated per record and field before anything is joined; units and artifacts are cut to the best of each source before they are added up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import query_tokens
from siltstone.operators.retrieval import TOP_ARTIFACTS, TOP_UNITS, best, lexical, memory_gate

#: Weights of all fields, and what else adds to scores.
SOURCE_FIELDS = {"title": 5.0, "entities": 4.0, "summary": 3.0, "claims": 2.5, "key_points": 2.5, "affordance": 2.0, "document_context": 1.8, "path": 1.5}
UNIT_FIELDS = {"title": 2.0, "text": 1.2, "affordance": 1.1, "context": 1.4, "labels": 1.7}
ARTIFACT_FIELDS = {"title": 2.0, "aliases": 2.0, "text": 1.2, "context": 1.4, "labels": 1.7}
CONFIDENCE = {"high": 0.4, "medium": 0.2, "low": -0.1}
DENSITY_SOURCE, DENSITY_UNIT, CHANNEL_SOURCE, CHANNEL_UNIT = 0.3, 0.2, 0.35, 0.25
REFERENCE_SOURCE, REFERENCE_UNIT = {"exact": 5.0, "approximate": 2.5}, {"exact": 12.0, "approximate": 6.0}
PROMOTED, TYPE_NAMED, CAPTIONED, TABULAR, PAGE_IMAGE = 0.4, 0.5, 1.4, 0.35, 0.15
TABLE_WORDS = ["table", "chart", "kpi", "metric"]


def _by_value(column: Column, values: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(column == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def _channels(own: str, wanted: str, weight: float) -> Column:
    none = F.array().cast("array<string>")
    return weight * F.size(F.array_intersect(F.coalesce(own, none), F.coalesce(wanted, none)))


def _asked(spark: SparkSession, queries: dict[str, str], preferred: dict[str, list[str]], resolved: dict[str, tuple[str, str | None, str]]) -> DataFrame:
    """One row for each query: its words, channels, and what its reference was resolved to."""
    rows = [(q, query_tokens(text), preferred.get(q, []), *resolved.get(q, (None, None, None))) for q, text in queries.items()]
    return spark.createDataFrame(rows, "query_id string, words array<string>, wanted array<string>, to_source string, to_unit string, how string")


def unit_scores(units: DataFrame, asked: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, source_id, unit_id, lexical, of_context, of_labels, metadata, place): the best units of each source, the one that a reference means before all others.

    Where a reference is exact, its source has no other unit. Units without a word of the query have no row, unless the reference means them.
    """
    hits = lexical(units, ["source_id", "unit_id"], UNIT_FIELDS, queries, ["context", "labels"])
    of = units.select("source_id", "unit_id", "channels", "confidence", "citation_density")
    meant = asked.where("how in ('exact', 'approximate') and to_unit is not null").select("query_id", F.col("to_source").alias("source_id"), F.col("to_unit").alias("unit_id"))
    rows = hits.join(meant.join(of.select("source_id", "unit_id"), ["source_id", "unit_id"], "left_semi"), ["query_id", "source_id", "unit_id"], "full").join(of, ["source_id", "unit_id"]).join(F.broadcast(asked.drop("words")), "query_id")  # a row a query
    here = F.coalesce((F.col("source_id") == F.col("to_source")) & F.col("to_unit").isNotNull(), F.lit(False))
    mine = here & (F.col("unit_id") == F.col("to_unit"))
    rows = rows.where(~(here & (F.col("how") == "exact")) | mine)
    reference = F.when(mine, _by_value(F.col("how"), REFERENCE_UNIT)).otherwise(0.0)
    metadata = _by_value(F.col("confidence"), CONFIDENCE) + DENSITY_UNIT * F.coalesce("citation_density", F.lit(0.0)) + _channels("channels", "wanted", CHANNEL_UNIT) + reference
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical", "of_context", "of_labels")]
    scored = rows.select("query_id", "source_id", "unit_id", *zero, metadata.alias("metadata"), (mine & F.col("how").isNotNull()).alias("meant"))
    return best(scored, ["query_id", "source_id"], [F.desc("meant"), F.desc(F.round(F.col("lexical") + F.col("metadata"), 9)), "unit_id"], TOP_UNITS).drop("meant")


def artifact_scores(artifacts: DataFrame, units: DataFrame, asked: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, source_id, artifact_id, score, of_context, of_labels, place): the best artifacts of each source.

    A unit whose overlay has labels and whose artifacts have no word of the query brings its page image along, with PAGE_IMAGE.
    """
    hits = lexical(artifacts, ["source_id", "artifact_id"], ARTIFACT_FIELDS, queries, ["context", "labels"])
    of = artifacts.select("source_id", "artifact_id", "unit_id", "artifact_type", "captioned", "promoted")
    rows = hits.join(of, ["source_id", "artifact_id"]).join(F.broadcast(asked), "query_id")  # a row a query
    exact = F.coalesce((F.col("how") == "exact") & (F.col("source_id") == F.col("to_source")) & F.col("to_unit").isNotNull(), F.lit(False))
    rows = rows.where(~exact | F.coalesce(F.col("unit_id") == F.col("to_unit"), F.lit(False)))
    tabular = F.col("artifact_type").isin("table", "chart") & F.arrays_overlap("words", F.array(*map(F.lit, TABLE_WORDS)))
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    more = when(F.col("promoted"), PROMOTED) + when(F.array_contains("words", F.col("artifact_type")), TYPE_NAMED) + when(F.col("captioned") & (F.col("of_context") > 0), CAPTIONED) + when(tabular, TABULAR)
    scored = rows.select("query_id", "source_id", "artifact_id", "unit_id", (F.col("lexical") + more).alias("score"), "of_context", "of_labels")
    images = units.where("page_image is not null and trim(coalesce(labels, '')) <> ''").select("source_id", "unit_id", F.col("page_image").alias("artifact_id")).join(of.select("source_id", "artifact_id"), ["source_id", "artifact_id"], "left_semi")
    bridged = images.join(F.broadcast(asked.select("query_id"))).join(scored.select("query_id", "source_id", "unit_id"), ["query_id", "source_id", "unit_id"], "left_anti")  # labelled units for each query
    every = scored.drop("unit_id").unionByName(bridged.select("query_id", "source_id", "artifact_id", F.lit(PAGE_IMAGE).alias("score"), F.lit(0.0).alias("of_context"), F.lit(0.0).alias("of_labels")))
    return best(every, ["query_id", "source_id"], [F.desc(F.round("score", 9)), "artifact_id"], TOP_ARTIFACTS)


def scores(sources: DataFrame, units: DataFrame, artifacts: DataFrame, queries: dict[str, str], preferred: dict[str, list[str]] | None = None, resolved: dict[str, tuple[str, str | None, str]] | None = None, mode: str = "contextual", domain: str = "composition") -> DataFrame:
    """(query_id, source_id, lexical_source, lexical_units, lexical_artifacts, metadata, context, overlay, memory, total) of every source that a query or its reference meets.

    ``sources``: source_id, the fields of SOURCE_FIELDS, channels, citation_density, trust, and for memories family, policy, prior, kind, relevant; ``units``: source_id, unit_id, the fields of
    UNIT_FIELDS, channels, confidence, citation_density, page_image (an artifact or null); ``artifacts``: source_id, artifact_id, unit_id, the fields of ARTIFACT_FIELDS, artifact_type, captioned, promoted. Null
    fields have no words. ``preferred`` names channels for queries, ``resolved`` (source, unit, exact or approximate). ``mode`` and ``domain`` are those of ``memory_gate``.
    """
    asked = _asked(sources.sparkSession, queries, preferred or {}, resolved or {})
    own = lexical(sources, ["source_id"], SOURCE_FIELDS, queries, ["document_context"]).withColumnsRenamed({"lexical": "lexical_source", "of_document_context": "own_context"})
    add = lambda c: F.sum(c)
    unit = unit_scores(units, asked, queries).groupBy("query_id", "source_id").agg(add("lexical").alias("lexical_units"), add("metadata").alias("unit_metadata"), add("of_context").alias("unit_context"), add("of_labels").alias("unit_overlay"))
    art = artifact_scores(artifacts, units, asked, queries).groupBy("query_id", "source_id").agg(add("score").alias("lexical_artifacts"), add("of_context").alias("artifact_context"), add("of_labels").alias("artifact_overlay"))
    named = asked.where("to_source is not null").select("query_id", F.col("to_source").alias("source_id"))
    key = ["query_id", "source_id"]
    joined = reduce(lambda a, b: a.join(b, key, "full"), (own, unit, art, named))
    of = sources.select("source_id", "channels", "citation_density", "trust", "family", "policy", "prior", "kind", "relevant")
    rows = joined.join(of, "source_id").join(F.broadcast(asked.drop("words")), "query_id")  # a row a query
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    reference = F.when(F.col("source_id") == F.col("to_source"), F.when(F.col("how") == "exact", REFERENCE_SOURCE["exact"]).otherwise(REFERENCE_SOURCE["approximate"])).otherwise(0.0)
    rows = rows.select(
        *key, *(zero(c).alias(c) for c in ("lexical_source", "lexical_units", "lexical_artifacts", "unit_metadata")), (zero("own_context") + zero("unit_context") + zero("artifact_context")).alias("context"),
        (zero("unit_overlay") + zero("artifact_overlay")).alias("overlay"), reference.alias("reference"), (DENSITY_SOURCE * zero("citation_density") + zero("trust") + _channels("channels", "wanted", CHANNEL_SOURCE) + reference).alias("own_metadata"),
        "family", "policy", "prior", "kind", F.coalesce("relevant", F.lit(False)).alias("relevant"), F.lit(mode).alias("mode"), F.lit(domain).alias("domain"),
    )
    rows = rows.where("lexical_source > 0 or lexical_units > 0 or lexical_artifacts > 0 or reference > 0")
    gated = memory_gate(rows.withColumn("lexical", F.col("lexical_source") + F.col("lexical_units") + F.col("lexical_artifacts"))).where("coalesce(admitted, true)")
    metadata, memory = F.col("own_metadata") + F.col("unit_metadata"), F.coalesce("adjustment", F.lit(0.0))
    out = gated.select(*key, "lexical_source", "lexical_units", "lexical_artifacts", metadata.alias("metadata"), "context", "overlay", memory.alias("memory"))
    return out.withColumn("total", F.round(F.col("lexical_source") + F.col("lexical_units") + F.col("lexical_artifacts") + F.col("metadata") + F.col("memory"), 9))
