"""Ranking evidence for many queries at once: lexical scores, per-source top units and artifacts, bonuses, and the final order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import query_tokens, tokens

#: Weights of the fields, how often a term counts, and how much the best parts add.
SOURCE_FIELDS = {"title": 5.0, "summary": 3.0, "path": 1.5}
UNIT_FIELDS = {"text": 1.2}
ARTIFACT_FIELDS = {"title": 2.0, "text": 1.2}
TERM_CAP, TOP_UNITS, TOP_ARTIFACTS = 2, 3, 5
STRENGTH = {"high": 1.5, "medium": 0.8}
OTHER_STRENGTH, HOP_SHARE = 0.5, 0.15


def lexical(records: DataFrame, keys: list[str], fields: dict[str, float], queries: dict[str, str], parts: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, keys, lexical, and of each field in ``parts`` its share): each term of the query counts up to twice in each field, by the field's weight. Sums are of whole tenths, so that ties are ties.

    Words that no query has are dropped, and the others counted where they are read; the counts of a field are one array of numbers, so a record has a row for each field, not for each word. Rows are dealt
    out once, by the first key, for this and for what groups by that key afterwards. Tasks go by a number: rows are alike and shrink to little, so tasks that go by bytes would hold too many. There a record's
    arrays are put together, also if its text came in several rows: counts that were cut at TERM_CAP, added up and cut again are those of the whole.
    """
    asked = {q: sorted({*query_tokens(text)}) for q, text in queries.items()}
    vocabulary = sorted({t for terms in asked.values() for t in terms})
    names, n, base = list(fields), len(vocabulary), TERM_CAP + 1
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    stacked = F.array(*(F.struct(F.lit(i).alias("field"), F.filter(tokens(F.col(f)), lambda t: F.array_contains(known, t)).alias("tokens")) for i, f in enumerate(names)))
    words = F.col("x.tokens")
    code = lambda t: ((F.col("x.field") * n + F.array_position(known, t) - 1) * base + F.least(F.size(F.filter(words, lambda x: x == t)), F.lit(TERM_CAP))).cast("int")
    rows = records.select(*keys, F.explode(stacked).alias("x")).where(F.size("x.tokens") > 0).select(*keys, F.transform(F.array_distinct(words), code).alias("codes"))
    rows = rows.repartition(2 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0])
    rows = rows.groupBy(*keys).agg(F.flatten(F.collect_list("codes")).alias("codes"))  # rows of one record
    place, count = lambda c: F.floor(c / base).cast("int"), lambda c: c % base
    rows = rows.withColumn("places", F.array_distinct(F.transform("codes", place)))
    tenths = F.array(*(F.round(F.lit(w) * 10).cast("long") for w in fields.values()))
    hit = lambda p, hits: F.struct(F.floor(p / n).cast("int").alias("field"), (p % n).alias("token"), (hits * F.element_at(tenths, F.floor(p / n).cast("int") + 1)).alias("tenths"))
    summed = lambda p: F.least(F.aggregate(F.filter("codes", lambda c: place(c) == p), F.lit(0), lambda a, c: a + count(c)), F.lit(TERM_CAP))
    whole = F.size("places") == F.size("codes")
    hits = F.when(whole, F.transform("codes", lambda c: hit(place(c), count(c)))).otherwise(F.transform("places", lambda p: hit(p, summed(p))))
    of = F.array(*(F.struct(F.lit(q).alias("id"), F.array(*(F.lit(vocabulary.index(t)) for t in terms)).cast("array<int>").alias("tokens")) for q, terms in asked.items()))
    rows = rows.select(*keys, hits.alias("hits")).select(*keys, "hits", F.explode(of).alias("q"))
    rows = rows.select(F.col("q.id").alias("query_id"), *keys, F.filter("hits", lambda h: F.array_contains(F.col("q.tokens"), h["token"])).alias("hits")).where(F.size("hits") > 0)
    total = lambda hits: F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["tenths"]) / 10
    share = lambda i: total(F.filter("hits", lambda h: h["field"] == i))
    shares = [share(names.index(p)).alias(f"of_{p}") for p in parts]
    return rows.select("query_id", *keys, total(F.col("hits")).alias("lexical"), *shares)


def best(scored: DataFrame, within: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("place") <= n)


def density(citations: DataFrame, units: DataFrame) -> DataFrame:
    """(source_id, density): citations for each unit of a source, three at most."""
    cited = citations.groupBy("source_id").agg(F.count("*").alias("citations"))
    sizes = units.groupBy("source_id").agg(F.count("*").alias("n_units"))
    share = F.least(F.coalesce("citations", F.lit(0)) / F.col("n_units"), F.lit(3.0))
    return sizes.join(cited, "source_id", "left").select("source_id", F.coalesce("citations", F.lit(0)).cast("long").alias("citations"), "n_units", share.alias("density"))


def source_scores(sources: DataFrame, units: DataFrame, artifacts: DataFrame, densities: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, source_id, lexical_source, lexical_units, lexical_artifacts, metadata, total)"""
    own = lexical(sources, ["source_id"], SOURCE_FIELDS, queries).withColumnRenamed("lexical", "lexical_source")
    unit = best(lexical(units, ["source_id", "unit_id"], UNIT_FIELDS, queries), ["query_id", "source_id"], [F.desc("lexical"), "unit_id"], TOP_UNITS)
    unit = unit.groupBy("query_id", "source_id").agg((F.sum(F.round(F.col("lexical") * 10).cast("long")) / 10).alias("lexical_units"))
    art = lexical(artifacts, ["source_id", "artifact_id"], ARTIFACT_FIELDS, queries)
    art = best(art, ["query_id", "source_id"], [F.desc("lexical"), "artifact_id"], TOP_ARTIFACTS).groupBy("query_id", "source_id").agg((F.sum(F.round(F.col("lexical") * 10).cast("long")) / 10).alias("lexical_artifacts"))
    joined = reduce(lambda a, b: a.join(b, ["query_id", "source_id"], "full"), (own, unit, art)).join(densities.select("source_id", "density"), "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    trust = F.greatest(F.lit(0.0), F.lit(0.3) - F.lit(0.05) * F.lit(2))  # all sources lie two folders deep
    scores = joined.select("query_id", "source_id", *(zero(c).alias(c) for c in ("lexical_source", "lexical_units", "lexical_artifacts")), (0.3 * zero("density") + trust).alias("metadata"))
    return scores.withColumn("total", F.col("lexical_source") + F.col("lexical_units") + F.col("lexical_artifacts") + F.col("metadata"))


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The first ``top`` sources of each query, by scores as they are shown: rounded to three places."""
    shown = scores.withColumn("total", F.floor(F.col("total") * 1000 + 0.5) / 1000).where("total > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), F.desc("lexical_source"), "source_id")
    return shown.withColumns({"place": F.row_number().over(order), "result_count": F.count("*").over(Window.partitionBy("query_id"))}).where(F.col("place") <= top)


def compare_gains(scores: DataFrame) -> DataFrame:
    """The second and third source of a comparison gain 1.2 and 0.6, if their words match by over 0.5: only these rows, with what they gain.

    Only the first three rows of a query are ever ranked together: the filter on the place lets every task keep three before rows are sent.
    """
    first = best(scores, ["query_id"], [F.desc("total"), "source_id"], 3)
    gains = (F.col("lexical_source") + F.col("lexical_units") + F.col("lexical_artifacts")) > 0.5
    bonus = F.when(F.col("place") == 2, 1.2).otherwise(0.6)
    return first.where((F.col("place") > 1) & gains).withColumn("compare_bonus", bonus).withColumn("total", F.col("total") + F.col("compare_bonus")).drop("place")


def support_units(scored: DataFrame, with_artifacts: DataFrame, cited: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, source_id, unit_id, tier, place): scored units, without any those with artifacts, without any cited ones.

    The inputs have (query_id, source_id, unit_id, weight); higher weights come first.
    """
    tiers = [t.select("query_id", "source_id", "unit_id", "weight", F.lit(i).alias("tier")) for i, t in enumerate((scored, with_artifacts, cited), 1)]
    every = reduce(DataFrame.union, tiers)
    first = F.min("tier").over(Window.partitionBy("query_id", "source_id"))
    return best(every.withColumn("first", first).where("tier = first"), ["query_id", "source_id"], [F.desc("weight"), "unit_id"], n).select("query_id", "source_id", "unit_id", "tier", "place")


#: What the prior of a memory adds, and the words that its gate asks for.
PRIOR = {"high": 1.2, "medium": 0.5, "low": 0.0}


def memory_gate(rows: DataFrame) -> DataFrame:
    """Whether a remembered interaction may take part, and by how much its score changes.

    ``rows``: family, policy, prior, kind, relevant (boolean), mode, domain, lexical.
    """
    remembered = F.col("family").isin("interaction-memory", "interaction-pending")
    shut = (
        (F.col("domain") == "external-factual")
        | ((F.col("domain") == "workspace-corpus") & (F.col("mode") == "minimal"))
        | ((F.col("mode") == "minimal") & (F.col("lexical") < 2))
        | ((F.col("domain") == "general-stable") & (F.col("policy") == "contextual-only") & (F.col("lexical") < 4))
        | ((F.col("domain") == "workspace-corpus") & F.col("kind").isin("operator-intent", "working-note") & (F.col("lexical") < 3))
    )
    prior = reduce(lambda c, kv: c.when(F.col("prior") == kv[0], kv[1]), PRIOR.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    contextual = F.col("policy") == "contextual-only"
    extra = (
        F.when(F.col("mode") == "strong", 0.4 + F.when(F.col("relevant"), 0.6).otherwise(0.0))
        .when(F.col("mode") == "contextual", 0.15 + F.when(F.col("relevant"), 0.35).otherwise(0.0) - F.when(contextual, 0.1).otherwise(0.0))
        .otherwise(F.when(contextual, -1.0).otherwise(-0.4))
    )
    admitted = ~remembered | ~shut
    return rows.withColumns({"admitted": admitted, "adjustment": F.when(remembered & admitted, prior + extra).otherwise(0.0)})
