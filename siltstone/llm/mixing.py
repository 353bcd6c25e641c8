"""Mixing sources to target weights, with DataFrame functions only.

The words of every source are added up. Sources in code point order (null last) get the weights in turn, and targets share the total by weight.
A target stops at ``most`` times its source; what it leaves is shared among the others by weight until none is above (found in one
pass: with sources in the order of limit over weight, the limited ones come first). A document of a source with repetition rate r
is emitted floor(r) times, and once more if a hash of its id and the seed, as a fraction of 1, is below r - floor(r). So reruns agree,
and no task needs to know of another. A source's seed is the one of SEEDS with which its words come nearest to its target (the
first of equals): a source of few documents would else miss it by chance.

Null text counts as empty. Sources without words have target 0. Rows that repeat an id draw alike; null ids draw as one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import text_or_empty, written

WEIGHTS, MOST, SEEDS = (1, 2, 3), 3, 16
WORD = r"[^\x20\x09-\x0D]+"


def draw(seed):
    """A fraction of 1 in 2**-52 steps, from the seed and the id."""
    digest = F.md5(F.concat(seed.cast("string"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each document."""
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows to (source, source_size, target, rate): one row for each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # from here on there is one row a source, so windows without keys are small
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    sources = sources.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sources = sources.withColumn("share", left / F.sum("weight").over(onward))
    # the first source that its share does not fill has the largest share of all such
    level = F.max(F.when(F.col("full_at") > F.col("share"), F.col("share"))).over(Window.partitionBy())
    target = F.when(F.col("full_at") > F.col("share"), F.col("weight") * level).otherwise(F.col("cap")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def copies(seed):
    return (F.floor("rate") + (draw(seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size) to (_source, source_size, target, rate, seed): one row for each source."""
    rates = written(targets(sizes.select("source", "size"), weights, most), "rates").withColumnRenamed("source", "_source")
    rows = sizes.join(rates, sizes["source"].eqNullSafe(F.col("_source")))
    taken = rows.groupBy("_source", "source_size", "target", "rate").agg(F.array(*(F.sum(copies(F.lit(k)) * F.col("size")) for k in range(SEEDS))).alias("taken"))
    misses = F.transform("taken", lambda t: F.abs(t - F.col("target")))
    return written(taken.withColumn("seed", F.array_position(misses, F.array_min(misses)).cast("int") - 1).drop("taken"), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; columns stay."""
    planned = plan(written(sized(docs), "sizes"), weights, most)
    own = F.struct(*(docs[c] for c in docs.columns))  # set aside, whatever the names of its columns
    rows = docs.select(own.alias("_row"), "doc_id", "source").join(planned, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), copies(F.col("seed")).cast("int")))).select("_row.*")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` to (doc_id, size, source_size, target, taken): what the mix takes of each document, in words."""
    sizes = written(sized(docs), "sizes")
    rows = sizes.join(plan(sizes, weights, most), sizes["source"].eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", "source_size", "target", (copies(F.col("seed")) * F.col("size")).alias("taken"))


#: The same in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
f AS (SELECT *, {MOST} * source_size AS cap, ({MOST} * source_size)::DOUBLE / weight AS full_at FROM w),
p AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share FROM f),
t AS (SELECT source, source_size, CASE WHEN full_at > share THEN weight * (SELECT max(share) FROM p WHERE full_at > share) ELSE cap::DOUBLE END AS target FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}.0) ELSE 0.0 END AS rate FROM t),
k AS (SELECT unnest(range({SEEDS})) AS seed),
u AS (SELECT d.doc_id, d.size, k.seed, r.*, (('0x' || substr(md5(k.seed || '/' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE / {1 << 52}.0 AS draw
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN k),
v AS (SELECT *, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM u),
c AS (SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), seed) AS place FROM v GROUP BY source, seed)
SELECT v.doc_id, v.size, v.source_size, v.target, v.taken FROM v JOIN c ON v.source IS NOT DISTINCT FROM c.source AND v.seed = c.seed WHERE c.place = 1
"""
