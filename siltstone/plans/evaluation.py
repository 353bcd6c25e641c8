"""Queries on evaluation: benchmark items are cases, labels are trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation
from siltstone.plans import grounding
from siltstone.plans.grounding import _TRACED
from siltstone.sources import corpus


def _trials(spark, sf_dir):
    labels = corpus.table(spark, sf_dir, "labels")
    case = (F.col("doc_id") % 40).alias("case_id")
    both = labels.select(case, F.lit("quality").alias("dimension"), (F.col("quality") + F.col("doc_id") % 2).alias("score"))
    return both.union(labels.select(case, F.lit("safety").alias("dimension"), (F.lit(2) - F.col("toxic") * 2).cast("long").alias("score")))


def rubric_median_spread(spark, sf_dir):
    return evaluation.rubric(_trials(spark, sf_dir))


def eval_checks(spark, sf_dir):
    """Each answer should rest on one source at least of those with even ids, and on none of the first hundred."""
    traced = grounding.support_dedup(spark, sf_dir).select(F.col("answer_id").alias("case_id"), "source_id")
    ids = corpus.sources(spark, sf_dir).select("doc_id", "source_id")
    cases = corpus.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("a-"), "item_id").alias("case_id"), F.lit(1).alias("least"))
    marked = traced.join(ids, "source_id")
    wanted = marked.groupBy("case_id").agg(F.coalesce(F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("source_id"))), F.array().cast("array<string>")).alias("expected"), F.collect_set(F.when(F.col("doc_id") < 100, F.col("source_id"))).alias("forbidden"))
    none = F.array().cast("array<string>")
    cases = cases.join(wanted, "case_id", "left").select("case_id", "least", F.coalesce("expected", none).alias("expected"), F.coalesce("forbidden", none).alias("forbidden"))
    return evaluation.checks(cases, traced)


def baseline_regressions(spark, sf_dir):
    """Mean scores of trials of odd documents against those of even ones."""
    labels = corpus.table(spark, sf_dir, "labels")
    mean = lambda rows: rows.groupBy(F.floor(F.col("doc_id") % 97 / 2).cast("long").alias("case_id")).agg(F.round(F.sum("quality") / F.count("*"), 6).alias("score"))
    return evaluation.regressions(mean(labels.where("doc_id % 2 = 1")), mean(labels.where("doc_id % 2 = 0")), 0.2)


QUERIES = {f.__name__: f for f in (rubric_median_spread, eval_checks, baseline_regressions)}

ORACLES = {
    "rubric_median_spread": """WITH t AS (SELECT doc_id % 40 AS case_id, 'quality' AS dimension, quality + doc_id % 2 AS score FROM labels UNION ALL SELECT doc_id % 40, 'safety', 2 - toxic * 2 FROM labels)
SELECT case_id, dimension, count(*) AS trials, floor(median(score))::BIGINT AS median_score, (max(score) - min(score))::BIGINT AS spread, max(score) - min(score) > 1 AS review FROM t GROUP BY 1, 2""",
    "eval_checks": f"""WITH {_TRACED}, d AS (SELECT DISTINCT answer_id, source_id, substr(source_id, 5)::BIGINT AS doc_id FROM p),
c AS (SELECT answer_id, count(*) AS found, count(*) FILTER (doc_id % 2 = 0) AS overlap, count(*) FILTER (doc_id < 100) AS forbidden_found FROM d GROUP BY 1)
SELECT 'a-' || item_id AS case_id, coalesce(found, 0)::BIGINT AS found, coalesce(overlap, 0)::BIGINT AS overlap, coalesce(forbidden_found, 0)::BIGINT AS forbidden_found, coalesce(overlap, 0) >= 1 AND coalesce(forbidden_found, 0) = 0 AS passed FROM benchmark LEFT JOIN c ON answer_id = 'a-' || item_id""",
    "baseline_regressions": """WITH n AS (SELECT (doc_id % 97) // 2 AS case_id, round(sum(quality) / count(*), 6) AS score FROM labels WHERE doc_id % 2 = 1 GROUP BY 1), b AS (SELECT (doc_id % 97) // 2 AS case_id, round(sum(quality) / count(*), 6) AS base_score FROM labels WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT case_id, score, base_score, CASE WHEN base_score IS NULL THEN 'new' WHEN score - base_score < -0.2 THEN 'regressed' WHEN score - base_score > 0.2 THEN 'improved' ELSE 'steady' END AS status FROM n LEFT JOIN b USING (case_id)""",
}
