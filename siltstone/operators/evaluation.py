"""Evaluating replayed cases: deterministic checks, rubric medians, regressions against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: judges that differ by more ask for a review.
SPREAD_MOST = 1


def rubric(trials: DataFrame) -> DataFrame:
    """(case_id, dimension, trials, median_score, spread, review): medians are cut to whole numbers."""
    return trials.groupBy("case_id", "dimension").agg(
        F.count("*").alias("trials"), F.floor(F.median("score")).cast("long").alias("median_score"),
        (F.max("score") - F.min("score")).cast("long").alias("spread"), ((F.max("score") - F.min("score")) > SPREAD_MOST).alias("review"),
    )


def checks(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, found, overlap, forbidden, passed): a case passes with enough of the expected sources and none of the forbidden ones.

    ``cases``: case_id, expected and forbidden (arrays), least. ``results``: case_id, source_id.
    """
    got = results.groupBy("case_id").agg(F.collect_set("source_id").alias("got"))
    got = cases.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    overlap, banned = F.size(F.array_intersect("expected", "got")).cast("long"), F.size(F.array_intersect("forbidden", "got")).cast("long")
    return got.select("case_id", F.size("got").cast("long").alias("found"), overlap.alias("overlap"), banned.alias("forbidden_found"), ((overlap >= F.col("least")) & (banned == 0)).alias("passed"))


def regressions(current: DataFrame, baseline: DataFrame, drop_most: float) -> DataFrame:
    """(case_id, score, base_score, status): cases below their baseline by more than ``drop_most`` regress; unknown ones are new."""
    joined = current.join(baseline.withColumnRenamed("score", "base_score"), "case_id", "left")
    delta = F.col("score") - F.col("base_score")
    status = F.when(F.col("base_score").isNull(), "new").when(delta < -drop_most, "regressed").when(delta > drop_most, "improved").otherwise("steady")
    return joined.select("case_id", "score", "base_score", status.alias("status"))
