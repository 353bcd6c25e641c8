"""Data-quality rules: one rule is one frame of (source_id, rule); a report unites them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKING = {"missing-text", "duplicate-path", "unknown-relation"}


def broken(frame: DataFrame, rule: str, condition) -> DataFrame:
    return frame.where(condition).select("source_id", F.lit(rule).alias("rule"))


def unresolved(citations: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Citations of what does not exist."""
    return citations.join(targets.select(*key).distinct(), key, "left_anti")


def report(*violations: DataFrame) -> DataFrame:
    """(source_id, n_rules, status, rules): blocking rules before warnings."""
    every = reduce(DataFrame.union, violations).distinct()
    worst = F.max(F.col("rule").isin(*sorted(BLOCKING)).cast("int"))
    return every.groupBy("source_id").agg(F.count("*").alias("n_rules"), F.when(worst == 1, "blocking-errors").otherwise("warnings").alias("status"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def overall(reported: DataFrame, pending: DataFrame) -> DataFrame:
    """(status, pending, blocking, warnings): one row for a target, from its ``report`` and the sources whose synthesis is pending; pending comes before blocking errors, these before warnings."""
    counts = reported.agg(F.count_if(F.col("status") == "blocking-errors").alias("blocking"), F.count_if(F.col("status") == "warnings").alias("warnings"))
    row = counts.crossJoin(pending.agg(F.count("*").alias("pending")))  # one row each
    status = F.when(F.col("pending") > 0, "pending-synthesis").when(F.col("blocking") > 0, "blocking-errors").when(F.col("warnings") > 0, "warnings").otherwise("valid")
    return row.select(status.alias("status"), "pending", "blocking", "warnings")
