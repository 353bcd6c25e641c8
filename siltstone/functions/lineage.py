"""Where a plan is used many times over."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows read from a reliable checkpoint, so that what follows doesn't compute them again; without a checkpoint folder the frame as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
