"""Document evidence analytics on Spark: evidence tables, change detection, ranking, grounding, rules and log analytics."""
