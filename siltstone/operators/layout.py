"""Relations between things on pages and in sheets: profiles of columns, captions, continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.predicates import slug48

#: How far a caption may stand from what it names and how near it is sure, how many rows a profile reads, when a value is odd, and words of time axes.
CAPTION_GAP, CAPTION_SURE, PROFILE_ROWS, HIGH, LOW = 88.0, 36.0, 25, 1.8, 0.2
TIME_WORDS = ["date", "day", "week", "month", "quarter", "year", "timeline", "period"]


def column_profile(cells: DataFrame, sheet: str, column: str, order: list) -> DataFrame:
    """(sheet, column, kind, n_values, n_numbers, least, most, mean, odd) of ``cells`` (sheet, column, value: a string) over the first 25 rows of each column.

    Empty values don't count. A column with a number is numeric, one whose name has a word of time is a time axis, others are text. It is odd if, with two numbers or more and a mean
    other than 0, the largest is above 1.8 of the mean or the least below 0.2 of it.
    """
    first = cells.withColumn("_row", F.row_number().over(Window.partitionBy(sheet, column).orderBy(*order))).where(F.col("_row") <= PROFILE_ROWS).where("value <> ''")
    first = first.withColumn("_number", F.expr("try_cast(value as double)"))
    mean = F.sum(F.expr("try_cast(value as decimal(24,4))")).cast("double") / F.count("_number")
    rows = first.groupBy(sheet, column).agg(F.count("*").alias("n_values"), F.count("_number").alias("n_numbers"), F.min("_number").alias("least"), F.max("_number").alias("most"), mean.alias("mean"))
    timely = F.exists(F.array(*map(F.lit, TIME_WORDS)), lambda w: F.contains(F.lower(column), w))
    kind = F.when(F.col("n_numbers") > 0, "numeric").when(timely, "time-axis").otherwise("text")
    odd = (F.col("n_numbers") > 1) & (F.col("mean") != 0) & ((F.col("most") > HIGH * F.col("mean")) | (F.col("least") < LOW * F.col("mean")))
    return rows.withColumns({"kind": kind, "odd": F.coalesce(odd, F.lit(False))})


def nearest_captions(captions: DataFrame, figures: DataFrame) -> DataFrame:
    """(page, caption_id, figure_id, gap, sure): the nearest figure of the page that a caption overlaps in width, within CAPTION_GAP in height.

    The gap is the lesser distance of opposite edges, whether boxes overlap or not; of equal ones the first figure counts. Boxes: page, id, x0, y0, x1, y1. Pages join by equality; figures of a page are few.
    """
    c, f = (d.select("page", *(F.col(x).alias(f"{p}_{x}") for x in ("id", "x0", "y0", "x1", "y1"))) for d, p in ((captions, "c"), (figures, "f")))
    gap = F.least(F.abs(F.col("f_y0") - F.col("c_y1")), F.abs(F.col("c_y0") - F.col("f_y1")))
    near = c.join(f, "page").where((F.least("c_x1", "f_x1") - F.greatest("c_x0", "f_x0")) > 0).withColumn("gap", gap).where(F.col("gap") <= CAPTION_GAP)
    order = Window.partitionBy("page", "c_id").orderBy("gap", "f_id")
    return near.withColumn("place", F.row_number().over(order)).where("place = 1").select("page", F.col("c_id").alias("caption_id"), F.col("f_id").alias("figure_id"), "gap", (F.col("gap") <= CAPTION_SURE).alias("sure"))


def continuations(parts: DataFrame, doc: str, page: str, key: list[str]) -> DataFrame:
    """(doc, key, first_page, pages): runs of parts with the same key on consecutive pages, of two pages or more.

    Parts are dealt out once, by document and key. Tasks go by a number: rows shrink to little, so tasks that go by bytes would hold too many.
    """
    parts = parts.select(doc, page, *key).repartition(2 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc, *key)
    one = parts.distinct()
    run = F.col(page) - F.row_number().over(Window.partitionBy(doc, *key).orderBy(page))
    return one.withColumn("run", run).groupBy(doc, *key, "run").agg(F.min(page).alias("first_page"), F.count("*").alias("pages")).where("pages > 1").drop("run")


def _compatible(a: str, b: str) -> Column:
    """Whether two section paths may be one: equal, or one of them is not known."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return empty(a) | empty(b) | (F.col(a) == F.col(b))


def continued_artifacts(artifacts: DataFrame) -> DataFrame:
    """(doc, artifact_type, from_page, from_id, to_id, sure, reasons): what goes on on the next page of a document.

    ``artifacts``: doc, page, id, place (in its page), artifact_type, caption, header, section (the path as a string). An artifact goes on in the first one of its type on the next page that has its key, the slug
    of its caption or else of its header, if their sections may be one. Those that have neither share the key of untitled ones. They meet by document, page, type and key.
    """
    keyed = artifacts.withColumn("key", slug48(F.coalesce(F.nullif("caption", F.lit("")), F.col("header"), F.lit(""))))
    names = ("page", "id", "place", "caption", "header", "section")
    a, b = (keyed.select("doc", "artifact_type", "key", *(F.col(c).alias(f"{p}_{c}") for c in names)) for p in ("from", "to"))
    met = a.withColumn("next_page", F.col("from_page") + 1).join(b.withColumn("next_page", F.col("to_page")), ["doc", "next_page", "artifact_type", "key"]).where(_compatible("from_section", "to_section"))
    own = ["doc", "artifact_type", "from_page", "from_id", "from_caption", "from_header", "from_section"]
    first = met.groupBy(*own).agg(F.min(F.struct("to_place", "to_id", "to_section")).alias("to"))
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    reasons = F.array(F.when(said("from_caption"), "caption-match"), F.when(said("from_header"), "header-repeat"), F.when(F.col("from_section").eqNullSafe(F.col("to.to_section")), "section-continuity"))
    return first.select("doc", "artifact_type", "from_page", "from_id", F.col("to.to_id").alias("to_id"), said("from_caption").alias("sure"), F.array_join(F.array_compact(reasons), ",").alias("reasons"))


def continued_procedures(spans: DataFrame) -> DataFrame:
    """(doc, from_page, from_id, to_id): ordered steps that go on on the next page, where the number after their last one comes first.

    ``spans``: doc, page, id, place, step_kind, start_number, end_number, section. Of several the first of the page counts; sections must be compatible as in ``continued_artifacts``.
    """
    ordered = spans.where("step_kind = 'ordered'")
    a = ordered.where("end_number is not null").select("doc", F.col("page").alias("from_page"), F.col("id").alias("from_id"), (F.col("page") + 1).alias("page"), (F.col("end_number") + 1).alias("start_number"), F.col("section").alias("from_section"))
    b = ordered.select("doc", "page", "start_number", "id", "place", "section")
    met = a.join(b, ["doc", "page", "start_number"]).where(_compatible("from_section", "section"))
    return met.groupBy("doc", "from_page", "from_id").agg(F.min(F.struct("place", "id"))["id"].alias("to_id"))
