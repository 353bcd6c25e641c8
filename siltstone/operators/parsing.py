"""From raw text to units: paragraphs, delimited tables, links, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import slug, strip, tokens


def paragraphs(sources: DataFrame, cut: str) -> DataFrame:
    """(source_id, paragraph, line_start, line_end, n_chars): runs of lines between lines that match ``cut``, lines counted from 1."""
    lines = sources.select("source_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("source_id").orderBy("pos")
    blank = F.col("line").rlike(cut)
    runs = lines.withColumn("blank", blank).withColumn("run", F.sum(F.col("blank").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    blocks = runs.groupBy("source_id", "run").agg(F.min(F.col("pos") + 1).cast("long").alias("line_start"), F.max(F.col("pos") + 1).cast("long").alias("line_end"), F.sum(F.length("line")).cast("long").alias("n_chars"))
    return blocks.withColumn("paragraph", F.row_number().over(Window.partitionBy("source_id").orderBy("line_start")).cast("long")).drop("run")


def delimited_profile(sources: DataFrame, delimiter: str) -> DataFrame:
    """(source_id, n_columns, n_rows, ragged, headers): the first line as header; ragged if rows differ in width."""
    cells = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.split(x, delimiter))
    widths = F.transform(F.col("cells"), lambda c: F.size(c))
    return sources.select("source_id", cells.alias("cells")).where(F.size("cells") > 0).select(
        "source_id", F.size(F.element_at("cells", 1)).cast("long").alias("n_columns"), (F.size("cells") - 1).cast("long").alias("n_rows"),
        (F.size(F.array_distinct(widths)) > 1).alias("ragged"), F.array_join(F.transform(F.element_at("cells", 1), lambda x: F.trim(x)), "|").alias("headers"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, target, kind) of every link and image of ``pages`` (page_id, html)."""
    found = F.regexp_extract_all("html", F.lit(r"(?:href|src)=\"([^\"]*)\""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "target"))
    kind = F.when(F.col("target").startswith("#"), "anchor").when(F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "external").when(F.col("target").rlike(r"^(\.\./)+"), "outside").when(F.length("target") == 0, "missing").otherwise("local")
    return rows.select("page_id", (F.col("place") + 1).cast("long").alias("place"), "target", kind.alias("kind"))


def headings(units: DataFrame, chars: int = 120, words: int = 14, most: int = 12) -> DataFrame:
    """(source_id, unit_id, alias, slug): lines short enough for a heading, the first ``most`` of each source."""
    alias = strip(F.regexp_replace("text", r"[\s:.]+$", ""))
    fits = units.withColumn("alias", alias).where((F.length("alias").between(1, chars)) & (F.size(tokens(F.col("alias"))).between(1, words)))
    return fits.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))).where(F.col("place") <= most).select("source_id", "unit_id", "alias", slug(F.col("alias")).alias("slug"))
