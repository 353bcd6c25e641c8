"""Where in a source a question points: pages, slides, sheets, cells, lines, rows, headers and anchors, and the units that lie there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens

#: What a question calls places.
NUMBERED = r"(?iU)\b{}\s*(?:no\.?|number|#)?\s*([0-9]{{1,4}})\b"
SHEET_NAME = r"(?iU)\bsheet\s+([A-Za-z0-9][A-Za-z0-9 _-]{0,79})"
CELL = r"(?U)\b([A-Z]{1,3}[0-9]{1,7}(?::[A-Z]{1,3}[0-9]{1,7})?)\b"
SPAN = r"(?iU)\b{}s?\s*([0-9]{{1,6}})(?:\s*(?:-|to|through)\s*([0-9]{{1,6}}))?\b"
HEADER = r"(?iU)\b(?:header|column)\s+(?:named\s+)?[\"']?([A-Za-z0-9][A-Za-z0-9 _.-]{0,79})[\"']?"
ANCHOR = r"(?iU)(?:^|\s)#([A-Za-z0-9][A-Za-z0-9_-]{0,119})\b|\banchor\s+([A-Za-z0-9][A-Za-z0-9_-]{0,119})\b"
#: What an agreement counts.
ORDINAL, RENDER, SHEET, SLUG, LINES, ROWS, HEAD, CELLS = 60.0, 55.0, 60.0, 60.0, 58.0, 18.0, 22.0, 8.0
FIELDS = ("locator_type", "logical_ordinal", "sheet_name", "cell_hint", "line_start", "line_end", "row_start", "row_end", "header_name", "anchor")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parsed(text: Column) -> dict[str, Column]:
    """The places that a question names. Its type is that of the first kind it names, in the order slide, page, sheet by number, sheet by name, cell, line, row, header, anchor."""
    text = F.coalesce(text, F.lit(""))
    slide, page, sheet = (_found(text, NUMBERED.format(kind)) for kind in ("slide", "page", "sheet"))
    name = F.trim(F.regexp_replace(F.trim(F.coalesce(_found(text, SHEET_NAME), F.lit(""))), CELL, ""))
    name = F.when(F.coalesce(slide, page, sheet).isNull(), F.nullif(F.regexp_replace(name, "^[ :_-]+|[ :_-]+$", ""), F.lit("")))
    cell, header = _found(text, CELL), F.nullif(F.regexp_replace(F.coalesce(_found(text, HEADER), F.lit("")), "^[ \"']+|[ \"']+$", ""), F.lit(""))
    line, row = (_found(text, SPAN.format(kind)) for kind in ("line", "row"))
    upto = lambda kind, first: F.coalesce(_found(text, SPAN.format(kind), 2), first).cast("long")
    anchor = F.coalesce(_found(text, ANCHOR), _found(text, ANCHOR, 2))
    kinds = ((slide, "slide"), (page, "page"), (sheet, "sheet"), (name, "sheet"), (cell, "sheet"), (line, "line"), (row, "row"), (header, "sheet"), (anchor, "section"))
    found = (F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for c, k in kinds)), F.coalesce(slide, page, sheet).cast("long"), name, cell, line.cast("long"), upto("line", line), row.cast("long"), upto("row", row), header, anchor)
    return dict(zip(FIELDS, found, strict=True))


def located(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, source_id, unit_id, score, exact, basis) of the units of a question's source that agree with a place it names.

    ``questions``: question_id, source_id, text; ``units``: source_id, unit_id, unit_type, logical_ordinal, render_ordinal, sheet_name, slug_anchor, line_start, line_end, row_count, header_names,
    cell_hint_supported. Places are parsed before the join, which is by source; questions that name none go. Sums are of all that agrees; rows, headers and cells alone are never exact.
    """
    places = questions.select("question_id", "source_id", *(c.alias(f"q_{k}") for k, c in parsed(F.col("text")).items())).where("q_locator_type is not null")
    both = places.join(units, "source_id")
    kind = F.col("q_locator_type")
    words = lambda c: F.array_join(tokens(c), " ")
    alike = kind == F.col("unit_type")
    by_ordinal = alike & (F.col("q_logical_ordinal") == F.col("logical_ordinal"))
    by_render = ~F.coalesce(by_ordinal, F.lit(False)) & (F.col("render_ordinal") == F.col("q_logical_ordinal")) & (alike | ((kind == "page") & (F.col("unit_type") == "slide")))
    rules = {
        "exact-logical-ordinal": (by_ordinal, ORDINAL), "exact-render-ordinal-alias": (by_render, RENDER), "exact-sheet-name": (F.col("q_sheet_name") == F.col("sheet_name"), SHEET), "exact-slug-anchor": (F.col("q_anchor") == F.col("slug_anchor"), SLUG),
        "exact-line-span": ((F.col("q_line_start") >= F.col("line_start")) & (F.col("q_line_end") <= F.col("line_end")), LINES),
        "row-hint": ((F.col("unit_type") == "sheet") & (F.col("q_row_start") >= 1) & (F.col("q_row_start") <= F.col("q_row_end")) & (F.col("q_row_end") <= F.col("row_count")), ROWS),
        "header-hint": (F.exists(F.coalesce("header_names", F.array().cast("array<string>")), lambda h: (F.trim(h) != "") & (words(h) == words(F.col("q_header_name")))) & F.col("q_header_name").isNotNull(), HEAD),
        "sheet-cell-hint": (F.col("q_cell_hint").isNotNull() & F.col("cell_hint_supported"), CELLS),
    }
    score, basis = F.lit(0.0), []
    for name, (condition, points) in rules.items():
        holds = F.coalesce(condition, F.lit(False))
        score, basis = score + F.when(holds, points).otherwise(0.0), [*basis, F.when(holds, F.lit(name))]
    rows = both.select("question_id", "source_id", "unit_id", score.alias("score"), F.array_compact(F.array(*basis)).alias("basis")).where("score > 0")
    return rows.withColumn("exact", F.exists("basis", lambda b: F.startswith(b, F.lit("exact-")))).withColumn("basis", F.array_join("basis", ","))
