"""Places that questions name, on cases written by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import locators

NONE = dict.fromkeys(locators.FIELDS)


@pytest.mark.parametrize("text,want", [
    ("What does Page no. 12 say", {"locator_type": "page", "logical_ordinal": 12}), ("slide#3 and page 4", {"locator_type": "slide", "logical_ordinal": 3}), ("sheet 2 B7", {"locator_type": "sheet", "logical_ordinal": 2, "cell_hint": "B7"}),
    ("the sheet Budget 2024 B2:C9", {"locator_type": "sheet", "sheet_name": "Budget 2024", "cell_hint": "B2"}), ("AB12:AC14 is odd", {"locator_type": "sheet", "cell_hint": "AB12:AC14"}), ("ab12", {}),
    ("Lines 4 through 9, row 3", {"locator_type": "line", "line_start": 4, "line_end": 9, "row_start": 3, "row_end": 3}), ("rows 2 - 5", {"locator_type": "row", "row_start": 2, "row_end": 5}), ("outline 4", {}), ("page 12345", {}),
    ("column named 'Net Cost'", {"locator_type": "sheet", "header_name": "Net Cost"}), ("see #intro-2", {"locator_type": "section", "anchor": "intro-2"}), ("a#b", {}), ("anchor top on page 3", {"locator_type": "page", "logical_ordinal": 3, "anchor": "top"}), (None, {}),
])
def test_places(spark, text, want):
    if want.get("sheet_name"):
        want |= {"cell_hint": "B2:C9"}
    row = spark.createDataFrame([(text,)], "text string").select(*(c.alias(k) for k, c in locators.parsed(F.col("text")).items())).first().asDict()
    assert row == NONE | want


def test_located(spark):
    units = spark.createDataFrame([
        ("s", "u1", "page", 3, 4, None, None, 1, 10, None, None, False), ("s", "u2", "slide", 7, 3, None, None, 11, 20, None, None, None), ("s", "u3", "sheet", 1, 1, "Budget", "top", None, None, 9, ["Net  cost", ""], True), ("t", "u4", "page", 3, 3, None, None, 1, 10, None, None, False),
    ], "source_id string, unit_id string, unit_type string, logical_ordinal long, render_ordinal long, sheet_name string, slug_anchor string, line_start long, line_end long, row_count long, header_names array<string>, cell_hint_supported boolean")
    asked = [("a", "s", "page 3"), ("b", "s", "rows 2-9 of column 'net cost' in A1"), ("c", "s", "sheet Budget"), ("d", "s", "lines 2 to 10"), ("e", "s", "row 10"), ("f", "s", "hello"), ("g", "s", "anchor top"), ("h", None, "page 3")]
    got = {(r["question_id"], r["unit_id"]): (r["score"], r["exact"], r["basis"]) for r in locators.located(spark.createDataFrame(asked, "question_id string, source_id string, text string"), units).collect()}
    assert got == {
        ("a", "u1"): (60.0, True, "exact-logical-ordinal"), ("a", "u2"): (55.0, True, "exact-render-ordinal-alias"), ("b", "u3"): (48.0, False, "row-hint,header-hint,sheet-cell-hint"), ("c", "u3"): (60.0, True, "exact-sheet-name"),
        ("d", "u1"): (58.0, True, "exact-line-span"), ("g", "u3"): (60.0, True, "exact-slug-anchor"),
    }
