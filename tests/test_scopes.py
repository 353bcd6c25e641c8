"""What questions mean, by hand: every way that a resolution can end."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import scopes


@pytest.fixture(scope="module")
def outcome(spark):
    aliases = spark.createDataFrame(
        [("a", "corpus/x/alpha report.txt", "path"), ("a", "Alpha Report", "title"), ("b", "corpus/x/beta plan.txt", "path"), ("b", "Beta Plan", "title"), ("c", "corpus/y/twin.txt", "path"), ("c", "Twin Notes", "title"), ("d", "corpus/z/twin.txt", "path"), ("d", "Twin Notes", "title"), ("e", "", "title")],
        "source_id string, alias string, basis string",
    )
    units = spark.createDataFrame([("a", "a1", 1, 5), ("a", "a2", 6, 9), ("b", "b1", 1, 5), ("b", "b2", 3, 7)], "source_id string, unit_id string, line_start long, line_end long")
    asked = {
        "exact": "what does corpus/x/alpha report.txt say", "unit": "what does line 7 of corpus/x/alpha report.txt say", "no line": "what does line 70 of corpus/x/alpha report.txt say", "two units": "line 4 of corpus/x/beta plan.txt",
        "twins": "Summarise: Twin Notes", "missing": 'use only the file "gamma"', "two asked": 'use only the file "Twin Notes"', "nothing": "hello there", "only line": "line 8 please", "compare": 'compare "Alpha Report" with "Beta Plan"',
        "compare one": 'compare "Alpha Report" with "Gamma Sketch"', "null": None, "empty": "",
    }
    questions = spark.createDataFrame(list(asked.items()), "question_id string, text string")
    return {r.question_id: r for r in scopes.resolved(questions, aliases, units).collect()}, questions, aliases, units


@pytest.mark.parametrize(
    "name, want",
    [
        ("exact", ("exact", "exact", "none", "a", None, None, "source-scoped-soft", ["a"])),
        ("unit", ("exact", "exact", "exact", "a", "a2", None, "source-scoped-soft", ["a"])),
        ("no line", ("approximate", "exact", "unresolved", "a", None, "soft-approximation", "source-scoped-soft", ["a"])),
        ("two units", ("approximate", "exact", "unresolved", "b", None, "soft-approximation", "source-scoped-soft", ["b"])),
        ("twins", ("unresolved", "unresolved", "none", None, None, "ambiguous-source", "global", [])),
        ("missing", ("unresolved", "unresolved", "none", None, None, "missing-source", "source-scoped-hard", [])),
        ("two asked", ("unresolved", "unresolved", "none", None, None, "ambiguous-source", "source-scoped-hard", [])),
        ("nothing", ("none", "none", "none", None, None, None, "global", [])),
        ("only line", ("approximate", "approximate", "exact", "a", "a2", "soft-approximation", "global", ["a"])),
        ("compare", ("exact", "none", "none", None, None, None, "compare", ["a", "b"])),
        ("compare one", ("unresolved", "exact", "none", "a", None, "compare-source-unresolved", "compare", ["a"])),
        ("null", ("none", "none", "none", None, None, None, "global", [])),
        ("empty", ("none", "none", "none", None, None, None, "global", [])),
    ],
)
def test_ways_to_end(outcome, name, want):
    r = outcome[0][name]
    assert (r.status, r.source_match, r.unit_match, r.source_id, r.unit_id, r.reason, r.scope, list(r.held_to)) == want


def test_hard_boundaries_and_counts(outcome):
    rows = outcome[0]
    assert [rows[n].hard_boundary for n in ("missing", "two asked", "compare", "compare one", "exact")] == [True, True, False, True, False]
    assert (rows["compare"].expected, rows["compare"].missing, rows["compare one"].expected, rows["compare one"].missing) == (2, 0, 2, 1)


def test_empty_tables(outcome):
    _, questions, aliases, units = outcome
    none = scopes.resolved(questions, aliases.limit(0), units.limit(0))
    assert {r.source_id for r in none.collect()} == {None}
    assert scopes.resolved(questions.limit(0), aliases, units).count() == 0


def test_segments_and_scopes(spark):
    row = lambda scope, status, target, compared, supporting: (scope, status, target, compared, supporting)
    rows = spark.createDataFrame(
        [
            row("global", "unresolved", None, [], []), row("source-scoped-soft", "grounded", "a", [], ["a", "b"]), row("source-scoped-hard", "grounded", "a", [], ["b"]), row("source-scoped-hard", "abstained", "a", [], ["b"]),
            row("source-scoped-hard", "grounded", None, [], ["b"]), row("compare", "grounded", None, ["a", "c"], ["c"]), row("compare", "grounded", None, [], ["c", "c"]), row("compare", "grounded", None, [], ["c", "d"]),
        ],
        "scope string, status string, target string, compared array<string>, supporting array<string>",
    )
    kept = rows.select(scopes.segment_satisfied(*map(F.col, rows.columns)).alias("kept")).collect()
    assert [r.kept for r in kept] == [True, True, False, True, False, True, False, True]
