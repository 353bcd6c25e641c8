"""What the findings of round 3 asked for: results on larger and odder tables, and plans that don't multiply rows."""

import os
import random
import shutil

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators import logs, pages, references, scopes


def copied(sf_dir, to, **tables):
    """A folder with the tables of ``sf_dir``, some of them replaced by data frames."""
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet") and name[:-8] not in tables:
            shutil.copy(f"{sf_dir}/{name}", to)
    for name, df in tables.items():
        df.toPandas().to_parquet(f"{to}/{name}.parquet")
    return str(to)


def test_case_names_of_long_numbers_are_those_of_the_sql(spark, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    at = copied(sf_dir, tmp_path, labels=labels.union(labels.withColumn("doc_id", F.col("doc_id") + 123_400)))
    same_rows(spark, at, catalog.QUERIES["eval_summary"], catalog.ORACLES["eval_summary"])


def test_a_repeated_short_word_can_be_a_phrase(spark):
    asked = spark.createDataFrame([("q", "Summarise: Nt, Nt, Nt")], "question_id string, text string")
    known = spark.createDataFrame([("a", "Nt, Nt, Nt", "title"), ("b", "nt", "title"), ("c", "Nt. Nt. Ntat", "title")], "source_id string, alias string, basis string")
    got = references.alias_matches(asked, known).orderBy("source_id").select("source_id", "exact", "score").collect()
    assert [tuple(r) for r in got] == [("a", True, 72.0), ("c", False, 36.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_aliases_meet_questions_as_classes(spark):
    """Paths that are equal up to words that no question has are one class."""
    asked = spark.createDataFrame([(f"q{i}", f"what of corpus web en doc {i} txt") for i in range(3)], "question_id string, text string")
    known = spark.range(3, 500).select(F.concat(F.lit("s"), "id").alias("source_id"), F.concat(F.lit("corpus/web/en/doc-"), "id", F.lit(".txt")).alias("alias"), F.lit("path").alias("basis"))
    found = references.alias_matches(asked, known)
    assert found.count() == 3 * 497 and found.select("score").distinct().collect()[0][0] == 75.0
    assert "SortAggregate" not in plan(references.winners(found))  # maxima of pairs are hashed, not sorted


def test_cells_in_one_pass_are_those_of_lines(spark):
    """Also where words stand in the same place, have no text or only blanks; tables send cells once."""
    draw = random.Random(5)
    rows = [(p, w, draw.choice(["ab", " x", "", None, "lorem\t"]), x := draw.randrange(0, 300, 15) * 1.0, y := draw.randrange(0, 60, 2) * 1.0, x + draw.randrange(40), y + 10.0) for p in range(40) for w in range(draw.randrange(30))]
    words = spark.createDataFrame(rows, "page long, word long, text string, x0 double, y0 double, x1 double, y1 double")
    got, want = pages.word_cells(words), pages.line_cells(pages.word_lines(words))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert plan(pages.tables(got)).count("Exchange") == 2


@pytest.mark.parametrize("block, frequent", [(4096, 1), (7, 4), (3, 50_000)])
def test_warm_starts_compare_all_in_blocks(spark, monkeypatch, block, frequent):
    """Against brute force; pairs of questions are not sent."""
    monkeypatch.setattr(logs, "BLOCK", block)
    monkeypatch.setattr(logs, "FREQUENT", frequent)
    draw = random.Random(block)
    rows = [(c, t, draw.randrange(3), draw.sample("abcdefghij", draw.randrange(7))) for c in range(15) for t in range(3)]
    want = []
    for c, t, d, words in rows:
        near = sorted(((len({*words} & {*w}), c2, t2) for c2, t2, d2, w in rows if d2 == d and (c2, t2) < (c, t) and len({*words} & {*w}) >= 2), reverse=True)
        want += [(c, t, c2, t2, n, i) for i, (n, c2, t2) in enumerate(near[:3], 1)]
    found = logs.warm_starts(spark.createDataFrame(rows, "conv_id long, turn int, domain int, words array<string>"))
    assert sorted(map(tuple, found.select("conv_id", "turn", "near_conv", "near_turn", "shared", "place").collect())) == sorted(want)
    assert "FlatMapGroupsInArrow" in plan(found)


def test_leaders_keep_two_rows_a_question_before_rows_are_sent(spark):
    """And units are found once a line and source, where several hold the line too."""
    asked = scopes.with_hints(spark.createDataFrame([("q", "what does line 3 of alpha say"), ("r", "line 3 of beta")], "question_id string, text string"))
    aliased = spark.createDataFrame([("q", "a", "path", True, 90.0), ("q", "b", "title", False, 36.0), ("r", "b", "path", True, 90.0)], "question_id string, source_id string, basis string, exact boolean, score double")
    units = spark.createDataFrame([("a", "u1", 1, 70), ("a", "u2", 3, 3), ("b", "u3", 4, 9), ("c", "u4", 2, 3)], "source_id string, unit_id string, line_start long, line_end long")
    found = scopes.candidates(asked, aliased, units)
    got = {(r.question_id, r.source_id, r.unit_id, r.n_units, r.score) for r in found.collect()}
    assert got == {("q", "a", "u1", 2, 148.0), ("q", "b", None, 0, 36.0), ("r", "b", None, 0, 90.0), ("q", "a", "u1", 2, 58.0), ("r", "a", "u1", 2, 58.0)}
    leaders = scopes._leaders(found.where("source_score > 0"))
    assert {(r.question_id, r.e.source_id, r.e.clear, r.n_exact, r.n_known) for r in leaders.collect()} == {("q", "a", True, 1, 2), ("r", "b", True, 1, 1)}
    assert plan(leaders).count("WindowGroupLimit") >= 3
