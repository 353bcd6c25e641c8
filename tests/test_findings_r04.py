"""What the findings of round 4 on time and disk asked for: the same results, with fewer and smaller rows on the way."""

import random
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from test_pages import WORDS, plain_lines, plain_tables, random_page

from siltstone.operators import changes, pages


def name_of(rng, most):
    letters = rng.choice(("ab", "ab 1", "abcdefgh12 ", "0123456789"))
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def alike_of(new, lost):
    """(id, source, score) of rows (id, size, name), pair by pair."""
    for i, size, x in new:
        for j, old_size, y in lost:
            sizes = [s for s in (size, old_size) if s is not None]
            share, like = min(sizes, default=0) / max(*sizes, 1, 1), SequenceMatcher(None, x, y).ratio()
            if share >= 0.9 and like >= 0.65:
                yield i, j, 0.7 * like + (1 - 0.7) * share


@pytest.mark.parametrize(("most", "pairs", "held"), [(14, 64, 7), (30, 1 << 16, 1 << 12), (75, 500, 20), (240, 1 << 16, 1 << 12)])
def test_names_in_bits_are_like_those_of_difflib(most, pairs, held, monkeypatch):
    """names of any length, empty ones, sizes that are missing or 0, in few and in many steps."""
    monkeypatch.setattr(changes, "PAIRS", pairs)
    monkeypatch.setattr(changes, "HELD", held)
    rng = random.Random(most)
    new, lost = ([(f"{k}{i}", rng.choice([None, 0, 1, 90, 91, 95, 100]), name_of(rng, rng.choice((4, most)))) for i in range(70)] for k in "no")
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], ["id", "size", "stem"])
    known = changes._Lost([batch(lost[:30]), batch(lost[30:])])
    got = [(f"n{i}", f"o{j}", s) for found in known.alike(batch(new)) for i, j, s in zip(*found, strict=True)]
    assert sorted(got) == sorted(alike_of(new, lost)) and got


@pytest.mark.parametrize("batch", (3, 10_000))
def test_only_pairs_that_are_alike_become_rows(spark, batch):
    """pairs are made in the task that has both files, not as rows that are filtered; cells go over several batches."""
    rng = random.Random(batch)
    new, lost = ([(f"{k}/{name_of(rng, 12)}-{i}.txt", rng.choice([1, 90, 91, 100, 5000])) for i in range(120)] for k in "no")
    stem = lambda path: re.sub("[^a-z0-9]+", " ", path[2:-4])
    files = spark.createDataFrame(new, "current_path string, file_size long").selectExpr("*", "'txt' AS document_type").repartition(3)
    gone = spark.createDataFrame([(f"s{i}", *r) for i, r in enumerate(lost)], "source_id string, current_path string, file_size long").selectExpr("*", "'txt' AS document_type").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = changes.relocations(files, gone)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = [*alike_of([(p, size, stem(p)) for p, size in new], [(f"s{i}", size, stem(p)) for i, (p, size) in enumerate(lost)])]
    assert sorted(got) == sorted(want) and got
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("long", (3, 1 << 10))
def test_tables_of_many_pages_at_once(long, monkeypatch):
    """against plain loops, with pages numbered together or word by word."""
    monkeypatch.setattr(pages, "LONG_PAGE", long)
    rng = random.Random(long)
    by_page = {p: random_page(rng, p) for p in range(900)}
    rows = [w for ws in by_page.values() for w in ws]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4]
    at, columns = pages._tables_of(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page", "word", "text", *pages.BOX]))
    got = sorted(zip([rows[i][0] for i in at.to_pylist()], *(c.to_pylist() for c in columns), strict=True))
    assert got == sorted((p, *t) for p, ws in by_page.items() for t in plain_tables(plain_lines(ws), [])) and got


@pytest.mark.parametrize("batch", (1, 40, 1 << 16))
def test_rows_are_sent_once_for_their_words(spark, batch, monkeypatch):
    """words and cells aren't sent; pages go over batches; null pages, words, texts and corners, and blank words."""
    monkeypatch.setattr(pages, "BATCH", batch)
    rng = random.Random(batch)
    odd = lambda w: (*(None if rng.random() < 0.01 else v for v in w[:2]), rng.choice([w[2]] * 9 + [None, " x\t"]), *(None if rng.random() < 0.005 else v for v in w[3:]))
    rows = [odd((f"p{p}", *w[1:])) for p in range(500) for w in random_page(rng, p)]
    df = spark.createDataFrame(rows, WORDS.replace("page long", "page string")).repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(batch, 10_000))
        found, want = pages.word_tables(df, lambda rows: rows.select("*")), pages.tables(pages.word_cells(df))
        assert found.dtypes == want.dtypes
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sorted(tuple(r) for r in want.collect()) and got
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert pages.word_tables(df.limit(0), lambda rows: rows).collect() == []
