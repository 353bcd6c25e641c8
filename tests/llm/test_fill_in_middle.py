"""Fill-in-middle against a plain version and its SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import DOCS, awkward, documents, prose
from siltstone.llm import fill_in_middle, registry


def plain(doc_id, text, units=fill_in_middle.LINES):
    text = text or ""
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = re.findall(units, text)
    n = len(parts)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


def strange():
    rng = random.Random(3)
    letters = ["\n", "\n", "\x01", "\x02", "e", "d", "<", "S>", "P", "M>", "\U0001f600", "é", "\r", "\x85", " "]
    return ["", "\n", "\n\n\n", "a<S>b", "<P>", "<<M>", "x\n<", "S>\ny", "\x02d\x01e\n\x02", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300))]


def test_strange_texts(spark):
    rows = [(i, t) for i, t in enumerate(strange())]
    out = fill_in_middle.transformed(documents(spark, rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out}
    assert got == {i: plain(i, t) for i, t in rows}
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert all(r["back"] == r["text"] for r in out)


def test_units_may_be_words(spark):
    units = r"\s*\S+|\s+"
    rows = [(i, prose(i, i)) for i in range(40)]
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fill_in_middle.transformed(documents(spark, rows), units).collect()}
    assert got == {i: plain(i, t, units) for i, t in rows}


@pytest.mark.parametrize("rate,spm", [(0, 50), (100, 0), (100, 100), (40, 50)])
def test_shares(spark, rate, spm):
    forms = [r["form"] for r in fill_in_middle.transformed(documents(spark, [(i, "a\nb\nc") for i in range(400)]), rate=rate, spm=spm).collect()]
    assert abs(forms.count("plain") - 400 * (100 - rate) / 100) <= 60 * (0 < rate < 100)
    moved = 400 - forms.count("plain")
    assert abs(forms.count("spm") - moved * spm / 100) <= 60 * (0 < spm < 100)


def test_awkward_rows(spark):
    docs = awkward(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(str((r[0], *(p := plain(r[0], r[1]))[:4], sha(p[4]), sha(r[1] or ""))) for r in docs.select("doc_id", "text").collect())
    assert sorted(str(tuple(r)) for r in fill_in_middle.round_trip(docs).collect()) == want
    assert fill_in_middle.round_trip(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_in_its_plan(spark, sf_dir):
    plan = registry.op13_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
