"""Rules on cases written by hand, not taken from our own SQL."""

import html as html_library

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import interactions, layout

ENTRY = "conv_id long, turn long, kind string, durability string, uncertainty string, policy string, prior string"


def test_kinds_of_memory(spark):
    rows = [
        (1, 1, "rumour", "durable", "inferred", "direct-support", "high"), (1, 2, "correction", "", None, "direct-support", None), (1, 3, "constraint", None, "confirmed", "", "high"), (1, 4, "constraint", "later", "confirmed", "x", "y"),
        (2, 1, "rumour", "durable", "confirmed", "direct-support", "high"), (3, 1, None, "durable", None, None, None), (4, 1, "political-context", "durable", "inferred", "p", "q"), (4, 2, "operator-intent", "z", "stated-uncertain", "z", "z"),
    ]
    got = {r["conv_id"]: (r["kind"], r["durability"], r["uncertainty"], r["policy"], r["prior"]) for r in interactions.folded_memories(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {
        1: ("constraint", "ephemeral", "inferred", "direct-support", "high"), 2: ("working-note", "ephemeral", "confirmed", "contextual-only", "low"), 3: ("working-note", "ephemeral", "confirmed", "contextual-only", "low"),
        4: ("political-context", "durable", "stated-uncertain", "p", "q"),
    }


def test_captions_that_overlap_in_height(spark):
    box = "page long, id long, x0 double, y0 double, x1 double, y1 double"
    captions = spark.createDataFrame([(1, 1, 0.0, 100.0, 50.0, 110.0), (1, 2, 0.0, 500.0, 50.0, 510.0), (1, 3, 200.0, 100.0, 250.0, 110.0)], box)
    figures = spark.createDataFrame([(1, 10, 0.0, 60.0, 50.0, 150.0), (1, 11, 40.0, 120.0, 90.0, 300.0), (1, 12, 50.0, 111.0, 60.0, 130.0), (1, 13, 0.0, 330.0, 50.0, 440.0), (1, 14, 0.0, 10.0, 50.0, 80.0)], box)
    got = sorted(tuple(r) for r in layout.nearest_captions(captions, figures).collect())
    # figure 10 lies around the caption: its edges are 50 away; 14 ends 20 above; 12 only touches in width
    assert got == [(1, 1, 11, 10.0, True), (1, 2, 13, 60.0, False)]


def test_odd_columns(spark):
    cells = [("s", "one", 1, "5"), ("s", "zero", 1, "-1"), ("s", "zero", 2, "1"), ("s", "far", 1, "1"), ("s", "far", 2, "10"), ("s", "near", 1, "9"), ("s", "near", 2, ""), ("s", "near", 3, "10"), ("s", "Start Date", 1, "soon"), ("s", "name", 1, "x"), ("s", "none", 1, "")]
    df = spark.createDataFrame(cells + [("s", "long", i, "1" if i < 26 else "99") for i in range(1, 40)], "sheet string, column string, row int, value string")
    got = {r["column"]: (r["kind"], r["n_numbers"], r["odd"]) for r in layout.column_profile(df, "sheet", "column", ["row"]).collect()}
    assert got == {"one": ("numeric", 1, False), "zero": ("numeric", 2, False), "far": ("numeric", 2, True), "near": ("numeric", 2, False), "Start Date": ("time-axis", 0, False), "name": ("text", 0, False), "long": ("numeric", 25, False)}


def test_html_references_and_lines(spark):
    cases = ["&eacute;&#233;&#xe9;", "a &amp;lt; b &amp c &notin; &nosuch;", "<P>x</P>\n\n\n\n<STYLE a='>'>p{}</STYLE>y<BR/>z", "<script>1<2</script >t", " a \xa0\t b \r\n\xa0c\xa0 ", "<li>one</li><li>two</li>", "<!-- note -->x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, h string")
    got = {r[0]: r[1] for r in df.select("i", T.html_to_text(F.col("h"))).collect()}
    assert got[0] == "ééé" and got[1] == html_library.unescape("a &amp;lt; b &amp c &notin; &nosuch;") and got[2] == "x\n\n\n y\nz".replace("\n\n\n ", "\n\n")
    assert got[4] == "a \xa0 b\nc" and got[5] == "one\ntwo" and got[6] == "x" and got[7] is None


def test_phases_by_start_and_finish(spark):
    from siltstone.operators import logs

    log = ["start a 0", "finish b 1", "start b 5", "finish a 7", "finish b 9", "finish b 11", "start a 20", "start a 25", "finish a 30", "start c 40", "note c 41", "finish a 42"]
    rows = [(1, int(x.split()[2]), i, *x.split()[:2]) for i, x in enumerate(log)]
    df = spark.createDataFrame(rows, "run long, at long, event_id long, kind string, phase string").withColumn("at", F.timestamp_seconds("at"))
    got = {r["phase"]: (r["seconds"], r["times"]) for r in logs.phase_profile(df).collect()}
    assert got == {"a": (5.0, 3), "b": (4.0, 3)}


def test_status_of_a_target(spark):
    from siltstone.operators import rules

    report = lambda *states: spark.createDataFrame([(str(i), s) for i, s in enumerate(states)], "source_id string, status string")
    cases = {("blocking-errors", "warnings"): "blocking-errors", ("warnings",): "warnings", (): "valid"}
    assert {k: rules.overall(report(*k), report()).first()["status"] for k in cases} == cases
    assert tuple(rules.overall(report("blocking-errors"), report("x")).first()) == ("pending-synthesis", 1, 1, 0)
