"""What goes on on the next page, against loops over neighbouring pages."""

import random
import re

from siltstone.operators import layout


def compatible(a, b):
    return not a or not b or a == b


def test_artifacts_and_procedures(spark):
    rng = random.Random(2)
    pick = lambda *xs: rng.choice(xs)
    arts, spans = [], []
    for doc in range(25):
        for page in range(1, 6):
            section = pick(None, "", "A", "A", "B")
            for place in range(rng.randint(0, 5)):
                arts.append((doc, page, f"{page}-{place}", place, pick("table", "chart"), pick(None, " ", "Table 1", "table  1!", "Costs"), pick(None, "", "Name Cost", "Costs"), section))
            for place in range(rng.randint(0, 4)):
                spans.append((doc, page, f"{page}-{place}", place, pick("ordered", "ordered", "bullet"), pick(None, 1, 2, 3, 4), pick(None, 1, 2, 3), section))
    key = lambda a: re.sub("[^a-z0-9]+", "-", (a[5] or a[6] or "").lower()).strip("-")[:48] or "untitled"
    want, steps = [], []
    for a in arts:
        for b in (b for b in arts if b[:2] == (a[0], a[1] + 1)):
            if a[4] == b[4] and key(a) == key(b) and compatible(a[7], b[7]):
                said = [n for n, x in (("caption-match", a[5]), ("header-repeat", a[6]), ("section-continuity", a[7] == b[7])) if x]
                want.append((a[0], a[4], a[1], a[2], b[2], bool(a[5]), ",".join(said)))
                break
    for a in spans:
        for b in (b for b in spans if b[:2] == (a[0], a[1] + 1)):
            if a[4] == b[4] == "ordered" and compatible(a[7], b[7]) and a[6] is not None and b[5] is not None and b[5] == a[6] + 1:
                steps.append((a[0], a[1], a[2], b[2]))
                break
    df = spark.createDataFrame(arts, "doc long, page long, id string, place long, artifact_type string, caption string, header string, section string")
    assert sorted(tuple(r) for r in layout.continued_artifacts(df).collect()) == sorted(want) and want
    df = spark.createDataFrame(spans, "doc long, page long, id string, place long, step_kind string, start_number long, end_number long, section string")
    assert sorted(tuple(r) for r in layout.continued_procedures(df).collect()) == sorted(steps) and steps
