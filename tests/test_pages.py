"""Geometry of pages against plain loops."""

import random
from collections import Counter
from statistics import mean

import pytest

from siltstone.operators import pages

WORDS = "page long, word long, text string, x0 double, y0 double, x1 double, y1 double"


def plain_lines(words):
    lines = []
    for w in sorted(words, key=lambda w: (w[4], w[3], w[1])):
        if lines and abs((w[4] + w[6]) / 2 - mean([(v[4] + v[6]) / 2 for v in lines[-1]])) <= 4.5:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [sorted(line, key=lambda w: w[3]) for line in lines]


def plain_cells(line):
    cells = []
    for w in line:
        if cells and w[3] - cells[-1][-1][5] <= 32:
            cells[-1].append(w)
        else:
            cells.append([w])
    cells = [(" ".join(w[2] for w in c).strip(), union([w[3:] for w in c])) for c in cells]
    return [c for c in cells if c[0]]


def union(boxes):
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))


def overlap(a, b, pad=0.0):
    return not (a[2] + pad < b[0] - pad or b[2] + pad < a[0] - pad or a[3] + pad < b[1] - pad or b[3] + pad < a[1] - pad)


def plain_tables(lines, known):
    out, run = [], []
    for n, cells in [*enumerate(map(plain_cells, lines), 1), (0, [])]:
        if run and (len(cells) < 2 or abs(cells[0][1][1] - run[-1][1][0][1][1]) > 28):
            usual = Counter(len(c) for _, c in run).most_common(1)[0][0]
            rows = [c[:usual] for _, c in run if len(c) >= usual]
            if len(run) >= 3 and len(rows) >= 3 and all(max(r[i][1][0] for r in rows) - min(r[i][1][0] for r in rows) <= 38 for i in range(usual)):
                box = union([c[1] for r in rows for c in r])
                if not any(overlap(box, k, 6) for k in known):
                    out.append((run[0][0], len(rows), usual, *box, "\n".join(" | ".join(c[0] for c in r) for r in rows[:8])))
            run = []
        if len(cells) > 1:
            run.append((n, cells))
    return out


def random_page(rng, page):
    """Rows of words in columns, with jitter, some out of line, some empty."""
    words = []
    columns = [40 + 80 * i for i in range(rng.randint(1, 4))]
    y = 30.0
    for _ in range(rng.randint(0, 12)):
        y += rng.choice([4.5, 14, 14, 14, 20, 20, 28, 28, 28.5])
        for x in columns[: rng.choice([1, *[len(columns)] * 5])]:
            left = x + rng.choice([0, 0, 0, 0, 0, 5, 20, 38, 39] if rng.random() < 0.3 else [0, 5])
            for _ in range(rng.choice([1, 1, 1, 2])):
                words.append((page, len(words), rng.choice(["a", "bb", "", " ", "7.5"]), float(left), y + rng.choice([0, 0.1, 0.2, 4.4]), left + 15.0, y + 10.0))
                left += rng.choice([15, 17])
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_words_to_lines_cells_and_tables(spark, seed):
    rng = random.Random(seed)
    by_page = {p: random_page(rng, p) for p in range(60)}
    known = [(p, 30.0, 100.0, 60.0, 140.0) for p in range(0, 60, 5)]
    df = spark.createDataFrame([w for ws in by_page.values() for w in ws], WORDS).repartition(5)
    lines = pages.word_lines(df).cache()
    want = {(w[0], w[1], n) for ws in by_page.values() for n, line in enumerate(plain_lines(ws), 1) for w in line}
    assert {(r["page"], r["word"], r["line"]) for r in lines.collect()} == want
    cells = pages.line_cells(lines)
    want = sorted((p, n, k, text, *box) for p, ws in by_page.items() for n, line in enumerate(plain_lines(ws), 1) for k, (text, box) in enumerate(plain_cells(line), 1))
    assert sorted(tuple(r) for r in cells.collect()) == want
    want = sorted((p, *t) for p, ws in by_page.items() for t in plain_tables(plain_lines(ws), [k[1:] for k in known if k[0] == p]))
    got = pages.tables(cells, spark.createDataFrame(known, "page long, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(tuple(r) for r in got.collect()) == want and want


def plain_clusters(boxes):
    """First come, first served with a padding of 18, then merging with 24 until nothing changes; numbers of the members of each cluster."""
    clusters = []
    for i, box in boxes:
        for c in clusters:
            if overlap(c[0], box, 18):
                c[1].append(i)
                c[0] = union([c[0], box])
                break
        else:
            clusters.append([box, [i]])
    changed = True
    while changed:
        changed, kept = False, []
        for c in clusters:
            for k in kept:
                if overlap(k[0], c[0], 24):
                    k[1].extend(c[1])
                    k[0] = union([k[0], c[0]])
                    changed = True
                    break
            else:
                kept.append(c)
        clusters = kept
    return {i: min(c[1]) for c in clusters for i in c[1]}


@pytest.mark.parametrize("seed,size", [(1, 2000), (2, 600), (3, 1200)])
def test_drawing_clusters(spark, seed, size):
    rng = random.Random(seed)
    by_page = {}
    for p in range(40):
        rows = [(i, (x := rng.uniform(-100, size)), (y := rng.uniform(0, size)), x + rng.choice([0, 5, 60, 400 * (rng.random() < 0.05)]), y + rng.uniform(0, 40)) for i in range(rng.randint(0, 40))]
        by_page[p] = rows
    df = spark.createDataFrame([(p, *r) for p, rows in by_page.items() for r in rows], "page long, drawing long, x0 double, y0 double, x1 double, y1 double")
    want = {(p, i, c) for p, rows in by_page.items() for i, c in plain_clusters([(r[0], r[1:]) for r in rows]).items()}
    assert {tuple(r) for r in pages.drawing_clusters(df).select("page", "drawing", "cluster").collect()} == want


def test_borders_of_padding_count(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 58.0, 0.0, 60.0, 10.0), (1, 2, 108.1, 0.0, 120.0, 10.0), (2, 3, 58.0, 0.0, 60.0, 10.0), (1, None, 0.0, 0.0, 1.0, 1.0)], "page long, drawing long, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r)[1:] for r in pages.drawing_clusters(df).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}


def plain_sections(n_pages, nodes, headings):
    stack, out = [], {}
    for page in range(1, n_pages + 1):
        mine = sorted(((max(level, 1), title) for p, level, title in nodes if p == page))
        if mine:
            for level, title in mine:
                stack = [*(s for s in stack if s[0] < level), (level, title)]
        else:
            first = [(max(level, 1), title) for p, _, level, title in sorted(headings) if p == page][:1]
            for level, title in first:
                if title and (not stack or stack[-1][1] != title):
                    stack = [*(s for s in stack if s[0] < level), (level, title)]
        out[page] = [title for _, title in stack if title]
    return out


def test_section_paths(spark):
    rng = random.Random(5)
    docs = {d: (rng.randint(1, 14), [(rng.randint(1, 14), rng.randint(0, 4), rng.choice(["A", "B", "C", ""])) for _ in range(rng.randint(0, 8))], [(rng.randint(1, 14), k, rng.randint(0, 4), rng.choice(["A", "B", "C", ""])) for k in range(rng.randint(0, 14))]) for d in range(80)}
    every = spark.createDataFrame([(d, p) for d, (n, *_) in docs.items() for p in range(1, n + 1)], "doc long, page int")
    outline = spark.createDataFrame([(d, *x) for d, (n, nodes, _) in docs.items() for x in nodes if x[0] <= n], "doc long, page int, level int, title string")
    headings = spark.createDataFrame([(d, *x) for d, (n, _, hs) in docs.items() for x in hs if x[0] <= n], "doc long, page int, place int, level int, title string")
    got = {(r["doc"], r["page"]): r["section"] for r in pages.section_paths(every, outline, headings).collect()}
    assert got == {(d, p): s for d, (n, nodes, hs) in docs.items() for p, s in plain_sections(n, [x for x in nodes if x[0] <= n], [x for x in hs if x[0] <= n]).items()}


def test_no_python_for_sections(spark):
    df = spark.createDataFrame([(1, 1)], "doc long, page int")
    nodes = spark.createDataFrame([(1, 1, 1, "A")], "doc long, page int, level int, title string")
    heads = spark.createDataFrame([(1, 1, 1, 1, "A")], "doc long, page int, place int, level int, title string")
    plan = pages.section_paths(df, nodes, heads)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_links(c, shapes):
    ends = [(x, y) for x, y in (c[4:6], c[6:8]) if x is not None and y is not None]
    boxes = [(x - 180000, y - 180000, x + 180000, y + 180000) for x, y in ends] or [c[:4]]
    near = lambda b: min((min(abs(x - b[0]), abs(x - b[2])) + min(abs(y - b[1]), abs(y - b[3])) for x, y in ends), default=1e18) <= 320000
    return {s for s, b in shapes.items() if any(overlap(e, b) for e in boxes) or near(b)}


def test_connector_links(spark):
    rng = random.Random(9)
    at = lambda: float(rng.randrange(-400_000, 6_000_000, 20_000))
    shapes = {s: {i: (x := at(), y := at(), x + rng.randrange(0, 3_000_000, 20_000), y + rng.randrange(0, 900_000, 20_000)) for i in range(rng.randint(0, 15))} for s in range(40)}
    lines = {s: {i: (x := at(), y := at(), x + 500_000, y + 10, *((at(), at()) if rng.random() < 0.8 else (None, at())), *((at(), at()) if rng.random() < 0.8 else (None, None))) for i in range(rng.randint(0, 9))} for s in range(40)}
    c = spark.createDataFrame([(s, i, *map(lambda v: None if v is None else float(v), r)) for s, rows in lines.items() for i, r in rows.items()], "slide long, connector long, x0 double, y0 double, x1 double, y1 double, begin_x double, begin_y double, end_x double, end_y double")
    t = spark.createDataFrame([(s, i, *map(float, r)) for s, rows in shapes.items() for i, r in rows.items()], "slide long, shape long, x0 double, y0 double, x1 double, y1 double")
    want = {(s, i, k) for s, rows in lines.items() for i, r in rows.items() for k in plain_links(r, shapes[s])}
    assert sorted(tuple(r) for r in pages.connector_links(c, t).collect()) == sorted(want) and want
