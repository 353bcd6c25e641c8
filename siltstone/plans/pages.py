"""Queries on the geometry of pages: orders printed as invoices, line items as drawings and as shapes on slides, web pages in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import layout, pages
from siltstone.sources import corpus

#: Where the fields of a line item are printed.
COLUMNS = {"l_partkey": 40, "l_suppkey": 118, "l_quantity": 180, "l_extendedprice": 240, "l_returnflag": 330, "l_linestatus": 352, "l_shipdate": 420}


def _items(spark, sf_dir):
    """Line items on invoices, a page for each order, with what is printed of them, in short columns."""
    items = corpus.table(spark, sf_dir, "lineitem")
    short = {"l_shipdate": F.col("l_shipdate").cast("date"), "l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}
    return items.select(F.col("l_orderkey").alias("page"), "l_linenumber", (F.round(F.col("l_tax") * 100).cast("long") % 9).alias("lower"), *(short.get(c, F.col(c).cast("long")).alias(c) for c in COLUMNS))


def _printed(items):
    """The words of items: a row of its page for each, more or less apart by its tax."""
    fields = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("text"), F.lit(x).alias("x")) for k, (c, x) in enumerate(COLUMNS.items())))
    top = 100.0 + 22 * F.col("l_linenumber") + F.col("lower")
    rows = items.select("page", "l_partkey", "l_linenumber", top.alias("top"), (F.col("l_suppkey") % 3 * 4).alias("shift"), F.explode(fields).alias("f"))
    x0 = (F.col("f.x") + F.col("shift")).cast("double")
    return rows.select("page", ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 10 + F.col("f.k")).cast("long").alias("word"), "f.text", x0.alias("x0"), (F.col("top") + F.col("f.k") % 2).alias("y0"), (x0 + 6 * F.char_length("f.text")).alias("x1"), (F.col("top") + 10).alias("y1"))


def _words(spark, sf_dir):
    """The words of invoices."""
    return _printed(_items(spark, sf_dir))


def word_lines(spark, sf_dir):
    """The line of every word."""
    return pages.word_lines(_words(spark, sf_dir)).select("page", "word", "line")


def table_regions(spark, sf_dir):
    """The tables of every invoice."""
    return pages.word_tables(_items(spark, sf_dir), _printed)


def drawing_clusters(spark, sf_dir):
    """Items as drawings on pages of eight orders."""
    items = corpus.table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") * 13 % 800).cast("double")
    return pages.drawing_clusters(items.select(F.expr("l_orderkey div 8").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("drawing"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.round(F.col("l_discount") * 300)).alias("y1")))


def section_paths(spark, sf_dir):
    """Web pages as documents, their paragraphs as pages: heads are the outline, bold beginnings are headings, the longer the deeper."""
    blocks = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split(F.coalesce("html", F.lit("")), "<p>")).alias("page", "html")).withColumn("page", F.col("page") + 1)
    marked = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    heads = blocks.select("doc", "page", F.explode(marked("<h[1-6]>[^<]*")).alias("tag"))
    outline = heads.select("doc", "page", F.substring("tag", 3, 1).cast("int").alias("level"), F.substring("tag", 5, 1 << 20).alias("title"))
    bold = blocks.select("doc", "page", F.posexplode(marked("<b>[^<]*")).alias("place", "tag")).withColumn("title", F.substring("tag", 4, 1 << 20))
    headings = bold.select("doc", "page", "place", (F.char_length("title") % 4 + 2).cast("int").alias("level"), "title")
    found = pages.section_paths(blocks.select("doc", "page"), outline, headings)
    return found.select("doc", F.col("page").cast("long").alias("page"), F.array_join("section", " > ").alias("section"))


def connector_links(spark, sf_dir):
    """Items as shapes on slides of four orders, and each as a connector between two places; some have one end or none."""
    items = corpus.table(spark, sf_dir, "lineitem").withColumn("slide", F.expr("l_orderkey div 4")).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    at = lambda c, k, n: (F.col(c) * k % n * 1000).cast("double")
    x, y = at("l_partkey", 7919, 9000), at("l_suppkey", 104_729, 6000)
    shapes = items.select("slide", F.col("id").alias("shape"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 20_000).alias("x1"), (y + F.col("l_quantity") * 8000).alias("y1"))
    begin, end = F.col("l_returnflag") != "N", (F.col("l_returnflag") != "N") & (F.col("l_linestatus") != "O") | (F.col("l_linenumber") % 2 == 0)
    place = {"begin_x": F.when(begin, at("l_partkey", 31, 9000)), "begin_y": F.when(begin, at("l_suppkey", 97, 6000)), "end_x": F.when(end, at("l_suppkey", 611, 9000)), "end_y": F.when(end, at("l_partkey", 13, 6000))}
    lines = items.select("slide", F.col("id").alias("connector"), x.alias("x0"), (y + 1_000_000).alias("y0"), (x + 2_000_000).alias("x1"), (y + 1_200_000).alias("y1"), *(v.alias(k) for k, v in place.items()))
    return pages.connector_links(lines, shapes)


def continued_artifacts(spark, sf_dir):
    """Items as tables and charts of their supplier's report, a page for each hundred orders; sections change by the day of shipping."""
    items = corpus.table(spark, sf_dir, "lineitem")
    caption = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Table "), F.round(F.col("l_tax") * 100).cast("long").cast("string")))
    section = F.when(F.dayofmonth("l_shipdate") % 3 > 0, F.concat(F.lit("Part "), (F.dayofmonth("l_shipdate") % 3).cast("string")))
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_partkey") * 1_000_000
    rows = items.select(
        F.col("l_suppkey").alias("doc"), F.expr("l_orderkey div 100").alias("page"), place.cast("string").alias("id"), place.alias("place"), F.when(F.col("l_linestatus") == "O", "chart").otherwise("table").alias("artifact_type"),
        caption.alias("caption"), F.col("l_quantity").cast("long").cast("string").alias("header"), section.alias("section"),
    )
    return layout.continued_artifacts(rows)


def continued_procedures(spark, sf_dir):
    """Events of a user as steps, a page for each day: they begin and end at numbers that their values give."""
    events = corpus.table(spark, sf_dir, "events")
    spans = events.select(
        F.col("user_id").alias("doc"), F.dayofmonth("ts").cast("long").alias("page"), F.col("event_id").alias("id"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "error", "bullet").otherwise("ordered").alias("step_kind"),
        (F.floor("value") % 4 + 1).alias("start_number"), F.when(F.floor("value") % 7 > 0, F.floor("value") % 5 + 1).alias("end_number"), F.when(F.col("event_type") == "click", "clicks").when(F.col("event_type") == "view", "views").alias("section"),
    )
    return layout.continued_procedures(spans)


QUERIES = {f.__name__: f for f in (continued_artifacts, continued_procedures, word_lines, table_regions, drawing_clusters, section_paths, connector_links)}

_FIELD = {"l_shipdate": "strftime(l_shipdate, '%Y-%m-%d')", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}
_LINES = f"""WITH RECURSIVE f AS (SELECT l_orderkey AS page, l_partkey, l_linenumber, 100.0::DOUBLE + 22 * l_linenumber + round(l_tax * 100)::BIGINT % 9 AS top, l_suppkey % 3 * 4 AS shift,
  unnest([{", ".join(f"{{'k': {k}, 'text': {_FIELD.get(c, f'trunc({c})::BIGINT::VARCHAR')}, 'x': {x}}}" for k, (c, x) in enumerate(COLUMNS.items()))}]) AS f FROM lineitem),
w AS (SELECT page, ((l_partkey * 10 + l_linenumber) * 10 + f.k)::BIGINT AS word, f.text AS text, (f.x + shift)::DOUBLE AS x0, top + f.k % 2 AS y0, (f.x + shift)::DOUBLE + 6 * length(f.text) AS x1, top + 10 AS y1 FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, word) AS n, (y0 + y1) / 2 AS centre FROM w),
r AS (SELECT page, 1::BIGINT AS n, 1 AS line, centre AS total, 1 AS many FROM o WHERE n = 1
  UNION ALL SELECT o.page, o.n, CASE WHEN abs(centre - total / many) <= 4.5 THEN line ELSE line + 1 END, CASE WHEN abs(centre - total / many) <= 4.5 THEN total + centre ELSE centre END,
    CASE WHEN abs(centre - total / many) <= 4.5 THEN many + 1 ELSE 1 END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1),
l AS (SELECT o.*, r.line FROM o JOIN r USING (page, n))"""
ORACLES = {
    "word_lines": f"{_LINES} SELECT page, word, line FROM l",
    "table_regions": f"""{_LINES}, g AS (SELECT *, coalesce(x0 - lag(x1) OVER w > 32, true) AS opens FROM l WINDOW w AS (PARTITION BY page, line ORDER BY x0, y0, word)),
p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY page, line ORDER BY x0, y0, word) AS cell FROM g),
c AS (SELECT page, line, cell, string_agg(text, ' ' ORDER BY x0, y0, word) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY ALL),
s AS (SELECT page, line, count(*) AS n, arg_min(y0, cell) AS top FROM c GROUP BY ALL HAVING count(*) > 1),
z AS (SELECT *, CASE WHEN line - lag(line) OVER w = 1 AND abs(top - lag(top) OVER w) <= 28 THEN 0 ELSE 1 END AS apart FROM s WINDOW w AS (PARTITION BY page ORDER BY line)),
q AS (SELECT *, sum(apart) OVER (PARTITION BY page ORDER BY line) AS run FROM z),
u AS (SELECT page, run, arg_max(n, times * 1000 - seen) AS columns, min(seen) AS first_line, sum(times) AS lines FROM (SELECT page, run, n, count(*) AS times, min(line) AS seen FROM q GROUP BY ALL) GROUP BY ALL),
t AS (SELECT q.page, q.run, q.line, columns, first_line, row_number() OVER (PARTITION BY q.page, q.run ORDER BY q.line) AS place FROM q JOIN u USING (page, run) WHERE n >= columns AND lines >= 3),
i AS (SELECT t.*, c.* EXCLUDE (page, line) FROM t JOIN c USING (page, line) WHERE cell <= columns),
k AS (SELECT page, run, cell, max(x0) - min(x0) AS spread FROM i GROUP BY ALL),
b AS (SELECT page, run, max(first_line) AS first_line, count(DISTINCT line) AS rows, max(columns) AS columns, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY ALL HAVING count(DISTINCT line) >= 3),
v AS (SELECT page, run, string_agg(row_text, chr(10) ORDER BY line) AS preview FROM (SELECT page, run, line, string_agg(text, ' | ' ORDER BY cell) AS row_text FROM i WHERE place <= 8 GROUP BY ALL) GROUP BY ALL)
SELECT page, first_line, rows, columns, x0, y0, x1, y1, preview FROM b JOIN v USING (page, run) WHERE (page, run) NOT IN (SELECT (page, run) FROM k WHERE spread > 38)""",
    "drawing_clusters": """WITH RECURSIVE i AS (SELECT l_orderkey // 8 AS page, l_orderkey * 8 + l_linenumber AS id, (l_partkey % 600)::DOUBLE AS x0, (l_suppkey * 13 % 800)::DOUBLE AS y0, l_partkey % 600 + l_quantity AS x1, l_suppkey * 13 % 800 + round(l_discount * 300) AS y1 FROM lineitem),
d AS (SELECT page, id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY page, id),
c AS (SELECT 0 AS step, page, id, id AS label, x0, y0, x1, y1, true AS moved FROM d
  UNION ALL SELECT step + 1, page, id, label, min(x0) OVER w, min(y0) OVER w, max(x1) OVER w, max(y1) OVER w, bool_or(changed) OVER (PARTITION BY page) FROM (
    SELECT a.step, a.page, a.id, any_value(a.x0) AS x0, any_value(a.y0) AS y0, any_value(a.x1) AS x1, any_value(a.y1) AS y1, min(b.label) AS label, min(b.label) < any_value(a.label) AS changed
    FROM c a JOIN c b ON a.page = b.page AND a.x0 - 24 <= b.x1 + 24 AND b.x0 - 24 <= a.x1 + 24 AND a.y0 - 24 <= b.y1 + 24 AND b.y0 - 24 <= a.y1 + 24 WHERE a.moved GROUP BY a.step, a.page, a.id) WINDOW w AS (PARTITION BY page, label))
SELECT page, id AS drawing, arg_max(label, step) AS cluster FROM c GROUP BY page, id""",
    "section_paths": """WITH RECURSIVE h AS (SELECT page_id AS doc, unnest(string_split(coalesce(html, ''), '<p>')) AS html, unnest(range(1, len(string_split(coalesce(html, ''), '<p>')) + 1)) AS page FROM pages),
n AS (SELECT doc, page, tag[3:3]::INT AS level, tag[5:] AS title FROM (SELECT doc, page, unnest(regexp_extract_all(html, '<h[1-6]>[^<]*')) AS tag FROM h)),
b AS (SELECT doc, page, tag[4:] AS title FROM (SELECT doc, page, regexp_extract_all(html, '<b>[^<]*')[1] AS tag FROM h) WHERE tag IS NOT NULL AND tag <> '<b>'),
e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, level, title) AS turn FROM (SELECT *, true AS given FROM n UNION ALL SELECT doc, page, length(title) % 4 + 2, title, false FROM b ANTI JOIN n USING (doc, page))),
s AS (SELECT DISTINCT doc, 0::BIGINT AS turn, []::STRUCT(level BIGINT, title VARCHAR)[] AS stack, 0::BIGINT AS page FROM h
  UNION ALL SELECT e.doc, e.turn, CASE WHEN NOT given AND len(stack) > 0 AND stack[-1].title = e.title THEN stack ELSE list_append(list_filter(stack, lambda x: x.level < e.level), {'level': e.level, 'title': e.title}) END, e.page FROM s JOIN e ON e.doc = s.doc AND e.turn = s.turn + 1),
shown AS (SELECT doc, page, arg_max(stack, turn) AS stack FROM s GROUP BY doc, page)
SELECT h.doc, h.page, array_to_string(list_filter(list_transform(shown.stack, lambda x: x.title), lambda t: t <> ''), ' > ') AS section FROM h ASOF JOIN shown ON h.doc = shown.doc AND h.page >= shown.page""",
    "connector_links": """WITH i AS (SELECT *, l_orderkey // 4 AS slide, l_orderkey * 8 + l_linenumber AS id, (l_partkey * 7919 % 9000 * 1000)::DOUBLE AS x, (l_suppkey * 104729 % 6000 * 1000)::DOUBLE AS y, l_returnflag <> 'N' AS b,
  (l_returnflag <> 'N' AND l_linestatus <> 'O') OR l_linenumber % 2 = 0 AS e FROM lineitem),
s AS (SELECT slide, id AS shape, x AS x0, y AS y0, x + l_quantity * 20000 AS x1, y + l_quantity * 8000 AS y1 FROM i),
p AS (SELECT slide, id, l_partkey * 31 % 9000 * 1000 AS px, l_suppkey * 97 % 6000 * 1000 AS py FROM i WHERE b UNION ALL SELECT slide, id, l_suppkey * 611 % 9000 * 1000, l_partkey * 13 % 6000 * 1000 FROM i WHERE e),
t AS (SELECT p.slide, p.id, s.shape FROM p JOIN s USING (slide) WHERE (px BETWEEN x0 - 180000 AND x1 + 180000 AND py BETWEEN y0 - 180000 AND y1 + 180000)
    OR least(abs(px - x0), abs(px - x1)) + least(abs(py - y0), abs(py - y1)) <= 320000
  UNION ALL SELECT i.slide, i.id, s.shape FROM i JOIN s USING (slide) WHERE NOT b AND NOT e AND x <= x1 AND x0 <= x + 2000000 AND y + 1000000 <= y1 AND y0 <= y + 1200000)
SELECT DISTINCT slide, id AS connector, shape FROM t""",
    "continued_artifacts": """WITH a AS (SELECT l_suppkey AS doc, l_orderkey // 100 AS page, l_orderkey * 8 + l_linenumber + l_partkey * 1000000 AS place, CASE WHEN l_linestatus = 'O' THEN 'chart' ELSE 'table' END AS artifact_type, l_returnflag <> 'N' AS named,
  CASE WHEN l_returnflag <> 'N' THEN 'table-' || round(l_tax * 100)::BIGINT ELSE trunc(l_quantity)::BIGINT::VARCHAR END AS key, CASE WHEN day(l_shipdate) % 3 > 0 THEN 'Part ' || day(l_shipdate) % 3 END AS section FROM lineitem),
j AS (SELECT a.*, b.place AS other, b.section AS behind, row_number() OVER (PARTITION BY a.doc, a.artifact_type, a.page, a.place, a.named, a.key, a.section ORDER BY b.place, b.section NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM a) a
  JOIN a b ON b.doc = a.doc AND b.page = a.page + 1 AND b.artifact_type = a.artifact_type AND b.key = a.key AND (a.section IS NULL OR b.section IS NULL OR a.section = b.section))
SELECT doc, artifact_type, page AS from_page, place::VARCHAR AS from_id, other::VARCHAR AS to_id, named AS sure, array_to_string(list_filter([CASE WHEN named THEN 'caption-match' END, 'header-repeat', CASE WHEN section IS NOT DISTINCT FROM behind THEN 'section-continuity' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM j WHERE n = 1""",
    "continued_procedures": """WITH s AS (SELECT user_id AS doc, day(ts) AS page, event_id AS id, event_type <> 'error' AS ordered, floor(value)::BIGINT % 4 + 1 AS first, CASE WHEN floor(value)::BIGINT % 7 > 0 THEN floor(value)::BIGINT % 5 + 1 END AS last,
  CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' END AS section FROM events WHERE event_type <> 'error')
SELECT a.doc, a.page AS from_page, a.id AS from_id, min(b.id) AS to_id FROM s a JOIN s b ON b.doc = a.doc AND b.page = a.page + 1 AND b.first = a.last + 1 AND (a.section IS NULL OR b.section IS NULL OR a.section = b.section) GROUP BY 1, 2, 3""",
}
