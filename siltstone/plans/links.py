"""Queries on the operators of ``operators.links``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import links
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS


def _boxes(spark, sf_dir):
    """Line items laid out on pages of sixteen orders."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    x, y = (k * 41 % 400).cast("double"), (k * 59 % 700).cast("double")
    return corpus.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 30 + k % 40).alias("x1"), (y + 10 + k % 30).alias("y1"))


def words_near(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return links.words_near(boxes.where("id % 3 > 0").withColumnRenamed("id", "word_id"), boxes.where("id % 3 = 0").withColumnRenamed("id", "box_id"), 18.0)


def normalized_boxes(spark, sf_dir):
    w, h = F.col("id") % 5 * 200, F.lit(842.0)
    return _boxes(spark, sf_dir).select("id", links.normalized_box(F.col("x0"), w).alias("x0"), links.normalized_box(F.col("y1"), h).alias("y1"))


def named_sources(spark, sf_dir):
    """Commands that read one document's path and grep another's."""
    docs = corpus.sources(spark, sf_dir).select("source_id", "doc_id", "current_path")
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("command_id"), (F.col("item_id") * 3).alias("doc_id"))
    text = F.concat(F.lit("cat '"), "current_path", F.lit("'; grep x corpus/none/doc-"), F.col("command_id").cast("string"))
    return links.named_sources(items.join(docs, "doc_id").select("command_id", text.alias("text")), docs)


def overlaid_artifacts(spark, sf_dir):
    arts = corpus.artifacts(spark, sf_dir).select("source_id", F.col("unit_id").alias("artifact_id"))
    units = corpus.units(spark, sf_dir)
    relations = units.where("ordinal % 2 = 1").select("source_id", F.col("unit_id").alias("from_id"), F.format_string("line-%04d", (F.col("ordinal") + F.col("ordinal") % 4 - 1).cast("int")).alias("to_id"), (F.col("ordinal") % 3 + 1).alias("confidence"))
    return links.overlaid_artifacts(arts, relations)


def inherited_confidence(spark, sf_dir):
    units = corpus.units(spark, sf_dir).select("source_id", "unit_id", "ordinal")
    own = units.where("ordinal % 3 = 0").select("source_id", "unit_id", F.when(F.col("ordinal") % 2 == 0, "high").otherwise("medium").alias("confidence"))
    of_source = corpus.sources(spark, sf_dir).where("lang <> 'en'").select("source_id", F.lit("medium").alias("source_confidence"))
    return links.inherited(units, own, of_source).groupBy("source_id", "confidence").agg(F.count("*").alias("units"))


def merged_calls(spark, sf_dir):
    e = F.col("event_id")
    rows = corpus.table(spark, sf_dir, "events").select((e % 400).alias("call_id"), e.alias("seq"), F.when(e % 3 == 0, F.col("event_type")).alias("name"), F.when(e % 5 > 1, e * 2).alias("output"))
    return links.merged_calls(rows)


def best_units(spark, sf_dir):
    scored = corpus.units(spark, sf_dir).select("source_id", "unit_id", F.floor(F.length("text") / 40).cast("long").alias("score"))
    return links.best_or_ambiguous(scored)


def turn_windows(spark, sf_dir):
    log = corpus.table(spark, sf_dir, "conversations")
    last = log.groupBy("conv_id").agg((F.max("turn") + 1).alias("session_end"))
    return links.window_ends(log.where("role = 'user'").select("conv_id", "turn").join(last, "conv_id")).select("conv_id", "turn", "window_end")


def source_packets(spark, sf_dir):
    n = F.length("text") % 7
    queue = corpus.units(spark, sf_dir).select("source_id", F.length("text").cast("long").alias("priority"), F.when(n < 3, "covered").when(n == 3, "blocked").otherwise("candidate-prepared").alias("state"))
    return links.source_packets(queue)


def body_sizes(spark, sf_dir):
    lines = corpus.units(spark, sf_dir).select(F.col("source_id").alias("doc"), F.floor(F.col("ordinal") / 5).cast("long").alias("page"), (F.length("text") % 9 + 8).cast("double").alias("size"), (F.length("text") % 4).cast("long").alias("cells"))
    return links.body_sizes(lines)


_ALL = (words_near, normalized_boxes, named_sources, overlaid_artifacts, inherited_confidence, merged_calls, best_units, turn_windows, source_packets, body_sizes)
QUERIES = {f.__name__: f for f in _ALL}

_B = "k AS (SELECT l_orderkey // 16 AS page, l_orderkey * 8 + l_linenumber AS id FROM lineitem), b AS (SELECT page, id, (id * 41 % 400)::DOUBLE AS x0, (id * 59 % 700)::DOUBLE AS y0, id * 41 % 400 + 30 + id % 40 AS x1, id * 59 % 700 + 10 + id % 30 AS y1 FROM k)"
_U = f"{DUCK_SOURCES}, {DUCK_UNITS}"
ORACLES = {
    "words_near": f"""WITH {_B}, m AS (SELECT f.page, f.id AS box_id, w.id AS word, row_number() OVER (PARTITION BY f.page, f.id ORDER BY w.id) AS place FROM b f JOIN b w ON f.page = w.page AND f.id % 3 = 0 AND w.id % 3 > 0
  AND NOT (w.x1 + 18 < f.x0 OR f.x1 < w.x0 - 18 OR w.y1 + 18 < f.y0 OR f.y1 < w.y0 - 18)) SELECT page, box_id, count(*) AS near, string_agg(word::VARCHAR, ' ' ORDER BY word) FILTER (place <= 24) AS first FROM m GROUP BY 1, 2""",
    "normalized_boxes": f"WITH {_B} SELECT id, CASE WHEN id % 5 > 0 THEN round(x0 / (id % 5 * 200), 6) END AS x0, round(y1 / 842.0::DOUBLE, 6) AS y1 FROM b",
    "named_sources": "SELECT item_id AS command_id, 'doc-' || doc_id AS source_id FROM benchmark JOIN documents ON doc_id = item_id * 3",
    "overlaid_artifacts": f"""WITH {_U}, r AS (SELECT source_id, ordinal AS o, ordinal + ordinal % 4 - 1 AS t, ordinal % 3 + 1 AS c FROM units WHERE ordinal % 2 = 1), e AS (SELECT source_id, o AS a, c FROM r UNION ALL SELECT source_id, t, c FROM r WHERE t <> o),
x AS (SELECT source_id, a, count(*) AS n, max(c) AS c FROM e GROUP BY 1, 2) SELECT u.source_id, unit_id AS artifact_id, coalesce(n, 0)::BIGINT AS relations, c AS confidence FROM units u LEFT JOIN x ON u.source_id = x.source_id AND u.ordinal = a WHERE u.ordinal % 5 = 0""",
    "inherited_confidence": f"WITH {_U} SELECT source_id, CASE WHEN ordinal % 3 = 0 THEN CASE WHEN ordinal % 2 = 0 THEN 'high' ELSE 'medium' END WHEN lang <> 'en' THEN 'medium' ELSE 'low' END AS confidence, count(*) AS units FROM units JOIN sources USING (source_id) GROUP BY 1, 2",
    "merged_calls": "SELECT event_id % 400 AS call_id, arg_min(event_type, event_id) FILTER (event_id % 3 = 0) AS name, min(event_id * 2) FILTER (event_id % 5 > 1) AS output, count(*) AS seen FROM events GROUP BY 1",
    "best_units": f"""WITH {_U}, s AS (SELECT source_id, unit_id, length(text) // 40 AS score FROM units), t AS (SELECT *, max(score) OVER (PARTITION BY source_id) AS top FROM s)
SELECT source_id, CASE WHEN count(*) = 1 THEN min(unit_id) END AS unit_id, score, CASE WHEN count(*) = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM t WHERE score = top GROUP BY source_id, score""",
    "turn_windows": "WITH e AS (SELECT conv_id, max(turn) + 1 AS session_end FROM conversations GROUP BY 1) SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), session_end) AS window_end FROM conversations JOIN e USING (conv_id) WHERE role = 'user'",
    "source_packets": f"""WITH {_U}, q AS (SELECT source_id, length(text) AS p, length(text) % 7 AS n FROM units)
SELECT source_id, count(*) AS candidates, count(*) FILTER (n > 3) AS remaining, count(*) FILTER (n = 3) AS blocked, coalesce(max(p) FILTER (n > 3), 0)::BIGINT AS highest_remaining FROM q GROUP BY 1""",
    "body_sizes": f"""WITH {_U}, l AS (SELECT source_id AS doc, ordinal // 5 AS page, (length(text) % 9 + 8)::DOUBLE AS size, (length(text) % 4)::BIGINT AS cells FROM units), w AS (SELECT doc, page, cells, count(*) AS n FROM l GROUP BY 1, 2, 3),
m AS (SELECT doc, page, cells FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, cells) AS place FROM w) WHERE place = 1), s AS (SELECT doc, page, median(size) AS body_size FROM l GROUP BY 1, 2) SELECT * FROM s JOIN m USING (doc, page)""",
}
