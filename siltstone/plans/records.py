"""Queries on the operators of ``operators.records``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import markdown, records
from siltstone.plans.markdown import duck_lines
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS

HEAD = "---\ntitle: \"A 'plain' one\"\n# note: x\nempty:\n  lang : en\nlang: de\n---\n"


def _marked(spark, sf_dir):
    """Texts with headings, fences, blank lines and front matter where lines stand at certain places."""
    parts = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 5 == 4, F.lit("")).when(i % 7 == 3, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "), F.trim(x), F.lit("."))).when(i % 11 == 6, F.lit("```py")).otherwise(x),
    )
    body = F.array_join(parts, "\n")
    return corpus.sources(spark, sf_dir).select(F.col("source_id").alias("doc"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(HEAD), body)).otherwise(body).alias("text"))


def paragraph_blocks(spark, sf_dir):
    return records.blocks(records.lines_of(_marked(spark, sf_dir))).select("doc", F.col("block").cast("long").alias("block"), "line_start", "line_end", F.md5("text").alias("digest"))


def markdown_sections(spark, sf_dir):
    return markdown.sections(_marked(spark, sf_dir))


def front_matter_fields(spark, sf_dir):
    return records.front_matter(records.lines_of(_marked(spark, sf_dir)))


def turn_upsert(spark, sf_dir):
    """Events by user: odd ones are what is known of a turn, even ones its update."""
    e = F.col("event_id")
    rows = corpus.table(spark, sf_dir, "events").withColumn("turn", e % 4)
    side = lambda r: r.groupBy("user_id", "turn").agg(F.array_sort(F.collect_set("event_type")).alias("ids"), F.max(F.when(F.col("value") > 20, F.col("event_type"))).alias("state"))
    out = records.upserted(side(rows.where(e % 8 < 4)), side(rows.where(e % 8 >= 4)), ["user_id", "turn"], ["ids"], ["state"])
    return out.select("user_id", "turn", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("ids").cast("long").alias("n"), "state")


def turn_resolution(spark, sf_dir):
    """Which ids a turn ends up with, and whether pending memories hold it back."""
    e, u = F.col("event_id"), F.col("user_id")
    none = F.array().cast("array<string>")
    s = lambda c: c.cast("string")
    explicit = F.when(e % 5 == 0, F.array(s(e), F.lit(""), s(e)))
    current = F.when(e % 3 == 0, F.array(s(u), F.lit(""))).when(e % 3 == 1, none)
    found = F.when(e % 2 == 0, F.array(s(e + 1))).otherwise(F.array(s(e), s(u + 1000)))
    domain = F.when(e % 7 > 1, "workspace-corpus").otherwise("general-stable")
    mode = F.when(e % 6 == 0, "compare").when(e % 6 == 1, "source-scoped-hard").otherwise("global")
    return corpus.table(spark, sf_dir, "events").select("event_id", F.array_join(records.resolved_ids(explicit, current, found), ",").alias("ids"), records.backlog(u % 4, domain, mode, e % 9 == 0, e % 4 == 0, u % 2 == 0).alias("backlog"))


def lone_confirmations(spark, sf_dir):
    e = F.col("event_id")
    rows = corpus.table(spark, sf_dir, "events").select((F.col("user_id") * 31 + e % 31).alias("conv_id"), e.alias("turn"), F.when(F.col("event_type") == "signup", "pending").otherwise("done").alias("status"), F.when(e % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("j"), e.cast("string")))).alias("jobs"))
    return records.lone_confirmations(rows)


def channel_texts(spark, sf_dir):
    """Channels of line items: known ones, bonuses and flattened descriptions."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    values = F.array(F.element_at(F.array(*map(F.lit, [*records.CHANNELS, "smell"])), (k % 6 + 1).cast("int")), F.element_at(F.array(*map(F.lit, [*records.CHANNELS, "smell"])), (n % 6 + 1).cast("int")))
    described = F.create_map(F.lit("media"), F.array(F.lit("m"), k.cast("string")), F.lit("text"), F.array(F.col("l_returnflag")), F.lit("smell"), F.array(F.lit("x")))
    label = F.element_at(F.array(*map(F.lit, ["high", "medium", "low", "odd"])), (k % 4 + 1).cast("int"))
    known = records.channels_of(values)
    bonus = F.round(records.channel_bonus(known, F.array(F.lit("text"), F.lit("media")), 0.35) + records.confidence_bonus(label), 6)
    return corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(known, ",").alias("channels"), bonus.alias("bonus"), records.channel_text(described).alias("described"))


def unit_consumers(spark, sf_dir):
    """Lines that statements rest on: summaries on the first, key points on each third, claims on each fourth."""
    units = corpus.units(spark, sf_dir)
    kinds = [("summary", "ordinal = 1"), ("key-point", "ordinal % 3 = 0"), ("claim", "ordinal % 4 = 0"), ("claim", "ordinal % 6 = 0")]
    cited = [units.where(w).select("source_id", "unit_id", F.lit(k).alias("kind")) for k, w in kinds]
    return records.consumers(cited[0].union(cited[1]).union(cited[2]).union(cited[3]))


def stale_runs(spark, sf_dir):
    """Runs (a user's error events) that were silent for ten minutes when the next event of any user of the same hour came."""
    events = corpus.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    last = events.groupBy("hour").agg(F.max("ts").alias("now"))
    rows = events.where("event_type = 'error'").join(last, "hour")
    return records.stale(rows, "ts", F.col("now"), F.col("user_id") % 5 == 0).select("event_id", "user_id")


def recent_by_section(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 3).alias("priority"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"))
    return records.newest(rows, "event_type", [F.col("priority"), F.desc("recorded_at"), F.desc("event_id")]).select("event_type", F.col("place").cast("long").alias("place"), "event_id", "recorded_at")


def tolerant_logs(spark, sf_dir):
    """The properties of events; every seventh line is cut short, every eleventh holds no object."""
    e = F.col("event_id")
    line = F.when(e % 7 == 0, F.substring("props", 1, 4)).when(e % 11 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return records.tolerant(corpus.table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line", "k long")


_ALL = (paragraph_blocks, markdown_sections, front_matter_fields, turn_upsert, turn_resolution, lone_confirmations, channel_texts, unit_consumers, stale_runs, recent_by_section, tolerant_logs)
QUERIES = {f.__name__: f for f in _ALL}

_HEAD = HEAD.replace("'", "''")
_MARKED_TEXTS = f"""{DUCK_SOURCES}, sp AS (SELECT source_id AS doc, doc_id, string_split(text, chr(10)) AS p FROM sources),
mk AS (SELECT doc, doc_id, array_to_string(list_transform(p, lambda x, j: CASE WHEN (j - 1) % 5 = 4 THEN '' WHEN (j - 1) % 7 = 3 THEN repeat('#', (j - 1) % 3 + 1) || ' ' || trim(x) || '.' WHEN (j - 1) % 11 = 6 THEN '```py' ELSE x END), chr(10)) AS body FROM sp),
tx AS (SELECT doc, CASE WHEN doc_id % 3 = 0 THEN '{_HEAD}' || body ELSE body END AS text FROM mk)"""
_MARKED = f"""{_MARKED_TEXTS}, ln AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM tx)"""
_known = "list_filter([['text', 'render', 'structure', 'notes', 'media', 'smell'][l_partkey % 6 + 1], ['text', 'render', 'structure', 'notes', 'media', 'smell'][l_linenumber % 6 + 1]], lambda x: x <> 'smell')"
ORACLES = {
    "paragraph_blocks": f"""WITH {_MARKED}, b AS (SELECT *, regexp_matches(line, '\\S') AS full_, count(*) FILTER (NOT regexp_matches(line, '\\S')) OVER (PARTITION BY doc ORDER BY line_no) AS island FROM ln),
g AS (SELECT doc, island, min(line_no) AS line_start, max(line_no) AS line_end, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM b WHERE full_ GROUP BY 1, 2)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line_start) AS block, line_start, line_end, digest FROM g""",
    "markdown_sections": f"""WITH RECURSIVE {_MARKED_TEXTS}, {duck_lines("tx")}
SELECT doc, section, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+', '')) AS title, n AS line FROM walked WHERE head""",
    "front_matter_fields": "WITH d AS (SELECT 'doc-' || doc_id AS doc FROM documents WHERE doc_id % 3 = 0) SELECT doc, key, value FROM d, (VALUES ('title', 'A ''plain'' one'), ('lang', 'de')) v(key, value)",
    "turn_upsert": """WITH r AS (SELECT *, event_id % 4 AS turn, event_id % 8 >= 4 AS fresh FROM events), a AS (SELECT user_id, turn, list_sort(list_distinct(list(event_type))) AS ids, max(event_type) FILTER (fresh AND value > 20) AS n, max(event_type) FILTER (NOT fresh AND value > 20) AS o FROM r GROUP BY 1, 2)
SELECT user_id, turn, array_to_string(ids, ',') AS ids, len(ids)::BIGINT AS n, coalesce(a.n, o) AS state FROM a""",
    "turn_resolution": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id::VARCHAR WHEN event_id % 3 = 0 THEN user_id::VARCHAR WHEN event_id % 2 = 0 THEN (event_id + 1)::VARCHAR ELSE '' END AS ids,
  CASE WHEN user_id % 4 = 0 OR event_id % 7 <= 1 THEN 'ignored' WHEN event_id % 6 <= 1 THEN 'advisory' WHEN event_id % 9 = 0 OR event_id % 4 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'advisory' ELSE 'blocking' END ELSE 'ignored' END AS backlog FROM events""",
    "lone_confirmations": "SELECT user_id * 31 + event_id % 31 AS conv_id, min(event_id) AS turn, 'j' || min(event_id) AS job FROM events WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) = 1 AND min(event_id) % 3 > 0",
    "channel_texts": f"""WITH k AS (SELECT *, {_known} AS known FROM lineitem), d AS (SELECT *, CASE WHEN len(known) = 2 AND known[1] = known[2] THEN known[1:1] ELSE known END AS ch FROM k)
SELECT l_orderkey, l_linenumber, array_to_string(ch, ',') AS channels, round(len(list_filter(ch, lambda x: x IN ('text', 'media'))) * 0.35 + [0.4, 0.2, -0.1, 0.0][l_partkey % 4 + 1], 6)::DOUBLE AS bonus, l_returnflag || chr(10) || 'm' || chr(10) || l_partkey AS described FROM d""",
    "unit_consumers": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, c AS (SELECT source_id, unit_id, (ordinal = 1)::INT AS s, (ordinal % 3 = 0)::INT AS p, (ordinal % 4 = 0)::INT + (ordinal % 6 = 0)::INT AS c FROM units)
SELECT source_id, unit_id, (s + p + c)::BIGINT AS uses, array_to_string(list_filter([CASE WHEN c > 0 THEN 'claim:' || c END, CASE WHEN p > 0 THEN 'key-point:1' END, CASE WHEN s > 0 THEN 'summary:1' END], lambda x: x IS NOT NULL), ',') AS kinds FROM c WHERE s + p + c > 0""",
    "stale_runs": "WITH r AS (SELECT *, max(ts) OVER (PARTITION BY date_trunc('hour', ts)) AS latest FROM events) SELECT event_id, user_id FROM r WHERE event_type = 'error' AND ts < latest - INTERVAL 10 MINUTE AND user_id % 5 <> 0",
    "recent_by_section": """WITH r AS (SELECT event_type, event_id, event_id % 3 AS priority, strftime(ts, '%Y-%m-%d %H:%M:%S') AS recorded_at FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY priority, recorded_at DESC, event_id DESC) AS place FROM r)
SELECT event_type, place, event_id, recorded_at FROM p WHERE place <= 10""",
    "tolerant_logs": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0",
}
