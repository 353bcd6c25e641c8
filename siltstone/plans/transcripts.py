"""Queries on two logs of the same conversations, and on nested messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import transcripts
from siltstone.sources import corpus


def turn_alignment(spark, sf_dir):
    """What users said, and a second log of it: of some turns only the first sentence, some missing, all a little later."""
    log = corpus.table(spark, sf_dir, "conversations").withColumn("size", F.char_length(F.coalesce("text", F.lit(""))))
    users = log.where("role = 'user'")
    mirror = users.select(F.col("conv_id").alias("conv"), "turn", "text", (F.col("turn") * 60).alias("opened_at"))
    said = F.when(F.col("size") % 2 == 0, F.substring_index("text", ".", 1)).otherwise(F.col("text"))
    native = users.where("size % 5 <> 0").select(F.col("conv_id").alias("conv"), "turn", said.alias("text"), (F.col("turn") * 60 + F.col("size") % 150).alias("opened_at"))
    ends = log.groupBy(F.col("conv_id").alias("conv")).agg((F.max("turn") * 60 + 30).alias("ended_at"))
    return transcripts.aligned_turns(mirror, native, ends)


def _messages(spark, sf_dir):
    """Turns as messages: text, an image, or what a tool gave back, by what they hold."""
    log = corpus.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), "role", F.coalesce("text", F.lit("")).alias("text"))
    text = F.struct(F.lit("text").alias("type"), F.col("text"))
    image = F.struct(F.lit("image").alias("type"), F.struct(F.lit("base64").alias("type"), F.when(F.char_length("text") % 2 == 0, "image/png").alias("media_type"), F.md5("text").alias("data")).alias("source"))
    linked = F.struct(F.lit("input_image").alias("type"), F.concat(F.lit("data:,"), F.md5("text")).alias("image_url"))
    inner = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    told = lambda content: F.concat(F.lit('{"type":"tool_result","content":'), content, F.lit("}"))
    a, b, c = (F.to_json(x) for x in (text, image, linked))
    content = F.when(F.col("role") == "user", inner(a, b)).when(F.char_length("text") % 3 == 0, inner(told(inner(c, told(inner(b)), a)), c)).otherwise(inner(a))
    return log.select("doc", F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), content, F.lit("}")).alias("json"))


def nested_strings(spark, sf_dir):
    """All strings of all messages and of the properties of events; texts as digests."""
    events = corpus.table(spark, sf_dir, "events").select(F.concat(F.lit("event-"), "event_id").alias("doc"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), F.coalesce("props", F.lit("null")), F.lit("}")).alias("json"))
    return transcripts.nested_strings(transcripts.parsed(_messages(spark, sf_dir).union(events))).withColumn("text", F.md5("text"))


def message_attachments(spark, sf_dir):
    """The images of all messages."""
    records = transcripts.parsed(_messages(spark, sf_dir))
    return transcripts.attachments(records.select("doc", F.try_variant_get("value", "$.content", "variant").alias("value")))


QUERIES = {f.__name__: f for f in (turn_alignment, nested_strings, message_attachments)}

_MESSAGES = r"""l AS (SELECT conv_id || '-' || turn AS doc, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, json_object('type', 'text', 'text', text) AS a, CASE WHEN length(text) % 2 = 0 THEN json_object('type', 'image', 'source', json_object('type', 'base64', 'media_type', 'image/png', 'data', md5(text)))
  ELSE json_object('type', 'image', 'source', json_object('type', 'base64', 'data', md5(text))) END AS b, json_object('type', 'input_image', 'image_url', 'data:,' || md5(text)) AS c FROM l),
m AS (SELECT doc, json_object('role', role, 'content', CASE WHEN role = 'user' THEN json_array(a, b) WHEN length(text) % 3 = 0
  THEN json_array(json_object('type', 'tool_result', 'content', json_array(c, json_object('type', 'tool_result', 'content', json_array(b)), a)), c) ELSE json_array(a) END) AS js FROM p)"""
ORACLES = {
    "turn_alignment": r"""WITH RECURSIVE l AS (SELECT *, length(coalesce(text, '')) AS size FROM conversations),
n AS (SELECT conv_id AS conv, turn, lower(trim(regexp_replace(coalesce(CASE WHEN size % 2 = 0 THEN string_split(text, '.')[1] ELSE text END, ''), '\s+', ' ', 'g'))) AS text, turn * 60 + size % 150 AS opened, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM l WHERE role = 'user' AND size % 5 <> 0),
m AS (SELECT conv_id AS conv, turn, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text, turn * 60 AS opened, row_number() OVER w - 1 AS i, coalesce(lead(turn * 60) OVER w, (SELECT max(z.turn) * 60 + 30 FROM conversations z WHERE z.conv_id = l.conv_id)) AS ends
  FROM l WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT m.conv, m.i, m.turn, n.j, n.turn AS native, CASE WHEN m.text = '' OR n.text = '' THEN 0 WHEN m.text = n.text THEN 100 WHEN contains(m.text, n.text) OR contains(n.text, m.text) THEN 60 ELSE 0 END
  + CASE WHEN n.opened >= m.opened THEN 20 ELSE 0 END + CASE WHEN n.opened < m.ends THEN 20 ELSE 0 END + CASE WHEN m.i = n.j THEN 5 ELSE 0 END AS score FROM m JOIN n USING (conv)),
k AS (SELECT conv, i, any_value(turn) AS turn, list({'score': score, 'j': j, 'native': native} ORDER BY score DESC, j) AS cands FROM s WHERE score > 0 GROUP BY conv, i),
t AS (SELECT conv, list({'i': i, 'turn': turn, 'cands': cands} ORDER BY i) AS steps FROM k GROUP BY conv),
w AS (SELECT conv, steps, 0 AS done, []::BIGINT[] AS used, NULL::BIGINT AS turn, NULL::BIGINT AS native, NULL::BIGINT AS score FROM t
  UNION ALL SELECT conv, steps, done + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, steps[done + 1].turn, best.native, best.score FROM (SELECT *, list_filter(steps[done + 1].cands, lambda c: NOT list_contains(used, c.j))[1] AS best FROM w WHERE done < len(steps)))
SELECT conv, turn AS mirror_turn, native AS native_turn, score FROM w WHERE native IS NOT NULL""",
    "nested_strings": f"""WITH {_MESSAGES}, r AS (SELECT * FROM m UNION ALL SELECT 'event-' || event_id, json_object('type', event_type, 'props', coalesce(props, 'null')::JSON) FROM events)
SELECT r.doc, t.fullkey AS path, md5(t.atom ->> '$') AS text FROM r, json_tree(r.js) t WHERE t.type = 'VARCHAR'""",
    "message_attachments": f"""WITH RECURSIVE {_MESSAGES}, v AS (SELECT doc, []::BIGINT[] AS place, json_extract(js, '$.content') AS x FROM m
  UNION ALL SELECT v.doc, CASE WHEN json_type(v.x) = 'ARRAY' THEN list_append(v.place, i) ELSE v.place END, CASE WHEN json_type(v.x) = 'ARRAY' THEN json_extract(v.x, '$[' || i || ']') ELSE json_extract(v.x, '$.content') END
    FROM v, LATERAL (SELECT unnest(range(CASE WHEN json_type(v.x) = 'ARRAY' THEN json_array_length(v.x) WHEN v.x ->> '$.type' = 'tool_result' THEN 1 ELSE 0 END::BIGINT)) AS i))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY place) AS attachment, coalesce(x ->> '$.image_url', 'data:' || coalesce(x ->> '$.source.media_type', 'application/octet-stream') || ';base64,' || (x ->> '$.source.data')) AS image_url
FROM v WHERE json_type(x) = 'OBJECT' AND x ->> '$.type' IN ('image', 'input_image')""",
}
