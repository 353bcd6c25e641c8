"""Queries on logs. Events stand for sessions (a user and a day are a conversation and its turn), conversations for turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens, tokens
from siltstone.operators import logs
from siltstone.sources import corpus


def _events(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    return events.withColumns({"conv_id": F.col("user_id"), "turn": F.dayofmonth("ts").cast("long") % 8, "k": F.get_json_object("props", "$.k").cast("long"), "hour": F.hour("ts").cast("long")})


def frequent_sources(spark, sf_dir):
    used = _events(spark, sf_dir).where("event_type in ('view', 'click')").select(F.concat(F.lit("doc-"), "k").alias("source_id"))
    return logs.top_counts(used, "source_id")


def failure_patterns(spark, sf_dir):
    failed = _events(spark, sf_dir).where("event_type = 'error'")
    return logs.failure_patterns(failed, ["hour"], "event_id", "ts")


def orphan_sessions(spark, sf_dir):
    """Events of conversations and turns that were not held, counted by type."""
    turns = corpus.table(spark, sf_dir, "conversations")
    return logs.orphans(_events(spark, sf_dir), turns, ["conv_id", "turn"]).groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("conv_id").alias("conversations"), F.max("event_id").alias("last_event"))


def benchmark_candidates(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, 3).otherwise(2)).otherwise(1).cast("long")
    rows = _events(spark, sf_dir).where("event_type in ('error', 'signup')").select(F.col("conv_id").alias("conversation"), "event_id", severity.alias("severity"), F.concat_ws("-", "event_type", "hour").alias("reason"))
    return logs.candidates(rows)


def answer_history(spark, sf_dir):
    return logs.history(corpus.table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("text").alias("question"), "answer_turn")


def warm_start(spark, sf_dir):
    questions = corpus.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") % 4).alias("domain"), F.array_distinct(tokens(F.col("text"))).alias("words"))
    return logs.warm_starts(questions).withColumn("place", F.col("place").cast("long"))


def ledger_latest(spark, sf_dir):
    """The last event of each user and type."""
    return logs.latest(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def phase_costs(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    return logs.phase_costs(events, 36000)


def daily_activity_dedup(spark, sf_dir):
    """The first event of each day, user and type: later ones are ignored."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return _events(spark, sf_dir).groupBy(day.alias("event_day"), "user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("tries"))


def release_upsert(spark, sf_dir):
    """Orders of even keys are the table, those of odd keys with the number halved the updates: new values win, missing ones keep the old."""
    orders = corpus.table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("channel"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("asset"))
    new = orders.where("o_orderkey % 2 = 1").select((F.col("o_orderkey") - 1).alias("channel"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("version"), F.col("o_orderpriority").alias("asset"))
    both = old.alias("o").join(new.alias("n"), "channel", "full")
    return both.select("channel", F.coalesce("n.version", "o.version").alias("version"), F.coalesce("n.asset", "o.asset").alias("asset"), F.col("n.asset").isNotNull().alias("touched"))


def phase_profile(spark, sf_dir):
    """Events of a user are a run: what its value says opens or ends a phase."""
    phase = F.element_at(F.array(*map(F.lit, ["detect", "stage", "publish"])), (F.floor("value") % 3 + 1).cast("int"))
    events = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.when(F.floor(F.col("value") * 10) % 2 == 0, "start").otherwise("finish").alias("kind"), phase.alias("phase"))
    return logs.phase_profile(events).withColumn("seconds", F.round("seconds", 6))


QUERIES = {f.__name__: f for f in (frequent_sources, failure_patterns, orphan_sessions, benchmark_candidates, answer_history, warm_start, ledger_latest, phase_costs, phase_profile, daily_activity_dedup, release_upsert)}

_E = "ev AS (SELECT *, user_id AS conv_id, (day(ts) % 8)::BIGINT AS turn, json_extract_string(props, '$.k')::BIGINT AS k, hour(ts)::BIGINT AS hour FROM events)"
ORACLES = {
    "frequent_sources": f"WITH {_E} SELECT 'doc-' || k AS source_id, count(*) AS uses FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1 ORDER BY uses DESC, source_id LIMIT 10",
    "failure_patterns": f"""WITH {_E}, p AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY ts, event_id) AS place FROM ev WHERE event_type = 'error')
SELECT hour, count(*) AS failures, min(event_id) AS first_id, max(event_id) AS last_id, string_agg(event_id::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS examples FROM p GROUP BY hour""",
    "orphan_sessions": f"WITH {_E} SELECT event_type, count(*) AS events, count(DISTINCT conv_id) AS conversations, max(event_id) AS last_event FROM ev ANTI JOIN conversations USING (conv_id, turn) GROUP BY 1",
    "benchmark_candidates": f"""WITH {_E}, r AS (SELECT conv_id AS conversation, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 3 ELSE 2 END ELSE 1 END::BIGINT AS severity, event_type || '-' || hour AS reason FROM ev WHERE event_type IN ('error', 'signup')),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY severity DESC, event_id DESC) AS place FROM r)
SELECT conversation, count(*) AS signals, max(severity) AS severity, max(reason) FILTER (place = 1) AS reason, max(event_id) AS last_event FROM o GROUP BY 1""",
    "answer_history": """SELECT conv_id, turn, md5(text) AS question, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS answer_turn FROM conversations a WHERE role = 'user'""",
    "warm_start": f"""WITH k AS (SELECT conv_id, turn, conv_id % 4 AS domain, unnest(list_distinct({duck_tokens('text')})) AS word FROM conversations WHERE role = 'user'),
m AS (SELECT a.conv_id, a.turn, b.conv_id AS near_conv, b.turn AS near_turn, count(*) AS shared FROM k a JOIN k b ON a.word = b.word AND a.domain = b.domain AND (b.conv_id < a.conv_id OR (b.conv_id = a.conv_id AND b.turn < a.turn)) GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, near_conv DESC, near_turn DESC) AS place FROM m) WHERE place <= 3""",
    "ledger_latest": f"WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM ev) SELECT user_id, event_type, event_id, round(value, 6) AS value FROM o WHERE place = 1",
    "phase_costs": """WITH t AS (SELECT user_id AS run, event_type AS phase, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000 AS taken FROM events)
SELECT run, phase, sum(round(taken * 1000)::BIGINT)::BIGINT AS milliseconds, count(*) AS times FROM t WHERE taken <= 36000 GROUP BY 1, 2""",
    "phase_profile": """WITH RECURSIVE e AS (SELECT user_id AS run, epoch_us(ts) AS at, floor(value * 10)::BIGINT % 2 = 0 AS opens, ['detect', 'stage', 'publish'][floor(value)::BIGINT % 3 + 1] AS phase, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT DISTINCT run, 0::BIGINT AS n, NULL::VARCHAR AS phase, NULL::VARCHAR AS active, NULL::BIGINT AS since, NULL::BIGINT AS taken FROM e
  UNION ALL SELECT e.run, e.n, CASE WHEN NOT opens THEN e.phase END, CASE WHEN opens THEN e.phase WHEN w.active = e.phase THEN NULL ELSE w.active END, CASE WHEN opens THEN e.at WHEN w.active = e.phase THEN NULL ELSE w.since END,
    CASE WHEN NOT opens THEN CASE WHEN w.active = e.phase THEN e.at - w.since ELSE 0 END END FROM w JOIN e ON e.run = w.run AND e.n = w.n + 1)
SELECT run, phase, round(sum(taken) / 1000000, 6)::DOUBLE AS seconds, count(*) AS times FROM w WHERE phase IS NOT NULL GROUP BY run, phase""",
    "daily_activity_dedup": "SELECT strftime(ts, '%Y-%m-%d') AS event_day, user_id, event_type, min(event_id) AS event_id, count(*) AS tries FROM events GROUP BY 1, 2, 3",
    "release_upsert": """WITH o AS (SELECT o_orderkey AS channel, o_orderstatus AS version, o_orderpriority AS asset FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey - 1 AS channel, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS version, o_orderpriority AS asset FROM orders WHERE o_orderkey % 2 = 1)
SELECT channel, coalesce(n.version, o.version) AS version, coalesce(n.asset, o.asset) AS asset, n.asset IS NOT NULL AS touched FROM o FULL JOIN n USING (channel)""",
}
