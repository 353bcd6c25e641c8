from pyspark.sql import functions as F

from siltstone.operators import interactions
from siltstone.streaming import turns as streams


def run(spark, out, name, mode="append"):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name)


def test_closed_turns_are_those_of_the_batch(spark, sf_dir, tmp_path):
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text", F.timestamp_seconds(1_700_000_000 + F.col("turn")).alias("at"))
    nulls = spark.createDataFrame([(-1, 1, "user", None, 1), (-1, 2, "assistant", None, 2), (-1, 3, "user", "x", 3), (None, 1, "user", "x", 1)], "conv_id long, turn long, role string, text string, at long")
    log = log.union(nulls.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("at"))))
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    got = run(spark, streams.turns(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))), "turns")
    log = log.where("conv_id is not null").drop("at")
    last = interactions.turns(log).groupBy("conv_id").agg(F.max("turn_no").alias("last"))
    want = interactions.turns(log).join(last, "conv_id").where("turn_no < last")
    key = ["conv_id", "turn_no", "opened", "closed", "answers", "n_chars", "closure"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_silence_closes_a_turn(spark, tmp_path):
    rows = [(1, 1, "user", "a", 0), (1, 2, "assistant", "b", 5), (2, 1, "user", "c", 10), (3, 1, "user", "d", 5000), (3, 2, "user", "e", 9000)]
    for n, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string, at long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("at"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        schema = spark.read.parquet(str(tmp_path / "log")).schema
        out = streams.turns(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), n
    got = sorted((r["conv_id"], r["turn_no"], r["closure"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, "completed"), (2, 1, "open"), (3, 1, "superseded")]


def test_activity_and_settlement(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.union(events).repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    assert run(spark, streams.settled_once(stream, "ts", ["event_id"]), "settled").count() == events.count()
    got = run(spark, streams.activity(stream, "ts"), "activity", "complete")
    want = events.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg((2 * F.count("*")).alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
