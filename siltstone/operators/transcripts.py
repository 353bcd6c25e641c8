"""Logs of the same conversations from two sides: which turn is which, and what nested messages hold.

JSON needs no schema: it is parsed to VARIANT and walked in rounds, each of which opens the arrays and objects that the round before found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import W
from siltstone.storage import settled

#: What equal and contained texts, times after the opening and before the end, and equal places count.
SAME, PART, AFTER, BEFORE, PLACE = 100, 60, 20, 20, 5


def matching(text: Column) -> Column:
    """A text in lower case with single spaces; null counts as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{W}+", " ")))


def aligned_turns(mirror: DataFrame, native: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv, mirror_turn, native_turn, score): each turn of ``mirror`` with the turn of ``native`` that suits it best among those that earlier turns have left.

    Both: conv, turn, text, opened_at; ``ends``: conv, ended_at (one row each). A turn's window lasts until the next mirror turn opens, the last one's until the conversation ends. Of equal scores the first
    native turn is taken; a turn that nothing suits has no row. Null times suit nothing. A conversation is folded in one row, turn by turn.
    """

    def listed(turns: DataFrame, name: str) -> DataFrame:
        row = F.struct("turn", matching(F.col("text")).alias("text"), F.col("opened_at"))
        return turns.where("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias(name))

    both = listed(mirror, "mirror").join(listed(native, "native"), "conv").join(ends.select("conv", "ended_at"), "conv", "left")
    following = F.transform("mirror", lambda m, i: F.struct(m["turn"].alias("turn"), m["text"].alias("text"), m["opened_at"].alias("opened_at"), i.alias("i"), F.when(i + 1 < F.size("mirror"), F.get("mirror", i + 1)["opened_at"]).otherwise(F.col("ended_at")).alias("ends")))
    both = both.select("conv", following.alias("mirror"), F.transform("native", lambda n, j: F.struct(n["text"].alias("text"), n["opened_at"].alias("opened_at"), j.alias("j"))).alias("native"), F.transform("native", lambda n: n["turn"]).alias("native_turns"))

    def score(m: Column, n: Column) -> Column:
        worded = (m["text"] != "") & (n["text"] != "")
        text = F.when(worded & (m["text"] == n["text"]), SAME).when(worded & (m["text"].contains(n["text"]) | n["text"].contains(m["text"])), PART).otherwise(0)
        return text + F.when(n["opened_at"] >= m["opened_at"], AFTER).otherwise(0) + F.when(n["opened_at"] < m["ends"], BEFORE).otherwise(0) + F.when(m["i"] == n["j"], PLACE).otherwise(0)

    def taken(so_far: Column, m: Column) -> Column:
        free = F.filter("native", lambda n: ~F.exists(so_far, lambda x: x["j"] == n["j"]))
        best = F.array_max(F.transform(free, lambda n: F.struct(score(m, n).alias("score"), (-n["j"]).alias("j"))))
        return F.when(best["score"] > 0, F.concat(so_far, F.array(F.struct(m["turn"].alias("turn"), (-best["j"]).alias("j"), best["score"].alias("score"))))).otherwise(so_far)

    turn = mirror.schema["turn"].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<turn: {turn}, j: int, score: int>>")
    pairs = both.select("conv", "native_turns", F.explode(F.aggregate("mirror", nothing, taken)).alias("p"))
    return pairs.select("conv", F.col("p.turn").alias("mirror_turn"), F.get("native_turns", F.col("p.j")).alias("native_turn"), F.col("p.score").alias("score"))


def parsed(records: DataFrame) -> DataFrame:
    """``records`` (doc, json) to (doc, value): VARIANT; texts that are no JSON are left out."""
    return records.select("doc", F.try_parse_json("json").alias("value")).where("value is not null")


def _kind(value: str = "value") -> Column:
    """STRING, ARRAY, OBJECT or what else a value is."""
    return F.regexp_extract(F.schema_of_variant(F.col(value)), "^[A-Z]+", 0)


def nested_strings(records: DataFrame) -> DataFrame:
    """(doc, path, text) of all strings in the values of ``records`` (doc, value: VARIANT), at any depth; names of fields are no strings of their values."""
    spark, found = records.sparkSession, []
    open_ = records.select("doc", F.lit("$").alias("path"), "value")
    while True:
        open_ = settled(open_.withColumn("kind", _kind()))
        found.append(open_.where("kind = 'STRING'").select("doc", "path", F.variant_get("value", "$", "string").alias("text")))
        inner = open_.where("kind in ('ARRAY', 'OBJECT')")
        if inner.isEmpty():
            return reduce(DataFrame.union, found)
        open_ = spark.sql("SELECT t.doc, t.path || CASE WHEN v.key IS NULL THEN '[' || v.pos || ']' ELSE '.' || v.key END AS path, v.value FROM {inner} t, LATERAL variant_explode(t.value) v", inner=inner)


def text_at(path: str) -> Column:
    """The string at a path; null if there is something else, or the empty string."""
    there = F.try_variant_get("value", path, "variant")
    text = F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get("value", path, "string"))
    return F.nullif(text, F.lit(""))


def image_url() -> Column:
    """Where an image's data are: its own address, else its source as a data URL."""
    media = F.coalesce(text_at("$.source.media_type"), text_at("$.media_type"), F.lit("application/octet-stream"))
    inline = F.when(text_at("$.source.type") == "base64", F.concat(F.lit("data:"), media, F.lit(";base64,"), text_at("$.source.data")))
    linked = F.when((text_at("$.source.type") == "url") & F.startswith(text_at("$.source.url"), F.lit("data:")), text_at("$.source.url"))
    return F.coalesce(text_at("$.image_url"), inline, linked)


def attachments(messages: DataFrame) -> DataFrame:
    """(doc, attachment, image_url) of the images in ``messages`` (doc, value: the content as VARIANT), numbered from 1 in the order of the content.

    Lists are opened, and what tools gave back, at any depth; other objects are not.
    """
    spark, found = messages.sparkSession, []
    open_ = messages.select("doc", F.array().cast("array<int>").alias("at"), "value")
    while True:
        open_ = settled(open_.withColumn("kind", _kind()).where("kind in ('ARRAY', 'OBJECT')"))
        if open_.isEmpty():
            break
        objects = open_.where("kind = 'OBJECT'").withColumn("type", text_at("$.type"))
        found.append(objects.where("type in ('image', 'input_image')").select("doc", "at", image_url().alias("image_url")).where("image_url is not null"))
        told = objects.where("type = 'tool_result'").select("doc", "at", F.try_variant_get("value", "$.content", "variant").alias("value")).where("value is not null")
        items = spark.sql("SELECT t.doc, concat(t.at, array(v.pos)) AS at, v.value FROM {lists} t, LATERAL variant_explode(t.value) v", lists=open_.where("kind = 'ARRAY'"))
        open_ = told.union(items)
    if not found:
        return messages.select("doc", F.lit(0).alias("attachment"), F.lit("").alias("image_url")).limit(0)
    every = reduce(DataFrame.union, found)
    return every.withColumn("attachment", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).select("doc", "attachment", "image_url")
