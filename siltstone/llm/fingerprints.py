"""Canonical exact digests of documents, with DataFrame functions only.

The canonical text is compatibility-composed (NFKC), case-folded, composed again, and its runs of white space are single spaces. The
fingerprint is two 64-bit xxhashes of it with different seeds, in hexadecimal. Documents with the same 128 bits fall in one bucket; inside
it canonical texts are compared byte by byte. Different texts in a bucket would get a suffix: -1, -2, ... in the order of
their smallest doc_id. Likeness of two fingerprints is 1.0 if they are equal, else 0.0.

Null text is the empty text. Equal texts have equal fingerprints. A document's *next* is the one with the largest smaller id, after the smallest
id the one with the largest. Rows that repeat an id share their neighbours; where the next id has several texts, the least one is taken.
Rows with a null id have no next: their edited text is their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import text_or_empty, written

#: Bits of an id below each level of the tree that finds neighbours: at most 1024 ids, then at most 2**18 nodes, stand under a node.
LEVELS = (10, 28, 46, 63)
SALTS = 16


def canonical(text: Column) -> Column:
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)


def as_text(h1: Column, h2: Column, suffix: Column) -> Column:
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(h1), half(h2), F.when(suffix > 0, F.concat(F.lit("-"), suffix.cast("string"))).otherwise(F.lit("")))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id) to (doc_id, next_id) for all distinct ids that are not null, without a window over all rows.

    Ids are the leaves of a tree of ranges. A node's children are ordered by one bounded window; each but the last child ends where its
    neighbour begins. The last ones are settled a level further up, and at the top the smallest id meets the largest.
    """
    nodes = ids.where("doc_id is not null").distinct().select(F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))
    links = None
    for bits in LEVELS:
        group = F.shiftright("low", bits)
        order = Window.partitionBy("_group").orderBy(F.desc("high"))
        found = nodes.withColumn("_group", group).withColumn("next_id", F.lead("high").over(order)).where("next_id is not null").select(F.col("low").alias("doc_id"), "next_id")
        links = found if links is None else links.union(found)
        nodes = written(nodes.groupBy(group.alias("_group")).agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_group"), "nodes")
    # two nodes at most: ids below zero, and the others
    ends = nodes.agg(F.max("low").alias("upper"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.min("high").alias("lower")).where("lowest is not null")
    top = ends.select(F.explode(F.array(F.struct(F.col("lowest").alias("doc_id"), F.col("highest").alias("next_id")), F.struct(F.when(F.col("upper") > F.col("lowest"), F.col("upper")).alias("doc_id"), F.col("lower").alias("next_id")))).alias("x")).select("x.*").where("doc_id is not null")
    return links.union(top)


def suffixes(hashes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Byte comparison inside buckets: (h1, h2, canon, suffix) of the texts that are not the first of their bucket; None without any."""
    shared = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    # a bucket may hold a third of all documents: its members are dealt by id as well
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    salted = shared.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    members = hashes.where("doc_id is not null").select("doc_id", "h1", "h2", salt).join(salted, ["h1", "h2", "salt"])
    members = members.select(F.col("doc_id").alias("member"), "h1", "h2", "salt").distinct().drop("salt")
    bodies = texts.join(members, texts["doc_id"] == members["member"]).select("doc_id", "h1", "h2", canonical(F.col("text")).alias("canon"))
    distinct = bodies.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("least"))
    ranked = distinct.withColumn("suffix", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("least")) - 1)
    several = written(ranked.where("suffix > 0").drop("least"), "collisions")
    return None if several.isEmpty() else several


def fingerprints(docs: DataFrame, hashed=wide_hash) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_chars, fingerprint, class_id, copies).

    class_id is the smallest doc_id with the same canonical text, copies the number of rows that have it.
    """
    return _own(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), hashed)[1].drop("h1", "h2", "suffix", "raw")


def _own(docs: DataFrame, hashed) -> tuple[DataFrame, DataFrame]:
    h1, h2 = hashed(F.col("canon"))
    raw = F.unhex(F.sha2("text", 256)).alias("raw")  # tells texts of one id and one canonical form apart
    hashes = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), raw, canonical(F.col("text")).alias("canon")).select("doc_id", "n_chars", "raw", h1.alias("h1"), h2.alias("h2"))
    hashes = written(hashes, "hashes")
    several = suffixes(hashes, docs.where("doc_id is not null"))
    if several is None:
        own = hashes.withColumn("suffix", F.lit(0))
    else:
        canon = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), raw, canonical(F.col("text")).alias("canon")).select("doc_id", "n_chars", "raw", "canon", h1.alias("h1"), h2.alias("h2"))
        own = written(canon.join(several, ["h1", "h2", "canon"], "left").select("doc_id", "n_chars", "raw", "h1", "h2", F.coalesce("suffix", F.lit(0)).alias("suffix")), "own")
    classes = own.groupBy("h1", "h2", "suffix").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    full = own.join(classes, ["h1", "h2", "suffix"]).withColumn("fingerprint", as_text(F.col("h1"), F.col("h2"), F.col("suffix")))
    return own, full.select("doc_id", "n_chars", "fingerprint", "class_id", "copies", "h1", "h2", "suffix", "raw")


def edited_fingerprints(docs: DataFrame, hashed=wide_hash) -> DataFrame:
    """``docs`` (doc_id, text) to their fingerprints, and those of the texts whose second half is the beginning of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, copies). An edited text whose
    canonical form is its own document's has the same fingerprint.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own, full = _own(docs, hashed)
    keyed = docs.where("doc_id is not null")
    ring = written(next_ids(own.select("doc_id")), "next")

    # what each document takes over from the next: cut where the next one's text is, then sent
    halves = own.where("doc_id is not null").select("doc_id", F.expr("n_chars div 2").alias("half")).distinct().join(ring, "doc_id").select(F.col("doc_id").alias("taker"), "half", "next_id")
    # texts meet both sides by their id alone, under names of their own, so that they are dealt out once for both joins
    giver = keyed.select(F.col("doc_id").alias("giver"), F.col("text").alias("giver_text"))
    own_text = keyed.select(F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    pieces = giver.join(halves, F.col("giver") == F.col("next_id")).select("taker", "half", F.substring("giver_text", F.lit(1), F.col("half").cast("int")).alias("piece"))
    pieces = pieces.repartition("taker").groupBy("taker", "half").agg(F.min("piece").alias("piece"))
    joined = own_text.join(pieces, (F.col("own_id") == F.col("taker")) & (F.expr("char_length(own_text) div 2") - F.col("half") == 0))
    joined = joined.select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), F.concat(F.expr("substring(own_text, 1, cast(char_length(own_text) - half as int))"), "piece").alias("edited"))
    rows = joined.union(docs.where("doc_id is null").select("doc_id", "text", F.col("text").alias("edited")))

    h1, h2 = hashed(F.col("canon"))
    e1, e2 = hashed(F.col("edited_canon"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("raw"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"))
    rows = rows.select("doc_id", "n_chars", "raw", "edited_sha256", h1.alias("h1"), h2.alias("h2"), e1.alias("e1"), e2.alias("e2"), (F.col("canon") == F.col("edited_canon")).alias("same"))
    edited = written(rows.distinct(), "edited")

    prints = full.select("doc_id", "fingerprint").groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint"))
    following = ring.join(prints.withColumnRenamed("doc_id", "next_id"), "next_id").select(F.col("doc_id").alias("of"), "next_fingerprint")
    out = full.join(edited.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "n_chars", "h1", "h2", "raw")}), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("raw") == F.col("_raw")))
    out = out.join(following, F.col("doc_id") == F.col("of"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint",
        F.when(F.col("same"), F.col("fingerprint")).otherwise(as_text(F.col("e1"), F.col("e2"), F.lit(0))).alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"),
        F.coalesce((F.col("fingerprint") == F.col("next_fingerprint")).cast("double"), F.lit(0.0)).alias("near_next"),
        "class_id", "copies",
    )
