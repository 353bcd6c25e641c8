"""Token counts with a digest cache.

The cache is a Parquet table (content, tokenizer: digests; n_tokens). Counting joins the digests of texts to it; only distinct texts that
it lacks for this tokenizer are encoded, and their counts are appended. The tokenizer's digest is that of its file, so another version
never meets the counts of this one. Content is normalised only in ways that no tokenizer can see: null becomes the empty text, and the digest is
taken of the UTF-8 bytes. (White space and case change counts and are kept.)

An append that is cut off leaves no rows, as Parquet writers commit whole jobs; one that is repeated leaves a text twice with the
same count, which reading evens out. Empty tables give no rows; rows that repeat are counted each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import slices, small_batches, text_or_empty

CACHE = "content binary, tokenizer binary, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to their token counts, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(x, add_special_tokens=False)) for x in texts]


def tokenizer_digest(path: str) -> bytes:
    return hashlib.sha256(Path(path).read_bytes()).digest()


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(count(part.column("text").to_pylist()), pa.int64())], ["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache in ``folder``; empty if nothing has been written there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit); ``cache`` is the folder of the cache."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    version = tokenizer_digest(path)
    keyed = docs.select("doc_id", text_or_empty().alias("text"), F.unhex(F.sha2(text_or_empty(), 256)).alias("content"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == F.lit(version)).select("content").distinct()

    # one row stands for each text; null ids stand after all others
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    missing = keyed.groupBy("content").agg(F.min(order).alias("first")).join(known, "content", "left_anti")
    missing = missing.select(F.col("content").alias("missed"), F.coalesce("first.doc_id", F.lit(0)).alias("first_id"), "first.no_id")
    texts = keyed.join(missing, (F.coalesce("doc_id", F.lit(0)) == F.col("first_id")) & (F.col("content") == F.col("missed")) & (F.col("doc_id").isNull() == F.col("no_id")))
    counted = texts.select("content", "text").mapInArrow(_encoded(path), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).where(F.col("tokenizer") == F.lit(version)).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
