"""Folders of files as a source: a recursive scan, the registry of file types, decoding with its warnings as data; and a writer of single files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.snapshots import exists

#: Extensions, their document types, and those whose files an office program locks by a file named ~$...
TYPES = {
    "pdf": "pdf", "pptx": "pptx", "ppt": "pptx", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "md": "markdown", "markdown": "markdown", "txt": "plaintext", "eml": "email",
    "mdx": "mdx", "yaml": "yaml", "yml": "yaml", "tex": "tex", "csv": "csv", "tsv": "tsv",
}
OFFICE = ["pptx", "ppt", "docx", "doc", "xlsx", "xls"]
FIRST_CLASS = ["pdf", "pptx", "docx", "xlsx", "markdown", "plaintext", "email"]
DEGRADED = "Source text required replacement decoding; some characters may be degraded."


def extension(path: Column) -> Column:
    """The extension of a path's name in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1))


def typed(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with document_type and tier; those of no known type, and locks of office programs, go."""
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    lock = extension(F.col("path")).isin(OFFICE) & F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("~$"))
    kind = F.try_element_at(known, extension(F.col("path")))
    rows = files.withColumn("document_type", kind).where(F.col("document_type").isNotNull() & ~lock)
    return rows.withColumn("tier", F.when(F.col("document_type").isin(FIRST_CLASS), "first-class").otherwise("lightweight-compatible"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_size, modified, content) of all files beneath ``folder``, paths relative to it; none if it is not there.

    Files and folders whose names begin with a dot are hidden; so are, to Spark's readers, names that begin with an underscore. A file is one row, of 2 GB at most;
    empty ones come without their time.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, file_size long, modified timestamp, content binary")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # the reader leaves out files of no bytes; its index, which the driver holds anyway, names them
    named = raw.inputFiles()
    if len(named) > raw.select("path").count():
        every = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(x)),) for x in named], "path string")
        empty = every.join(raw.select("path"), "path", "left_anti")
        raw = raw.unionByName(empty.withColumns({"modificationTime": F.lit(None).cast("timestamp"), "length": F.lit(0).cast("long"), "content": F.lit("").cast("binary")}))
    return raw.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """``files`` (content, ...) with ``text`` and ``warning`` in place of the content.

    UTF-8 is read without its byte order mark, and all line ends become line feeds. What is no UTF-8 is read with U+FFFD for each faulty part, as it stands, and has a warning.
    """
    raw = F.col("content").cast("string")
    fine = F.is_valid_utf8(raw)
    text = F.replace(F.replace(F.regexp_replace(raw, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return files.withColumns({"text": F.when(fine, text).otherwise(F.make_valid_utf8(raw)), "warning": F.when(~fine, DEGRADED)}).drop("content")


def counts(files: DataFrame) -> DataFrame:
    """(extension, files): how many files of each known extension there are, zeros included."""
    every = files.sparkSession.createDataFrame([(e,) for e in TYPES], "extension string")
    found = typed(files).groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))
    return every.join(found, "extension", "left").select("extension", F.coalesce("files", F.lit(0)).alias("files"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                parent, _, name = f"{top}/{path}".rpartition("/")
                store.create_dir(parent, recursive=True)
                own = f"{parent}/.{name}-{uuid.uuid4().hex[:8]}"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(content.as_py() or b"")
                store.move(own, f"{parent}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    return run


def write(files: DataFrame, folder: str) -> int:
    """Write each row of ``files`` (path, content) as a file beneath ``folder``; how many. A file appears under its name when it is whole, so a task that runs twice does no harm."""
    return files.select("path", "content").mapInArrow(_writer(folder), "path string").count()
