"""What the operators of this subpackage share: intermediate tables and Arrow batch limits.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every executor of a cluster can read, so a lost
executor costs only the tasks that it was running.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of our own if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/siltstone-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and its lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more.

    The shuffle files of finished plans go as well: Spark removes them when the driver's garbage is collected, which it asks for here.
    """
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    for df in tables[:1]:
        df.sparkSession._jvm.System.gc()


def forget(df: DataFrame, name: str) -> None:
    """Take the table of ``bucketed`` out of the catalog; its files stay for plans that read them."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, bucketed by ``key`` (later joins by it don't shuffle this side again), and its name for ``forget``."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table), table


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(texts: pa.Array, most: int = 1 << 20):
    """Ranges (from, to) of rows whose texts have about ``most`` bytes together; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and the offsets of the rows; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]
