"""Publishing snapshots of tables: versioned folders, manifests, a pointer that is switched at once, a ledger.

A snapshot is written beside the published ones and read back for its manifest (rows and a digest of each table). It is moved into place, the pointer file is replaced by one rename, a record
goes to the ledger, and snapshots that were published before go. A writer that is killed before the switch has changed nothing that readers see; one that is killed after it leaves a
snapshot without a record, which the next one adds. Readers follow the pointer. Snapshots that no record names and no pointer points to are left alone: another writer may be at work on them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "snapshot_id string, published_at string, signature string, cause string, backfilled boolean"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then put it in place of what is there by one rename."""
    store, at = _store(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = store.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = store.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path))
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(at), target, how)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def measured(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a digest that doesn't depend on their order: the sum of 60 bits of each row's MD5."""
    row = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns))
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)"))).first()
    return rows, str(int(total))


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What the pointer of ``root`` says; None before the first publication."""
    return json.loads(read_text(spark, f"{root}/current.json")) if exists(spark, f"{root}/current.json") else None


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """All records of publications."""
    return spark.read.schema(LEDGER).json(f"{root}/ledger") if exists(spark, f"{root}/ledger") else spark.createDataFrame([], LEDGER)


def _record(spark: SparkSession, root: str, head: dict, backfilled: bool) -> None:
    write_text(spark, f"{root}/ledger/{head['snapshot_id']}.json", json.dumps({k: head[k] for k in ("snapshot_id", "published_at", "signature", "cause")} | {"backfilled": backfilled}))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the published snapshot."""
    now = pointer(spark, root)
    return json.loads(read_text(spark, f"{root}/snapshots/{now['snapshot_id']}/manifest.json")) if now else None


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published tables by name; none before the first publication."""
    now = manifest(spark, root)
    return {name: spark.read.schema(t["schema"]).parquet(f"{root}/snapshots/{now['snapshot_id']}/{name}") for name, t in now["tables"].items()} if now else {}


def _switch(spark: SparkSession, root: str, head: dict) -> None:
    write_text(spark, f"{root}/current.json", json.dumps(head))


def _prune(spark: SparkSession, root: str, keep: set[str]) -> None:
    for r in ledger(spark, root).select("snapshot_id").distinct().toLocalIterator():
        if r[0] not in keep:
            store, at = _store(spark, f"{root}/snapshots/{r[0]}")
            store.delete(at, True)


def publish(frames: dict[str, DataFrame], root: str, signature: str, published_at: str, cause: str = "", keep_last: int = 0) -> str:
    """Publish ``frames`` (at least one, by name) as the current snapshot of ``root``; its id. Of those before, ``keep_last`` (0 or 1) stays readable for those who still read it."""
    spark = next(iter(frames.values())).sparkSession
    last = pointer(spark, root)
    known = {r[0] for r in ledger(spark, root).select("snapshot_id").where(F.col("snapshot_id") == (last or {}).get("snapshot_id", "")).collect()}
    if last and last["snapshot_id"] not in known:
        _record(spark, root, last, True)
    head = {"snapshot_id": f"{signature[:12]}-{uuid.uuid4().hex[:12]}", "published_at": published_at, "signature": signature, "cause": cause}
    staging, listed = f"{root}/.staging-{head['snapshot_id']}", {}
    for name, df in frames.items():
        df.write.parquet(f"{staging}/{name}")
        rows, digest = measured(spark.read.schema(df.schema).parquet(f"{staging}/{name}"))
        listed[name] = {"rows": rows, "digest": digest, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    write_text(spark, f"{staging}/manifest.json", json.dumps(head | {"tables": listed}))
    store, at = _store(spark, staging)
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots"))
    if not store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/{head['snapshot_id']}")):
        raise OSError(f"could not move {staging}")
    _switch(spark, root, head)
    _record(spark, root, head, False)
    _prune(spark, root, {head["snapshot_id"], *([last["snapshot_id"]] if last and keep_last else [])})
    return head["snapshot_id"]
