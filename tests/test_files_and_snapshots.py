"""Files with every kind of bytes, snapshots whose writers are killed, builds that compute only what changed."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import builds
from siltstone.sources import files, snapshots


def test_scan_types_and_decoding(spark, tmp_path):
    rng = random.Random(1)
    odd = {f"odd/{i}.txt": bytes(rng.choice([0x41, 0x0A, 0x0D, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 12))) for i in range(150)}
    odd |= {f"good/{i}.md": "".join(rng.choice(["a", "\r\n", "\r", "\n", "é", "\ufeff", "\U0001f600"]) for _ in range(rng.randint(0, 9))).encode() for i in range(60)}
    odd |= {"b/bom.TXT": b"\xef\xbb\xbfx\r\ny", "a b/c d.yml": b"k: v", "a/~$lock.docx": b"x", "a/~$kept.txt": b"x", "a/none": b"x", "a/x.bin": b"x", ".hidden/x.md": b"x", "a/.x.md": b"x", "a/.md": b"x", "a/x.tar.csv": b"1"}
    assert files.write(spark.createDataFrame([*odd.items()], "path string, content binary").repartition(3), str(tmp_path / "in")) == len(odd)
    found = files.typed(files.scan(spark, str(tmp_path / "in")))
    got = {r["path"]: (r["text"], r["warning"]) for r in files.decoded(found).collect()}

    def plain(raw):
        try:
            text = raw.decode().replace("\r\n", "\n").replace("\r", "\n")
            return text.removeprefix("\ufeff"), None
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace"), files.DEGRADED

    gone = {"a/~$lock.docx", "a/none", "a/x.bin", ".hidden/x.md", "a/.x.md", "a/.md"}
    assert got == {p: plain(raw) for p, raw in odd.items() if p not in gone}
    counted = {r["extension"]: r["files"] for r in files.counts(files.scan(spark, str(tmp_path / "in"))).collect()}
    assert len(counted) == len(files.TYPES) and (counted["txt"], counted["md"], counted["yml"], counted["csv"], counted["pdf"]) == (152, 60, 1, 1, 0)
    assert files.scan(spark, str(tmp_path / "nowhere")).collect() == []


def table(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))


def test_publishing_and_pruning(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.pointer(spark, root) is None and snapshots.tables(spark, root) == {} and snapshots.ledger(spark, root).count() == 0
    first = snapshots.publish({"t": table(spark, 10)}, root, "abc" * 10, "2024-01-01")
    second = snapshots.publish({"t": table(spark, 20), "u": table(spark, 0)}, root, "def" * 10, "2024-01-02", "changed")
    assert snapshots.pointer(spark, root)["snapshot_id"] == second != first
    assert {k: v.count() for k, v in snapshots.tables(spark, root).items()} == {"t": 20, "u": 0}
    assert os.listdir(f"{root}/snapshots") == [second]
    assert sorted((r["snapshot_id"], r["cause"]) for r in snapshots.ledger(spark, root).collect()) == sorted([(first, ""), (second, "changed")])
    listed = snapshots.manifest(spark, root)["tables"]["t"]
    assert (listed["rows"], listed["digest"]) == snapshots.measured(table(spark, 20).repartition(5))
    assert snapshots.measured(table(spark, 20).repartition(5)) != snapshots.measured(table(spark, 20).withColumn("id", F.col("id") + 1))


@pytest.mark.parametrize("where", ["measured", "write_text", "_switch", "_record", "_prune"])
def test_a_writer_that_is_killed_leaves_a_readable_version(spark, tmp_path, monkeypatch, where):
    root = str(tmp_path)
    first = snapshots.publish({"t": table(spark, 10)}, root, "abc", "2024-01-01")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, where, killed)
        with pytest.raises(KeyboardInterrupt):
            snapshots.publish({"t": table(spark, 11)}, root, "def", "2024-01-02")
    switched = where in ("_record", "_prune")
    assert snapshots.tables(spark, root)["t"].count() == (11 if switched else 10)
    assert (snapshots.pointer(spark, root)["snapshot_id"] == first) != switched
    last = snapshots.publish({"t": table(spark, 12)}, root, "ghi", "2024-01-03")
    assert snapshots.tables(spark, root)["t"].count() == 12 and last in {r[0] for r in snapshots.ledger(spark, root).select("snapshot_id").collect()}
    assert snapshots.ledger(spark, root).count() == (3 if switched else 2) and snapshots.ledger(spark, root).where("backfilled").count() == (where == "_record")
    assert len(os.listdir(f"{root}/snapshots")) == (2 if where == "_switch" else 1)


def test_builds_compute_only_what_changed(spark):
    root, seen = tempfile.mkdtemp(), []
    contract = ["words", "size"]

    def compute(rows):
        seen.append(sorted(r[0] for r in rows.select("source_id").collect()))
        kinds = F.array(F.struct(F.lit("words").alias("kind"), F.size(F.split(F.trim("text"), " ")).cast("string").alias("content")), F.struct(F.lit("size").alias("kind"), F.char_length(F.trim("text")).cast("string").alias("content")))
        return rows.select("source_id", F.explode(kinds).alias("k")).select("source_id", "k.*")

    def fold(rows):
        seen.append(sorted({r[0] for r in rows.select("root").collect()}))
        return rows.where("kind = 'size'").groupBy("root").agg(F.sum(F.col("content").cast("long")).cast("string").alias("value"))

    def build(texts, at):
        seen.clear()
        df = spark.createDataFrame([(i, r, t) for i, (r, t) in texts.items()], "source_id string, root string, text string").withColumn("fingerprint", F.md5("text"))
        states, roots = builds.rebuilt(df, root, contract, compute, fold, at)
        return {r["source_id"]: r["status"] for r in states.collect()}, {r["root"]: (r["value"], r["status"]) for r in roots.collect()}

    texts = {"a": ("x", "one two"), "b": ("x", "three"), "c": ("y", "four"), "d": ("z", "five")}
    states, roots = build(texts, "1")
    assert set(states.values()) == {"added"} and roots == {"x": ("12", "rebuilt"), "y": ("4", "rebuilt"), "z": ("4", "rebuilt")} and seen == [["a", "b", "c", "d"], ["x", "y", "z"]]
    states, roots = build(texts, "2")
    assert set(states.values()) == {"reused"} and {s for _, s in roots.values()} == {"reused"} and seen == [[], []]
    states, roots = build(texts | {"b": ("x", "three more")}, "3")
    assert states == {"a": "reused", "b": "rebuilt", "c": "reused", "d": "reused"} and seen == [["b"], ["x"]] and roots["x"] == ("17", "rebuilt")
    states, roots = build({"a": ("x", "one two "), "b": ("x", "three more"), "c": ("y", "four")}, "4")
    assert states == {"a": "stable", "b": "reused", "c": "reused"} and seen == [["a"], []] and sorted(roots) == ["x", "y"]
    # the contract asks for more than the last build has
    contract = ["words", "size", "third"]
    assert set(build({"c": ("y", "four")}, "5")[0].values()) == {"stable"} and seen == [["c"], []]
