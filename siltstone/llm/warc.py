"""WARC archives: writing with revisit records, and a reader that salvages damaged ones.

Each record is a gzip member of its own. The writer's tasks roll their archives at ``ROLL`` bytes, write under a temporary name and rename
at the end; the manifest lists what finished tasks have written, so the leavings of lost executors are never read.

The reader checks each member (gzip's checksum), version line, header, content length and block and payload digests. After a failed check it searches on
from the next byte for a gzip member that can be read or for a line with a WARC version that begins a good record, goes on there, and logs the gap:
archive, first byte, end, reason. Memory holds one record and one chunk of the archive.

Null html is an empty payload. Pages without an id sort after all others and refer to none. Rows that repeat an id and payload are all responses. An empty
table writes no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import new_folder, small_batches, written

LEAST, ROLL, CHUNK = 100, 64 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
ROWS = "archive string, start long, end long, kind string, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and the path in it, as Arrow has it: local, HDFS and object stores."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def one_line(value: str) -> str:
    """A header's value without control characters and line separators: these are percent-encoded."""
    return re.sub("[\x00-\x1f\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", one_line(url))] if url is not None else []
    head += [("X-Page-Id", str(page_id))] if page_id is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
        head += [("Content-Type", "application/http; msgtype=response")]
    else:
        head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        store.create_dir(top, recursive=True)
        out, name, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{top}/.{name}", f"{top}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/.{name}", compression=None)
                raw = gzipped(record(page_id, url, (html or "").encode(), digest, refers_to))
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC archives in ``folder``; the manifest (archive, records, bytes).

    Of pages with equal payloads of ``least`` bytes or more the one with the smallest id is the response, the others revisit it.
    """
    small_batches(pages.sparkSession, 200)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    keys = written(pages.select("page_id", "digest", F.octet_length("html").alias("size")), "payloads")
    first = keys.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = keys.join(first, "digest").where("page_id is null or page_id <> first").select(F.col("page_id").alias("again"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()
    marked = pages.join(again, pages["page_id"].eqNullSafe(again["again"]) & (pages["digest"] == again["same"]), "left")
    return written(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder), MANIFEST), "manifest")


class Damaged(Exception):
    pass


class Source:
    """Random reads of one archive, a chunk at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.chunk = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos."""
        if not (self.start <= pos and pos + n <= self.start + len(self.chunk)):
            self.file.seek(pos)
            self.start, self.chunk = pos, self.file.read(max(n, CHUNK))
        return self.chunk[pos - self.start : pos - self.start + n]

    def some(self, pos: int) -> bytes:
        """What the chunk holds from pos, or the next chunk; empty at the end."""
        if not self.start <= pos < self.start + len(self.chunk):
            self.at(pos, CHUNK)
        return self.chunk[pos - self.start :]

    def find(self, pattern: re.Pattern, pos: int) -> int:
        """The first match at or after pos; -1 if there is none."""
        while pos < self.size:
            piece = self.at(pos, CHUNK)
            if m := pattern.search(piece):
                return pos + m.start()
            if pos + len(piece) >= self.size:
                break
            pos += len(piece) - 16  # a match may stand on the border
        return -1


BLANK = re.compile(rb"\r?\n\r?\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")


def headers(raw: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """The header of the record at ``at``, and its length."""
    if not VERSION.match(raw, at):
        raise Damaged("no version line")
    end = BLANK.search(raw, at)
    if not end:
        raise Damaged("header does not end")
    fields = {}
    for line in raw[at : end.start()].split(b"\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").strip(" \t\r").partition(":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip(" \t").lower()] = value.strip(" \t")
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Damaged("header lacks content length or type")
    return fields, end.end() - at


def plain_headers(source: Source, pos: int) -> tuple[dict[str, str], int]:
    """The header of the plain record at pos, however long."""
    n = 1 << 12
    while True:
        raw = source.at(pos, n)
        if len(raw) < n or not VERSION.match(raw) or BLANK.search(raw):
            return headers(raw)
        n *= 4


def checked(fields: dict[str, str], block: bytes) -> dict:
    """A record's row; its digests are tested."""

    def sha(name: str) -> str:
        kind, _, value = fields.get(name, "").partition(":")
        return value.lower() if kind.lower() == "sha256" else ""

    if (want := sha("warc-block-digest")) and hashlib.sha256(block).hexdigest() != want:
        raise Damaged("block digest differs")
    digest, size = sha("warc-payload-digest"), fields.get("x-payload-length", "")
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        got = hashlib.sha256(payload).hexdigest()
        if digest and got != digest:
            raise Damaged("payload digest differs")
        digest, size = got, str(len(payload))
    page, refers = fields.get("x-page-id", ""), re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {"page_id": int(page) if re.fullmatch(r"-?\d+", page) else None, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": int(refers[1]) if refers else None, "payload_bytes": int(size) if size.isdigit() else None, "payload_digest": digest or None}


def member(source: Source, pos: int) -> tuple[list[dict], int]:
    """The records of the gzip member or of the plain record at pos, and where it ends."""
    if source.at(pos, 3) == b"\x1f\x8b\x08":
        unpack, parts, at = zlib.decompressobj(31), [], pos
        while not unpack.eof:
            piece = source.some(at)
            if not piece:
                raise Damaged("member is cut off")
            try:
                parts.append(unpack.decompress(piece))
            except zlib.error as e:
                raise Damaged(f"bad member: {e}") from e
            at += len(piece)
        raw, end = b"".join(parts), at - len(unpack.unused_data)
        rows, done = [], 0
        while done < len(raw):
            fields, size = headers(raw, done)
            block = raw[done + size : done + size + int(fields["content-length"])]
            if len(block) < int(fields["content-length"]):
                raise Damaged("record is cut off")
            rows.append(checked(fields, block))
            done += size + len(block)
            while raw[done : done + 1] in (b"\r", b"\n"):
                done += 1
        return rows, end
    fields, size = plain_headers(source, pos)
    length = int(fields["content-length"])
    if pos + size + length > source.size:
        raise Damaged("record is cut off")
    row, end = checked(fields, source.at(pos + size, length)), pos + size + length
    while source.at(end, 1) in (b"\r", b"\n"):
        end += 1
    return [row], end


def salvaged(source: Source) -> Iterator[dict]:
    """Rows of all good records, and of the gaps between them."""
    pos = 0
    while pos < source.size:
        try:
            rows, end = member(source, pos)
        except Damaged as why:
            gap, reason = pos, str(why)
            while True:
                pos = source.find(START, pos + 1)
                if pos < 0:
                    pos = source.size
                    break
                try:
                    member(source, pos)
                    break
                except Damaged:
                    continue
            yield {"start": gap, "end": pos, "kind": "gap", "reason": reason}
            continue
        for row in rows:
            yield row | {"start": pos, "end": end, "kind": "record"}
        pos = end


def _reader(folder: str):
    schema = pa.schema([pa.field(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                path, rows = f"{top}/{name}", []
                with store.open_input_file(path) as file:
                    for row in salvaged(Source(file, file.size())):
                        rows.append(row | {"archive": name})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records (kind ``record``) and gaps (kind ``gap``) of the archives that ``manifest`` names; an archive is read by one task."""
    archives = manifest.select("archive").distinct()
    return archives.repartition(max(1, archives.count())).mapInArrow(_reader(folder), ROWS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(pages, folder), folder).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
