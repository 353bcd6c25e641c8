"""Queries that write and read back: files, published snapshots, builds that keep what did not change."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import builds
from siltstone.sources import corpus, files, snapshots
from siltstone.sources.corpus import DUCK_SOURCES
from siltstone.storage import new_folder


def _written_pages(spark, sf_dir):
    """Every page as a file: in UTF-8, with a byte order mark, with line ends of two bytes, or in Latin-1; some of types that are not read."""
    pages = corpus.table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    size = F.char_length("html")
    names = F.array(*(F.lit(x) for x in ("page-%d.txt", "page-%d.md", "page-%d.TXT", "page-%d.bin", "~$page-%d.docx", "page-%d.eml")))
    name = F.replace(F.get(names, size % 6), F.lit("%d"), F.col("page_id").cast("string"))
    plain = F.encode("html", "UTF-8")
    wide = F.encode(F.replace("html", F.lit("."), F.lit(".\r\n")), "UTF-8")
    content = F.when(size % 4 == 0, plain).when(size % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(size % 4 == 2, wide).otherwise(F.encode("html", "ISO-8859-1"))
    folder = new_folder(spark, "pages")
    files.write(pages.select(F.concat(F.lit("in/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), name).alias("path"), content.alias("content")), folder)
    return files.scan(spark, folder)


def file_corpus(spark, sf_dir):
    """The files that are read, decoded."""
    rows = files.decoded(files.typed(_written_pages(spark, sf_dir)))
    return rows.select("path", "document_type", "tier", "file_size", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "warning")


def file_counts(spark, sf_dir):
    """Files of every known extension."""
    return files.counts(_written_pages(spark, sf_dir))


def snapshot_publish(spark, sf_dir):
    """The earlier inventory is published, then the present one: what readers of the pointer find, measured again."""
    root = new_folder(spark, "published")
    tables = lambda inventory: {"inventory": inventory(spark, sf_dir), "units": corpus.units(spark, sf_dir)}
    for inventory, at in ((corpus.previous_inventory, "2024-01-01T00:00:00Z"), (corpus.current_inventory, "2024-01-02T00:00:00Z")):
        last = tables(inventory)
        snapshots.publish(last, root, snapshots.measured(last["inventory"])[1], at, "query")
    records = snapshots.ledger(spark, root).count()
    rows = [(name, *snapshots.measured(df), records) for name, df in snapshots.tables(spark, root).items()]
    return spark.createDataFrame(rows, "name string, n_rows long, digest string, published long")


def _build(spark, sf_dir):
    """Two builds, over an earlier state of the documents and over the present one."""
    docs = corpus.sources(spark, sf_dir).select("source_id", F.col("origin").alias("root"), "doc_id", "text")
    n = F.col("doc_id") % 11
    earlier = docs.where(n != 3).withColumn("text", F.when(n == 2, F.concat(F.lit("before "), "text")).when(n == 7, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    now = docs.where(n != 4)

    def compute(rows):
        kinds = F.array(F.struct(F.lit("words").alias("kind"), F.regexp_count("text", F.lit(r"\S+")).cast("string").alias("content")), F.struct(F.lit("text").alias("kind"), F.md5(F.trim("text")).alias("content")))
        return rows.select("source_id", F.explode(kinds).alias("k")).select("source_id", "k.*")

    def fold(rows):
        return rows.where("kind = 'words'").groupBy("root").agg(F.sum(F.col("content").cast("long")).cast("string").alias("value"))

    folder = new_folder(spark, "build")
    out = None
    for state, at in ((earlier, "2024-01-01T00:00:00Z"), (now, "2024-01-02T00:00:00Z")):
        out = builds.rebuilt(state.withColumn("fingerprint", F.sha2("text", 256)), folder, ["words", "text"], compute, fold, at)
    return out


def selective_rebuild(spark, sf_dir):
    """What the second build did with every source."""
    return _build(spark, sf_dir)[0]


def root_rebuild(spark, sf_dir):
    """What it did with every root."""
    return _build(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (file_corpus, file_counts, snapshot_publish, selective_rebuild, root_rebuild)}

_PAGES = r"""p AS (SELECT page_id, coalesce(html, '') AS html, length(coalesce(html, '')) AS size FROM pages),
k AS (SELECT *, 'in/' || page_id % 7 || '/' || replace(['page-%d.txt', 'page-%d.md', 'page-%d.TXT', 'page-%d.bin', '~$page-%d.docx', 'page-%d.eml'][size % 6 + 1], '%d', page_id::VARCHAR) AS path,
  CASE WHEN size % 4 = 2 THEN replace(html, '.', '.' || chr(10)) WHEN size % 4 = 3 THEN regexp_replace(regexp_replace(html, '[\x{80}-\x{ff}]', chr(65533), 'g'), '[\x{100}-\x{fffc}\x{fffe}-\x{10ffff}]', '?', 'g') ELSE html END AS text,
  octet_length(encode(html)) + CASE size % 4 WHEN 1 THEN 3 WHEN 2 THEN 2 * (length(html) - length(replace(html, '.', ''))) WHEN 3 THEN length(html) - octet_length(encode(html)) ELSE 0 END AS file_size FROM p)"""
_STATES = """s AS (SELECT source_id, origin AS root, doc_id, text, doc_id % 11 AS n FROM sources),
b AS (SELECT source_id, root, CASE n WHEN 2 THEN 'before ' || text WHEN 7 THEN text || ' ' ELSE text END AS text FROM s WHERE n <> 3), a AS (SELECT source_id, root, text FROM s WHERE n <> 4),
d AS (SELECT *, sha256(text) AS fingerprint, len(regexp_extract_all(text, '\\S+'))::VARCHAR AS words, md5('text:' || md5(md5(trim(text, ' '))) || '|words:' || md5(len(regexp_extract_all(text, '\\S+'))::VARCHAR)) AS digest FROM a),
e AS (SELECT *, sha256(text) AS fingerprint, md5('text:' || md5(md5(trim(text, ' '))) || '|words:' || md5(len(regexp_extract_all(text, '\\S+'))::VARCHAR)) AS digest FROM b),
t AS (SELECT d.*, CASE WHEN e.source_id IS NULL THEN 'added' WHEN e.fingerprint = d.fingerprint THEN 'reused' WHEN e.digest = d.digest THEN 'stable' ELSE 'rebuilt' END AS status FROM d LEFT JOIN e USING (source_id))""".replace("\\\\", "\\")
_BITS = "('0x' || substr(md5({}), 1, 15))::BIGINT"
ORACLES = {
    "file_corpus": rf"""WITH {_PAGES} SELECT path, CASE lower(regexp_extract(path, '\.([^.]+)$', 1)) WHEN 'txt' THEN 'plaintext' WHEN 'md' THEN 'markdown' ELSE 'email' END AS document_type, 'first-class' AS tier, file_size::BIGINT AS file_size,
  length(text) AS n_chars, md5(text) AS digest, CASE WHEN size % 4 = 3 AND regexp_matches(html, '[\x{{80}}-\x{{ff}}]') THEN '{files.DEGRADED}' END AS warning FROM k WHERE size % 6 NOT IN (3, 4)""",
    "file_counts": f"""WITH {_PAGES} SELECT extension, count(page_id) AS files FROM (SELECT unnest({[*files.TYPES]}) AS extension) LEFT JOIN (SELECT page_id, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS extension FROM k WHERE size % 6 NOT IN (3, 4)) USING (extension) GROUP BY 1""",
    "snapshot_publish": f"""WITH {DUCK_SOURCES}, {corpus.DUCK_UNITS}, r AS (SELECT 'inventory' AS name, current_path || '|' || fingerprint || '|' || file_size || '|txt' AS line FROM sources WHERE doc_id % 11 <> 4
  UNION ALL SELECT 'units', source_id || '|' || unit_id || '|' || ordinal || '|' || text FROM units)
SELECT name, count(*) AS n_rows, sum({_BITS.format('line')})::VARCHAR AS digest, 2 AS published FROM r GROUP BY name""",
    "selective_rebuild": f"WITH {DUCK_SOURCES}, {_STATES} SELECT source_id, root, fingerprint, digest, status FROM t",
    "root_rebuild": f"""WITH {DUCK_SOURCES}, {_STATES}, x AS (SELECT root, sum({_BITS.format("source_id || ':' || digest")})::VARCHAR AS digest, sum(words::BIGINT)::VARCHAR AS value FROM t GROUP BY root),
y AS (SELECT root, sum({_BITS.format("source_id || ':' || digest")})::VARCHAR AS digest FROM e GROUP BY root)
SELECT root, value, x.digest, CASE WHEN x.digest = y.digest THEN 'reused' ELSE 'rebuilt' END AS status FROM x LEFT JOIN y USING (root)""",
}
