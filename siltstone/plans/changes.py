"""Queries on changes between an earlier and the present inventory of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import changes
from siltstone.plans.identity import DUCK_LIKENESS
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_PREVIOUS, DUCK_SOURCES


def _changes(spark, sf_dir):
    return changes.classified(corpus.current_inventory(spark, sf_dir), corpus.previous_inventory(spark, sf_dir))


def cdc_classify(spark, sf_dir):
    return _changes(spark, sf_dir)


def cdc_stats(spark, sf_dir):
    return changes.statistics(_changes(spark, sf_dir))


def sync_materiality(spark, sf_dir):
    return changes.materiality(changes.statistics(_changes(spark, sf_dir)), corpus.current_inventory(spark, sf_dir), True)


def inventory_signature(spark, sf_dir):
    return changes.signature(corpus.sources(spark, sf_dir), "origin")


def fuzzy_relocation(spark, sf_dir):
    """New paths that may be lost sources under another name, the best candidate first."""
    found = _changes(spark, sf_dir)
    now, before = corpus.current_inventory(spark, sf_dir), corpus.previous_inventory(spark, sf_dir)
    new = now.join(found.where("change = 'added'").select("current_path"), "current_path")
    lost = before.join(found.where("change = 'deleted'").select("source_id"), "source_id")
    return changes.relocations(new, lost)


def dup_fingerprints(spark, sf_dir):
    """Contents that several sources have."""
    docs = corpus.sources(spark, sf_dir).groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("file_size").alias("file_size"))
    return docs.where("copies > 1")


QUERIES = {f.__name__: f for f in (cdc_classify, cdc_stats, sync_materiality, inventory_signature, fuzzy_relocation, dup_fingerprints)}

_CHANGES = f"""{DUCK_SOURCES}, {DUCK_PREVIOUS},
bp AS (SELECT now.current_path, now.fingerprint, prev.source_id AS old_id, prev.fingerprint AS old_print FROM now LEFT JOIN prev ON now.current_path = prev.current_path),
free AS (SELECT * FROM prev WHERE current_path NOT IN (SELECT current_path FROM now)),
tw AS (SELECT fingerprint, count(*) AS n, min(source_id) AS only_id FROM free GROUP BY 1),
met AS (SELECT b.current_path, n, only_id, row_number() OVER (PARTITION BY b.fingerprint ORDER BY b.current_path) AS turn FROM bp b LEFT JOIN tw USING (fingerprint) WHERE old_id IS NULL),
oth AS (SELECT *, CASE WHEN n IS NULL OR (n = 1 AND turn > 1) THEN 'added' WHEN n = 1 THEN 'moved_or_renamed' ELSE 'ambiguous' END AS change FROM met),
ch AS (SELECT current_path, old_id AS source_id, CASE WHEN fingerprint = old_print THEN 'unchanged' ELSE 'modified' END AS change, 'path' AS basis FROM bp WHERE old_id IS NOT NULL
  UNION ALL SELECT current_path, CASE WHEN change = 'moved_or_renamed' THEN only_id END, change, CASE WHEN change = 'added' THEN 'new' ELSE 'fingerprint' END FROM oth
  UNION ALL SELECT current_path, source_id, 'deleted', 'absent' FROM free WHERE source_id NOT IN (SELECT only_id FROM oth WHERE change = 'moved_or_renamed'))"""
_STEM = r"regexp_replace(regexp_replace(lower(string_split(c.current_path, '/')[-1]), '\.[^.]*$', ''), '[^a-z0-9]+', ' ', 'g')"
_STATS = "st AS (SELECT " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in changes.CLASSES) + " FROM ch)"
ORACLES = {
    "cdc_classify": f"WITH {_CHANGES} SELECT * FROM ch",
    "cdc_stats": f"WITH {_CHANGES}, {_STATS} SELECT * FROM st",
    "sync_materiality": f"""WITH {_CHANGES}, {_STATS}, m AS (SELECT added + modified + moved_or_renamed + deleted + ambiguous AS changed_total, deleted + moved_or_renamed + ambiguous AS destructive_total, (SELECT count(*) FROM now) AS active FROM st),
w AS (SELECT *, list_filter([CASE WHEN changed_total >= 12 THEN 'changed_total' END, CASE WHEN changed_total / active >= 0.15 THEN 'changed_ratio' END, CASE WHEN destructive_total >= 3 THEN 'destructive' END], lambda x: x IS NOT NULL) AS why FROM m)
SELECT changed_total, round(CASE WHEN active > 0 THEN changed_total / active ELSE 0 END::DOUBLE, 6) AS changed_ratio, destructive_total, CASE WHEN len(why) > 0 THEN 'material' ELSE 'minor' END AS materiality, array_to_string(why, ',') AS reasons FROM w""",
    "inventory_signature": f"""WITH {DUCK_SOURCES}, l AS (SELECT origin, sha256(current_path || '|' || file_size || '|' || fingerprint) AS line FROM sources)
SELECT origin, count(*) AS files, sha256(string_agg(line, '' ORDER BY line)) AS signature FROM l GROUP BY origin""",
    "fuzzy_relocation": rf"""WITH RECURSIVE {_CHANGES},
sz AS (SELECT doc_id, file_size FROM sources), nw AS (SELECT c.current_path, s.file_size AS size, {_STEM} AS x FROM ch c JOIN sources s USING (current_path) WHERE change = 'added'),
ls AS (SELECT c.source_id, z.file_size AS old_size, {_STEM} AS y FROM ch c JOIN sz z ON c.source_id = 'old-' || z.doc_id WHERE change = 'deleted'),
pr AS (SELECT current_path, source_id, x, y, least(size, old_size) / greatest(size, old_size, 1) AS share FROM nw JOIN ls ON least(size, old_size) / greatest(size, old_size, 1) >= 0.9), {DUCK_LIKENESS.replace('FROM met', 'FROM pr')}
SELECT current_path, source_id, 0.7 * ratio + (1 - 0.7) * share AS score FROM pr JOIN ratio USING (x, y) WHERE ratio >= 0.65""",
    "dup_fingerprints": f"WITH {DUCK_SOURCES} SELECT fingerprint, count(*) AS copies, min(doc_id) AS first_doc, max(file_size) AS file_size FROM sources GROUP BY 1 HAVING count(*) > 1",
}
