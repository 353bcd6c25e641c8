"""Identity of the present files among the sources of an earlier inventory, as one matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens
from siltstone.operators import identity
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES


def _inventories(spark, sf_dir):
    """The earlier inventory of the corpus, in which every eleventh source was archived, and the present one."""
    before = corpus.previous_inventory(spark, sf_dir).withColumn("active", F.regexp_extract("source_id", r"(\d+)$", 1).cast("long") % 11 != 6)
    return corpus.current_inventory(spark, sf_dir), before


def identity_matching(spark, sf_dir):
    """What each file is, claimed in the order of paths by path, fingerprint or likeness."""
    return identity.matched(*_inventories(spark, sf_dir))


def identity_by_print(spark, sf_dir):
    """The same without likeness."""
    return identity.matched(*_inventories(spark, sf_dir), fuzzy=False)


QUERIES = {f.__name__: f for f in (identity_matching, identity_by_print)}

#: Common table expressions for the likeness ``ratio`` of the pairs (x, y) of texts in ``met``.
DUCK_LIKENESS = """m AS (SELECT DISTINCT x, y, x AS a, y AS b, 0::BIGINT AS k FROM met
  UNION ALL SELECT x, y, part.a, part.b, CASE WHEN part.own THEN best[2] ELSE 0 END FROM (SELECT x, y, a, b, (SELECT max([i, k]) FROM (SELECT -i AS i, k FROM (SELECT unnest(range(1, length(a) + 1)) AS i), (SELECT unnest(range(1, length(a) + 1)) AS k)
        WHERE i + k <= length(a) + 1 AND contains(b, substr(a, i, k)) ORDER BY k DESC, i DESC LIMIT 1)) AS best FROM m WHERE a <> '' AND b <> ''),
      LATERAL (SELECT unnest([{'own': true, 'a': substr(a, 1, -best[1] - 1), 'b': substr(b, 1, instr(b, substr(a, -best[1], best[2])) - 1)},
        {'own': false, 'a': substr(a, -best[1] + best[2]), 'b': substr(b, instr(b, substr(a, -best[1], best[2])) + best[2])}]) AS part) WHERE best IS NOT NULL),
ratio AS (SELECT x, y, 2 * sum(k) / (length(x) + length(y)) AS ratio FROM m GROUP BY x, y)"""

# File by file: ``walk`` has a row for each stranger so far and the list of what strangers have claimed. ``m`` finds the likeness of two names: their longest
# common part (the first of equals), then those of what is left and right of it.
_FILES = f"""WITH RECURSIVE {DUCK_SOURCES},
prev AS (SELECT 'old-' || doc_id AS source_id, CASE doc_id % 11 WHEN 1 THEN 'old/' || current_path WHEN 5 THEN 'gone/' || current_path ELSE current_path END AS current_path,
  CASE WHEN doc_id % 11 IN (2, 5) THEN sha256('before ' || fingerprint) ELSE fingerprint END AS fingerprint, file_size, doc_id % 11 <> 6 AS active FROM sources WHERE doc_id % 11 <> 3),
files AS (SELECT current_path, string_split(current_path, '/') AS turn, fingerprint, file_size FROM sources WHERE doc_id % 11 <> 4),
old AS (SELECT prev.*, files.turn AS gone FROM prev LEFT JOIN files ON prev.active AND prev.current_path = files.current_path),
strangers AS (SELECT *, row_number() OVER (ORDER BY turn) AS n FROM files WHERE current_path NOT IN (SELECT current_path FROM old WHERE gone IS NOT NULL)),
prints AS (SELECT n, list(source_id) AS ids FROM strangers s JOIN old o ON s.fingerprint = o.fingerprint AND (o.gone IS NULL OR o.gone > s.turn) GROUP BY n)"""
_LIKE = f""",
name_of AS (SELECT current_path, array_to_string({duck_tokens("regexp_replace(string_split(current_path, '/')[-1], '^(.+)\\.[^.]+$', '\\1')")}, ' ') AS name FROM (SELECT current_path FROM files UNION SELECT current_path FROM prev)),
met AS (SELECT s.n, o.source_id, a.name AS x, b.name AS y FROM strangers s JOIN old o ON o.active AND (o.gone IS NULL OR o.gone > s.turn)
    AND CASE WHEN s.file_size > 0 AND o.file_size > 0 THEN least(s.file_size, o.file_size) / greatest(s.file_size, o.file_size) ELSE 0.9 END >= 0.9
  JOIN name_of a ON a.current_path = s.current_path JOIN name_of b ON b.current_path = o.current_path WHERE a.name <> '' AND b.name <> ''),
{DUCK_LIKENESS},
likes AS (SELECT n, list(source_id) AS ids FROM met JOIN ratio USING (x, y) WHERE ratio >= 0.65 GROUP BY n)"""
_WALK = """,
looks AS (SELECT s.n, coalesce(p.ids, []) AS prints, coalesce(l.ids, []) AS likes FROM strangers s LEFT JOIN prints p USING (n) LEFT JOIN likes l USING (n)),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::VARCHAR AS basis, NULL::VARCHAR AS claimed
  UNION ALL SELECT k.n, CASE WHEN len(k.free) = 1 THEN list_append(k.taken, k.free[1]) ELSE k.taken END, CASE WHEN len(k.free) = 0 THEN 'new' WHEN len(k.free) > 1 THEN 'ambiguous-' || k.way ELSE k.way END, CASE WHEN len(k.free) = 1 THEN k.free[1] END
  FROM (SELECT n, taken, CASE WHEN len(p) > 0 THEN p ELSE l END AS free, CASE WHEN len(p) > 0 THEN 'fingerprint' ELSE 'relocation' END AS way
    FROM (SELECT looks.n, walk.taken, list_filter(looks.prints, lambda i: NOT list_contains(walk.taken, i)) AS p, list_filter(looks.likes, lambda i: NOT list_contains(walk.taken, i)) AS l FROM walk JOIN looks ON looks.n = walk.n + 1)) k),
kinds AS (SELECT s.current_path, w.claimed AS source_id, w.basis FROM walk w JOIN strangers s USING (n) UNION ALL SELECT current_path, source_id, 'path' FROM old WHERE gone IS NOT NULL),
told AS (SELECT f.current_path, k.source_id, k.basis, o.current_path AS previous_path, o.fingerprint AS was, f.fingerprint AS is_now FROM kinds k JOIN files f USING (current_path) LEFT JOIN prev o USING (source_id))
SELECT current_path, source_id, CASE WHEN basis = 'path' THEN CASE WHEN was = is_now THEN 'unchanged' ELSE 'modified' END WHEN basis = 'new' THEN 'added' WHEN basis LIKE 'ambiguous%' THEN 'ambiguous' ELSE 'moved_or_renamed' END AS change, basis,
  array_to_string(list_filter([CASE WHEN previous_path <> current_path THEN 'path_changed' END, CASE WHEN was <> is_now THEN 'binary_changed' END], lambda x: x IS NOT NULL), ',') AS traits, previous_path FROM told
UNION ALL SELECT current_path, source_id, 'deleted', 'absent', '', current_path FROM prev WHERE active AND source_id NOT IN (SELECT source_id FROM kinds WHERE source_id IS NOT NULL)"""
ORACLES = {"identity_matching": _FILES + _LIKE + _WALK, "identity_by_print": _FILES + ", likes AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS ids WHERE false)" + _WALK}
