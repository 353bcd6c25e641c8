"""Queries on parsing: documents as paragraphs and tables, pages as text and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_html_to_text, duck_tokens, html_to_text
from siltstone.operators import parsing
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS

#: The documents have no blank lines: lines of fewer than six words part their paragraphs here.
CUT = r"^\s*(\S+\s+){0,4}\S*\s*$"


def paragraph_units(spark, sf_dir):
    return parsing.paragraphs(corpus.sources(spark, sf_dir), CUT)


def delimited_profile(spark, sf_dir):
    return parsing.delimited_profile(corpus.sources(spark, sf_dir), ",")


def page_text(spark, sf_dir):
    """The text of pages, by digest and length."""
    text = html_to_text(F.coalesce("html", F.lit("")))
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def link_classification(spark, sf_dir):
    return parsing.links(corpus.table(spark, sf_dir, "pages"))


def link_kinds(spark, sf_dir):
    return parsing.links(corpus.table(spark, sf_dir, "pages")).groupBy("kind").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"), F.countDistinct("target").alias("targets"))


def heading_aliases(spark, sf_dir):
    return parsing.headings(corpus.units(spark, sf_dir))


QUERIES = {"paragraph_units": paragraph_units, "delimited_profile": delimited_profile, "html_to_text": page_text, "link_classification": link_classification, "link_kinds": link_kinds, "heading_aliases": heading_aliases}

_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS target, unnest(range(1, len(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) + 1)) AS place FROM pages),
k AS (SELECT page_id, place, target, CASE WHEN starts_with(target, '#') THEN 'anchor' WHEN regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'external' WHEN regexp_matches(target, '^(\\.\\./)+') THEN 'outside' WHEN length(target) = 0 THEN 'missing' ELSE 'local' END AS kind FROM l)"""
ORACLES = {
    "paragraph_units": f"""WITH {DUCK_SOURCES}, l AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM sources),
b AS (SELECT *, regexp_matches(line, '{CUT}') AS blank FROM l), r AS (SELECT *, sum(blank::INT) OVER (PARTITION BY source_id ORDER BY pos) AS run FROM b),
g AS (SELECT source_id, min(pos)::BIGINT AS line_start, max(pos)::BIGINT AS line_end, sum(length(line))::BIGINT AS n_chars FROM r WHERE NOT blank GROUP BY source_id, run)
SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_start) AS paragraph FROM g""",
    "delimited_profile": f"""WITH {DUCK_SOURCES}, c AS (SELECT source_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0), lambda x: string_split(x, ',')) AS cells FROM sources)
SELECT source_id, len(cells[1])::BIGINT AS n_columns, (len(cells) - 1)::BIGINT AS n_rows, len(list_distinct(list_transform(cells, lambda c: len(c)))) > 1 AS ragged, array_to_string(list_transform(cells[1], lambda x: trim(x)), '|') AS headers FROM c WHERE len(cells) > 0""",
    "html_to_text": f"WITH t AS (SELECT page_id, {duck_html_to_text(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')')} AS text FROM pages) SELECT page_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM t",
    "link_classification": f"WITH {_LINKS} SELECT * FROM k",
    "link_kinds": f"WITH {_LINKS} SELECT kind, count(*) AS links, count(DISTINCT page_id) AS pages, count(DISTINCT target) AS targets FROM k GROUP BY kind",
    "heading_aliases": rf"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, a AS (SELECT *, regexp_replace(regexp_replace(text, '[\s:.]+$', ''), '^\s+|\s+$', '', 'g') AS alias FROM units),
f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS place FROM a WHERE length(alias) BETWEEN 1 AND 120 AND len({duck_tokens('alias')}) BETWEEN 1 AND 14)
SELECT source_id, unit_id, alias, regexp_replace(regexp_replace(lower(alias), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM f WHERE place <= 12""",
}
