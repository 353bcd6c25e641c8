"""Questions that point into the corpus, and the units where they point."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import duck_tokens
from siltstone.operators import locators
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS

#: What questions look like; {n} is a number, {w} and {v} the first two words of the document.
FORMS = ["what is on page {n}?", "Slide no. {n} please", "see SHEET #{n}, cell B{n}:C9", "the sheet {w} D4", "lines {n} to 9 of it", "compare rows 2-{n} in column {v}", "header named '{w}' there", "go to #{w}-{v} now", "anchor {w} on page number {n}", "nothing at all"]
KINDS = {"en": "page", "fr": "slide", "de": "sheet", "es": "section"}


def _questions(spark, sf_dir):
    docs = corpus.sources(spark, sf_dir).select("source_id", "text", F.char_length("text").alias("size"))
    word = lambda k: F.regexp_extract("text", r"^([A-Za-z]+) ([A-Za-z]+)", k)
    text = F.get(F.array(*map(F.lit, FORMS)), F.col("size") % len(FORMS))
    for name, value in (("{n}", (F.col("size") % 11 + 1).cast("string")), ("{w}", word(1)), ("{v}", word(2))):
        text = F.replace(text, F.lit(name), value)
    return docs.select(F.concat(F.lit("of-"), "source_id").alias("question_id"), "source_id", text.alias("text"))


def question_places(spark, sf_dir):
    """What every question names."""
    return _questions(spark, sf_dir).select("question_id", "text", *(c.alias(k) for k, c in locators.parsed(F.col("text")).items()))


def located_units(spark, sf_dir):
    """The units of every question: lines as pages, slides, sheets or sections by the language of their document."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    units = corpus.units(spark, sf_dir).join(corpus.sources(spark, sf_dir).select("source_id", F.try_element_at(kinds, F.col("lang")).alias("unit_type")), "source_id")
    word = lambda k: F.regexp_extract("text", r"^([A-Za-z]+) ([A-Za-z]+)", k)
    units = units.select(
        "source_id", "unit_id", "unit_type", F.col("ordinal").alias("logical_ordinal"), (F.col("ordinal") + 1).alias("render_ordinal"), word(1).alias("sheet_name"), F.concat_ws("-", word(1), word(2)).alias("slug_anchor"), F.col("ordinal").alias("line_start"),
        (F.col("ordinal") + 4).alias("line_end"), (F.char_length("text") % 12).cast("long").alias("row_count"), F.array(word(1), F.upper(word(2))).alias("header_names"), (F.col("unit_type") == "sheet").alias("cell_hint_supported"),
    )
    return locators.located(_questions(spark, sf_dir), units)


QUERIES = {f.__name__: f for f in (question_places, located_units)}

_n = "(size % 11 + 1)::VARCHAR"
_FORMS = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in FORMS) + "]"
_NO = "NULLIF({}, '')"
_found = lambda pattern, group=1: f"nullif(regexp_extract(text, '{pattern}', {group}), '')".replace("(?iU)", "(?i)").replace("(?U)", "")
_q = lambda pattern: pattern.replace("'", "''")
_PLACES = rf"""q0 AS (SELECT source_id, length(text) AS size, text AS body FROM sources),
q AS (SELECT 'of-' || source_id AS question_id, source_id, replace(replace(replace({_FORMS}[size % {len(FORMS)} + 1], '{{n}}', {_n}), '{{w}}', regexp_extract(body, '^([A-Za-z]+) ([A-Za-z]+)', 1)), '{{v}}', regexp_extract(body, '^([A-Za-z]+) ([A-Za-z]+)', 2)) AS text FROM q0),
p AS (SELECT *, {_found(locators.NUMBERED.format('slide'))} AS slide, {_found(locators.NUMBERED.format('page'))} AS pg, {_found(locators.NUMBERED.format('sheet'))} AS sh, {_found(locators.SHEET_NAME)} AS raw, {_found(locators.CELL)} AS cell_hint,
  {_found(locators.SPAN.format('line'))} AS l1, {_found(locators.SPAN.format('line'), 2)} AS l2, {_found(locators.SPAN.format('row'))} AS r1, {_found(locators.SPAN.format('row'), 2)} AS r2,
  nullif(trim({_found(_q(locators.HEADER))}, ' "'''), '') AS header_name, coalesce({_found(locators.ANCHOR)}, {_found(locators.ANCHOR, 2)}) AS anchor FROM q),
n AS (SELECT *, CASE WHEN coalesce(slide, pg, sh) IS NULL THEN nullif(trim(regexp_replace(trim(raw), '{locators.CELL.replace("(?U)", "")}', '', 'g'), ' :_-'), '') END AS sheet_name FROM p),
places AS (SELECT question_id, source_id, text, CASE WHEN slide IS NOT NULL THEN 'slide' WHEN pg IS NOT NULL THEN 'page' WHEN coalesce(sh, sheet_name, cell_hint) IS NOT NULL THEN 'sheet' WHEN l1 IS NOT NULL THEN 'line' WHEN r1 IS NOT NULL THEN 'row' WHEN header_name IS NOT NULL THEN 'sheet'
  WHEN anchor IS NOT NULL THEN 'section' END AS locator_type, coalesce(slide, pg, sh)::BIGINT AS logical_ordinal, sheet_name, cell_hint, l1::BIGINT AS line_start, coalesce(l2, l1)::BIGINT AS line_end, r1::BIGINT AS row_start, coalesce(r2, r1)::BIGINT AS row_end, header_name, anchor FROM n)"""
_RULES = {
    "exact-logical-ordinal": ("ord", locators.ORDINAL), "exact-render-ordinal-alias": ("NOT ord AND u.ordinal + 1 = k.logical_ordinal AND (k.locator_type = u.kind OR (k.locator_type = 'page' AND u.kind = 'slide'))", locators.RENDER),
    "exact-sheet-name": ("k.sheet_name = u.w", locators.SHEET), "exact-slug-anchor": ("k.anchor = u.w || '-' || u.v", locators.SLUG), "exact-line-span": ("k.line_start >= u.ordinal AND k.line_end <= u.ordinal + 4", locators.LINES),
    "row-hint": ("u.kind = 'sheet' AND k.row_start >= 1 AND k.row_start <= k.row_end AND k.row_end <= length(u.text) % 12", locators.ROWS),
    "header-hint": (f"list_contains(list_filter([CASE WHEN u.w <> '' THEN array_to_string({duck_tokens('u.w')}, ' ') END, CASE WHEN u.v <> '' THEN array_to_string({duck_tokens('u.v')}, ' ') END], lambda x: x IS NOT NULL), array_to_string({duck_tokens('k.header_name')}, ' ')) AND k.header_name IS NOT NULL", locators.HEAD),
    "sheet-cell-hint": ("k.cell_hint IS NOT NULL AND u.kind = 'sheet'", locators.CELLS),
}
ORACLES = {
    "question_places": f"WITH {DUCK_SOURCES}, {_PLACES} SELECT question_id, text, {', '.join(locators.FIELDS)} FROM places",
    "located_units": rf"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, {_PLACES},
ku AS (SELECT units.*, CASE lang WHEN 'en' THEN 'page' WHEN 'fr' THEN 'slide' WHEN 'de' THEN 'sheet' WHEN 'es' THEN 'section' END AS kind, regexp_extract(units.text, '^([A-Za-z]+) ([A-Za-z]+)', 1) AS w, regexp_extract(units.text, '^([A-Za-z]+) ([A-Za-z]+)', 2) AS v FROM units JOIN sources USING (source_id)),
j AS (SELECT k.question_id, k.source_id, u.unit_id, {', '.join(f"coalesce({c.replace('NOT ord', 'NOT coalesce(k.locator_type = u.kind AND k.logical_ordinal = u.ordinal, false)').replace('ord', 'k.locator_type = u.kind AND k.logical_ordinal = u.ordinal') if c == 'ord' else c.replace('NOT ord', 'NOT coalesce(k.locator_type = u.kind AND k.logical_ordinal = u.ordinal, false)')}, false) AS c{i}" for i, (c, _) in enumerate(_RULES.values()))}
  FROM places k JOIN ku u ON u.source_id = k.source_id WHERE k.locator_type IS NOT NULL)
SELECT question_id, source_id, unit_id, ({' + '.join(f"c{i}::INT * {p}" for i, (_, p) in enumerate(_RULES.values()))})::DOUBLE AS score, {' OR '.join(f"c{i}" for i in range(5))} AS exact,
  array_to_string(list_filter([{', '.join(f"CASE WHEN c{i} THEN '{k}' END" for i, k in enumerate(_RULES))}], lambda x: x IS NOT NULL), ',') AS basis FROM j WHERE {' OR '.join(f"c{i}" for i in range(len(_RULES)))}""",
}
