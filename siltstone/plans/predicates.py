"""Queries on what questions, lines and paths say of themselves, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions.text import duck_tokens
from siltstone.sources import corpus
from siltstone.sources.corpus import DUCK_SOURCES, DUCK_UNITS

#: Ends of the questions, so that every rule meets a case.
ENDS = [
    "", "Compare both, e.g. A vs B.", "Using only the document, please.", "I cannot answer: insufficient evidence.", "See /usr/local/share/x.txt", "See https:///a/b/c and http://h/x", "对比分析 both", "an inconsistent award decision",
    "You should reconsider this", "C:\\temp\\a\\b.txt", "different against", "no other source",
]
LINE_ENDS = ["", "Figure 3: revenue by quarter", "budget and sales in March 2024: 10% or 12.5", "1.2.3 Overview of the platform", "2) The login screen, before and after", "kpi, metric; timeline"]


def _with_end(key, ends):
    return F.element_at(F.array(*map(F.lit, ends)), (F.pmod(key, F.lit(len(ends))) + 1).cast("int"))


def question_predicates(spark, sf_dir):
    log = corpus.table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" "), _with_end(F.col("conv_id") + F.col("turn"), ENDS))
    rows = log.select("conv_id", "turn", text.alias("t"))
    t = F.col("t")
    return rows.select(
        "conv_id", "turn", P.comparative(t).alias("comparative"), t.rlike(P.COMPARE_SCOPE).alias("compare_scope"), t.rlike(P.SINGLE_SOURCE).alias("single_source"), P.abstains(t).alias("abstains"),
        P.machine_path(t).alias("machine_path"), P.mixed_language(t).alias("mixed_language"), P.has_any(t, P.AMBIGUITY).alias("ambiguity"), P.has_any(t, P.CONSTRAINT_UPDATE).alias("constraint_update"),
    )


def line_shapes(spark, sf_dir):
    """Lines as headings, captions and charts."""
    rows = corpus.units(spark, sf_dir).select("source_id", "unit_id", "ordinal", F.concat(_with_end(F.col("ordinal"), LINE_ENDS), F.lit(" "), "text").alias("t"))
    t, size = F.col("t"), (F.col("ordinal") % 4 * 4 + 10).cast("double")
    return rows.select(
        "source_id", "unit_id", F.md5(P.short_title(t)).alias("title"), F.md5(P.excerpt(t)).alias("excerpt"), P.slug48(t).alias("slug"), P.chart_like(t, F.col("ordinal") % 5).alias("chart"),
        P.caption(F.substring(t, 1, 60)).alias("caption"), P.heading_level(t, size, F.lit(10.0)).cast("long").alias("level"), P.roles(t).alias("roles"),
    )


def path_traits(spark, sf_dir):
    parts = P.inner_path(F.col("current_path"))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    depth = F.greatest(F.size(parts) - 1, F.lit(0))
    return corpus.sources(spark, sf_dir).select(
        "source_id", F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("").alias("subtree"), depth.cast("long").alias("depth"), F.array_join(P.lineage(parts), "|").alias("lineage"),
        F.round(F.greatest(F.lit(0.0), 0.3 - 0.05 * depth), 6).alias("trust_bonus"), F.array_join(P.stem_aliases(stem), "|").alias("aliases"), P.may_be_exact(F.element_at(parts, 1)).alias("exact_subtree"),
    )


QUERIES = {f.__name__: f for f in (question_predicates, line_shapes, path_traits)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_any = lambda t, xs: f"list_bool_or(list_transform({_list(xs)}, lambda m: contains(lower({t}), m)))"
_match = lambda t, p: f"regexp_matches({t}, {_q(p.replace('一-鿿', chr(0x4E00) + '-' + chr(0x9FFF)))})"
_flat = lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _excerpt(t: str, limit: int) -> str:
    return f"CASE WHEN length({_flat(t)}) <= {limit} THEN {_flat(t)} ELSE regexp_replace(regexp_replace(substr({_flat(t)}, 1, {limit}), ' [^ ]*$', ''), '[ ,;:.]+$', '') || '...' END"


_NUM = "regexp_extract(trim(t), '^(\\d+(?:\\.\\d+)*)', 1)"
_EXACT = lambda a: f"(len({duck_tokens(a)}) > 1 OR (len({duck_tokens(a)}) = 1 AND NOT (length({duck_tokens(a)}[1]) <= 1 OR (length({duck_tokens(a)}[1]) = 2 AND regexp_full_match({duck_tokens(a)}[1], '[a-z]+') AND NOT regexp_matches({a}, '[/.]')))))"
ORACLES = {
    "question_predicates": f"""WITH r AS (SELECT conv_id, turn, text || ' ' || {_list(ENDS)}[(conv_id + turn) % {len(ENDS)} + 1] AS t FROM conversations)
SELECT conv_id, turn, {_any('t', [' vs ', ' versus '])} OR list_has_any({duck_tokens('t')}, {_list(P.COMPARATIVE)}) AS comparative, {_match('t', P.COMPARE_SCOPE)} AS compare_scope, {_match('t', P.SINGLE_SOURCE)} AS single_source,
  {_any("regexp_replace(trim(t), '\\s+', ' ', 'g')", P.ABSTENTION)} AS abstains, regexp_matches(regexp_replace(t, {_q('(?i)https?://' + P.MACHINE_PATH)}, ' ', 'g'), {_q(P.MACHINE_PATH)}) AS machine_path,
  regexp_matches(t, '[A-Za-z]') AND {_match('t', '[一-鿿]')} AS mixed_language, {_any('t', P.AMBIGUITY)} AS ambiguity, {_any('t', P.CONSTRAINT_UPDATE)} AS constraint_update FROM r""",
    "line_shapes": f"""WITH {DUCK_SOURCES}, {DUCK_UNITS}, r AS (SELECT source_id, unit_id, ordinal, {_list(LINE_ENDS)}[ordinal % {len(LINE_ENDS)} + 1] || ' ' || text AS t FROM units), f AS (SELECT *, substr(t, 1, 60) AS s FROM r)
SELECT source_id, unit_id, md5(CASE WHEN length({_flat('t')}) > 120 THEN rtrim(substr({_flat('t')}, 1, 117)) || '...' WHEN {_flat('t')} = '' THEN 'Untitled Section' ELSE {_flat('t')} END) AS title, md5({_excerpt('t', 180)}) AS excerpt,
  coalesce(nullif(substr(regexp_replace(regexp_replace(lower(t), '[^0-9A-Za-z]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'untitled') AS slug,
  ({_any('t', P.CHART)})::INT * 2 + ({_any('t', P.MONTHS)})::INT + (len(regexp_extract_all(lower(t), {_q(P.NUMBER)})) >= 2)::INT + (ordinal % 5 >= 3)::INT >= 3 AS chart,
  CASE WHEN {_match(_excerpt('s', 160), P.CAPTION)} AND len(string_split({_excerpt('s', 160)}, ' ')) <= 18 THEN {_excerpt('s', 160)} END AS caption,
  CASE WHEN {_NUM} <> '' THEN least(length({_NUM}) - length(replace({_NUM}, '.', '')) + 1, 6) WHEN ordinal % 4 * 4 + 10 >= 17.5 THEN 1 WHEN ordinal % 4 * 4 + 10 >= 14.5 THEN 2 ELSE 3 END::BIGINT AS level,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_any('t', w)} THEN '{r}' END" for r, w in P.ROLES.items())}], lambda x: x IS NOT NULL), ',') AS roles FROM f""",
    "path_traits": f"""WITH {DUCK_SOURCES}, p AS (SELECT source_id, string_split(string_split(regexp_replace(current_path, '^corpus/', ''), '#attachment/')[1], '/') AS parts FROM sources),
s AS (SELECT *, regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem, greatest(len(parts) - 1, 0) AS depth FROM p), a AS (SELECT *, regexp_replace(stem, '[_-]', ' ', 'g') AS spaced FROM s), w AS (SELECT *, array_to_string({duck_tokens('spaced')}, ' ') AS words, parts[1] AS top,
  list_filter({duck_tokens('spaced')}, lambda t: NOT regexp_matches(t, '^[0-9]+$|^[0-9a-f]{{8,}}$')) AS named FROM a), l AS (SELECT *, [nullif(spaced, ''), CASE WHEN {_EXACT('words')} THEN words END, CASE WHEN len(named) >= 2 THEN array_to_string(named, ' ') END] AS every FROM w)
SELECT source_id, CASE WHEN len(parts) > 1 THEN parts[1] ELSE '' END AS subtree, depth::BIGINT AS depth, array_to_string(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')), '|') AS lineage,
  round(greatest(0.0, 0.3 - 0.05 * depth)::DOUBLE, 6) AS trust_bonus, array_to_string(list_filter(every, lambda x, i: x IS NOT NULL AND coalesce(list_position(every, x), 0) = i), '|') AS aliases, {_EXACT('top')} AS exact_subtree FROM l""",
}
