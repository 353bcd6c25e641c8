"""Queries on Markdown: web pages written as Markdown, with front matter and a table of what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import markdown
from siltstone.sources import corpus

#: Tags and what stands for them; other tags stay.
TAGS = {
    "<h1>": "\n# ", "</h1>": "\n", "<p>": "\n\n", "<br>": "\n", "<ul>": "\n", "<li>": "\n- ", "</li>": "", "</ul>": "\n\n", "<script>": "\n```js\n", "</script>": "\n```\n",
    "<style>": "\n~~~\n", "</style>": "\n~~~\n", "<article>": "\n<article>\n", "<nav>": "\n<nav>\n", "</nav>": "\n</nav>\n", "<!--": "\n<!--", "-->": "-->\n", "<b>": "## ",
}


def _texts(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    for tag, text in TAGS.items():
        body = F.replace(body, F.lit(tag), F.lit(text))
    head = F.concat(F.lit("---\nurl: "), url, F.lit("\n# page\n---\n| url | size |\n|---|:--|\n| "), url, F.lit(" | "), F.char_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit(" |\n"))
    return pages.select(F.col("page_id").cast("string").alias("doc"), F.concat(head, body).alias("text"))


def markdown_blocks(spark, sf_dir):
    """All blocks of all pages; their texts as digests."""
    return markdown.blocks(_texts(spark, sf_dir)).withColumn("text", F.md5("text"))


def markdown_headings(spark, sf_dir):
    """All headings of all pages."""
    return markdown.sections(_texts(spark, sf_dir))


QUERIES = {f.__name__: f for f in (markdown_blocks, markdown_headings)}

_body = "coalesce(html, '')"
for _tag, _text in TAGS.items():
    _body = f"replace({_body}, '{_tag}', '{_text}')".replace("\n", "' || chr(10) || '")
_W = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"'^{_W}+|{_W}+$', '', 'g'"
_TEXTS = f"""t AS (SELECT page_id::VARCHAR AS doc, '---' || chr(10) || 'url: ' || coalesce(url, '') || chr(10) || '# page' || chr(10) || '---' || chr(10) || '| url | size |' || chr(10) || '|---|:--|' || chr(10) || '| ' || coalesce(url, '') || ' | ' || length(coalesce(html, ''))
  || ' |' || chr(10) || {_body} AS text FROM pages)"""


def duck_lines(texts: str) -> str:
    """Common table expressions for the automaton over ``texts`` (doc, text): lines, what they look like, and the state behind each."""
    return rf"""a AS (SELECT doc, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM {texts}),
b AS (SELECT doc, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM a),
m AS (SELECT doc, p, CASE WHEN len(p) >= 3 AND regexp_replace(p[1], {_STRIP}) = '---' THEN coalesce(list_position(list_transform(p[2:], lambda x: regexp_replace(x, {_STRIP})), '---') + 1, 1) ELSE 0 END AS found FROM b),
f AS (SELECT doc, p, CASE WHEN found > 1 THEN found ELSE 0 END::BIGINT AS matter FROM m),
ln AS (SELECT doc, matter, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS n FROM f),
looks AS (SELECT *, regexp_matches(line, '^{_W}*$') AS blank, CASE WHEN regexp_matches(line, '^{_W}*```') THEN '`' WHEN regexp_matches(line, '^{_W}*~~~') THEN '~' ELSE '' END AS mark, regexp_matches(line, '^#{{1,6}}[ \t]+.+?{_W}*$') AS heading,
  regexp_matches(line, '^{_W}*(?:[-+*]|\p{{Nd}}+\.){_W}+') AS item, regexp_matches(line, '^{_W}*<[^>]+>{_W}*$') AS html, contains(line, '|') AS pipe, regexp_matches(line, '^[ \t]') AS indent,
  contains(line, '|') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc ORDER BY n), '^{_W}*\|?(?:{_W}*:?-{{3,}}:?{_W}*\|)+{_W}*:?-{{3,}}:?{_W}*\|?{_W}*$'), false) AS ruled FROM ln WHERE n > matter),
r AS (SELECT doc, matter AS n, '' AS fence, '' AS state, 1::BIGINT AS section, false AS begun, 0 AS block, false AS member, false AS head FROM f
  UNION ALL SELECT doc, n, fence, CASE WHEN head THEN '' WHEN stays THEN CASE WHEN state = 'rule' THEN 'table' WHEN state = mark THEN '' ELSE state END WHEN blank THEN '' WHEN mark <> '' THEN mark WHEN ruled THEN 'rule' WHEN item THEN 'list' WHEN html THEN 'html' ELSE 'text' END,
    section + (head AND begun)::INT, true, block + (NOT head AND NOT stays AND NOT blank)::INT, NOT head AND (stays OR NOT blank), head
  FROM (SELECT *, CASE WHEN head THEN false WHEN state IN ('`', '~', 'rule') THEN true WHEN blank THEN false WHEN state = 'table' THEN pipe WHEN state = 'list' THEN item OR indent WHEN state = 'html' THEN html
      WHEN state = 'text' THEN mark = '' AND NOT item AND NOT html AND NOT ruled ELSE false END AS stays
    FROM (SELECT *, heading AND fence = '' AS head FROM (SELECT l.*, CASE WHEN mark <> '' AND r.fence IN ('', mark) THEN CASE WHEN r.fence = '' THEN mark ELSE '' END ELSE r.fence END AS fence, r.state, r.section, r.begun, r.block FROM r JOIN looks l ON l.doc = r.doc AND l.n = r.n + 1)))),
walked AS (SELECT r.*, looks.line, looks.mark, looks.matter FROM r JOIN looks USING (doc, n))"""


ORACLES = {
    "markdown_blocks": rf"""WITH RECURSIVE {_TEXTS}, {duck_lines("t")},
g AS (SELECT doc, block, min(section) AS section, min(n) AS first, max(n) AS last, arg_min(state, n) AS state, arg_max(state, n) AS behind, arg_min(line, n) AS head, regexp_replace(string_agg(line, chr(10) ORDER BY n), {_STRIP}) AS text FROM walked WHERE member GROUP BY doc, block),
e AS (SELECT doc, section, max(n) AS ends FROM walked WHERE NOT head GROUP BY doc, section),
k AS (SELECT g.*, CASE WHEN state IN ('`', '~') THEN regexp_replace(regexp_replace(head, {_STRIP})[4:], {_STRIP}) END AS info, ends FROM g JOIN e USING (doc, section))
SELECT doc, section, CASE state WHEN 'rule' THEN 'table' WHEN 'html' THEN 'raw_html_or_unsupported' WHEN 'text' THEN 'paragraph' WHEN 'list' THEN 'list' ELSE CASE WHEN lower(info) = 'mermaid' THEN 'mermaid' ELSE 'code_fence' END END AS kind, first AS line_start,
  CASE WHEN state = 'rule' AND last = first + 1 AND last < ends THEN first ELSE last END AS line_end, md5(text) AS text, info, CASE WHEN state IN ('`', '~') THEN behind = '' END AS closed FROM k
UNION ALL SELECT doc, 1, 'front_matter', 1, matter - 2, md5(regexp_replace(array_to_string(p[2:matter - 1], chr(10)), {_STRIP})), NULL, NULL FROM f WHERE matter > 2""",
    "markdown_headings": rf"""WITH RECURSIVE {_TEXTS}, {duck_lines("t")}
SELECT doc, section, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_replace(regexp_replace(line, '^#+', ''), {_STRIP}) AS title, n AS line FROM walked WHERE head""",
}
