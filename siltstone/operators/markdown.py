"""Markdown as sections and blocks: a line automaton over the lines of each text.

Every line gets a code of what it looks like (blank, fence, heading, list item, raw HTML, with a pipe, a table's rule, indented), computed by the JVM. A scan over the codes alone follows two states:
the fence that headings look at, which only its own marker closes, and the block that a line belongs to, which begins anew with every section. Texts never leave their partition; blocks
are cut from them by the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import LINE_END, W

#: What lines look like.
BLANK, TICKS, TILDES, HEADING, ITEM, RULE, HTML, PIPE, INDENT = (1 << i for i in range(9))
LOOKS = {
    BLANK: f"^{W}*$", TICKS: f"^{W}*```", TILDES: f"^{W}*~~~", HEADING: f"^#{{1,6}}[ \\t]+.+?{W}*$", ITEM: f"^{W}*(?:[-+*]|\\p{{Nd}}+\\.){W}+",
    RULE: f"^{W}*\\|?(?:{W}*:?-{{3,}}:?{W}*\\|)+{W}*:?-{{3,}}:?{W}*\\|?{W}*$", HTML: f"^{W}*<[^>]+>{W}*$", PIPE: "\\|", INDENT: "^[ \\t]",
}
PART = "section: int, kind: string, first: int, last: int, end: int, closed: boolean"


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; a last line end opens no line."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{W}+|{W}+$", "")


def _matter(lines: Column) -> Column:
    """How many lines the front matter has, its two rules included; 0 without any."""
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), stripped)
    closes = F.array_position(rest, "---").cast("int")
    opens = (F.size(lines) >= 3) & (stripped(F.get(lines, F.lit(0))) == "---")
    return F.when(opens & (closes > 0), closes + 1).otherwise(0)


def _code(line: Column) -> Column:
    code = F.lit(0)
    for bit, look in LOOKS.items():
        code = code + F.when(line.rlike(look), bit).otherwise(0)
    return code


def follows(state: str, code: int, marker: str) -> bool:
    """Whether a line goes on with the block that the line before it left in ``state``."""
    if state in ("`", "~", "rule"):
        return True
    if code & BLANK:
        return False
    if state == "table":
        return bool(code & PIPE)
    if state == "list":
        return bool(code & (ITEM | INDENT))
    if state == "html":
        return bool(code & HTML)
    return state == "text" and not marker and not code & (ITEM | HTML)


KINDS = {"`": "code_fence", "~": "code_fence", "rule": "table", "list": "list", "html": "raw_html_or_unsupported", "text": "paragraph"}


def scanned(codes: list[int], matter: int) -> list[tuple]:
    """(section, kind, first, last, end, closed) of headings and blocks; lines count from 1. Sections count from 1 if lines stand before the first heading, else that opens the first."""
    out: list[list] = []
    if matter > 2:
        out.append([1, "front_matter", 2, matter - 1, matter - 2, None])
    section, fence, state, begun = 1, "", "", False
    for at in range(matter, len(codes)):
        code, table = codes[at], at + 1 < len(codes) and codes[at] & PIPE and codes[at + 1] & RULE
        marker = "`" if code & TICKS else "~" if code & TILDES else ""
        if marker and fence in ("", marker):
            fence = "" if fence else marker
        if code & HEADING and not fence:
            section += begun
            out.append([section, "heading", at + 1, at + 1, at + 1, None])
            state, begun = "", True
            continue
        begun = True
        if follows(state, code, marker) and not (state == "text" and table):
            out[-1][3:5] = at + 1, at + 1
            if state == "rule":
                # a table that ends with its rule ends at its head, unless the section ends there too
                state, out[-1][4] = "table", out[-1][2]
            elif state == marker:
                state, out[-1][5] = "", True
            continue
        state = "" if code & BLANK else marker or ("rule" if table else "list" if code & ITEM else "html" if code & HTML else "text")
        if state:
            out.append([section, KINDS[state], at + 1, at + 1, at + 1, False if state in "`~" else None])
    for block, after in zip(out, [*out[1:], None], strict=False):
        # what is left behind the last block of a section is blank lines, or nothing
        final = len(codes) if after is None else after[2] - 1 if after[1] == "heading" else 0
        if block[1] == "table" and block[3] == final:
            block[4] = block[3]
    return [tuple(b) for b in out]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    part = pa.struct([pa.field(c.split(":")[0], t) for c, t in zip(PART.split(", "), kinds, strict=True)])
    names = [f.name for f in part]
    for batch in batches:
        found = [[dict(zip(names, p, strict=True)) for p in scanned(codes, matter)] for codes, matter in zip(batch.column("codes").to_pylist(), batch.column("matter").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), pa.array(found, pa.list_(part))], ["doc", "text", "parts"])


def parts(texts: DataFrame) -> DataFrame:
    """(doc, lines, section, kind, first, last, end, closed) for the headings and blocks of ``texts`` (doc, text), whose doc is a string."""
    lined = texts.select("doc", "text", lines_of(F.col("text")).alias("lines")).select("doc", "text", _matter(F.col("lines")).alias("matter"), F.transform("lines", _code).alias("codes"))
    scan = lined.mapInArrow(_scan, f"doc string, text string, parts array<struct<{PART}>>")
    return scan.select("doc", lines_of(F.col("text")).alias("lines"), F.explode("parts").alias("p")).select("doc", "lines", "p.*")


def blocks(texts: DataFrame) -> DataFrame:
    """(doc, section, kind, line_start, line_end, text, info, closed) of ``texts`` (doc, text).

    kind: front_matter, code_fence, mermaid, table, list, raw_html_or_unsupported or paragraph; info is what follows a fence's marker, closed says if it was closed. Front matter begins at line 1 and ends at the number of its own lines. Null and empty texts have no blocks.
    """
    found = parts(texts).where("kind <> 'heading'")
    body = stripped(F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n"))
    fenced = F.col("kind") == "code_fence"
    info = F.when(fenced, stripped(F.substring(stripped(F.get("lines", F.col("first") - 1)), 4, 1 << 20)))
    kind = F.when(fenced & (F.lower(info) == "mermaid"), "mermaid").otherwise(F.col("kind"))
    start = F.when(F.col("kind") == "front_matter", 1).otherwise(F.col("first"))
    return found.select("doc", "section", kind.alias("kind"), start.alias("line_start"), F.col("end").alias("line_end"), body.alias("text"), info.alias("info"), "closed")


def sections(texts: DataFrame) -> DataFrame:
    """(doc, section, level, title, line): the headings of ``texts`` (doc, text) outside of fences and front matter, with the number of the section that each opens."""
    heads = parts(texts).where("kind = 'heading'").withColumn("head", F.get("lines", F.col("first") - 1))
    level = F.char_length(F.regexp_extract("head", "^(#+)", 1)).cast("long")
    return heads.select("doc", F.col("section").cast("long").alias("section"), level.alias("level"), stripped(F.regexp_replace("head", "^#+", "")).alias("title"), F.col("first").cast("long").alias("line"))
