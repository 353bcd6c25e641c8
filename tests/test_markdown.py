"""The line automaton against hand-written cases and a plain reader of blocks."""

import random
import re

import pytest

from siltstone.operators import markdown

ITEM, RULE, HTML = re.compile(r"^\s*(?:[-+*]|\d+\.)\s+"), re.compile(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\s*$"), re.compile(r"^\s*<[^>]+>\s*$")
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)\s*$")


def plain(text):
    """(section, kind, line_start, line_end, text) by taking block after block from each section."""
    lines, matter = text.splitlines(), 0
    if len(lines) >= 3 and lines[0].strip() == "---":
        matter = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
    out = [(1, "front_matter", 1, matter - 2, "\n".join(lines[1 : matter - 1]).strip())] if matter > 2 else []
    sections, fence = [[]], ""
    for n, line in enumerate(lines[matter:], matter + 1):
        mark = line.strip()[:3]
        if mark in ("```", "~~~"):
            fence = mark if not fence else "" if fence == mark else fence
        if HEADING.match(line) and not fence:
            sections.append([])
        else:
            sections[-1].append((n, line))
    if not sections[0]:
        sections.pop(0)
    for k, rows in enumerate(sections, 1):
        i = 0
        while i < len(rows):
            start, line = i, rows[i][1]
            rule = lambda j: j + 1 < len(rows) and "|" in rows[j][1] and RULE.match(rows[j + 1][1].strip())
            take = lambda j, ok: next((x for x in range(j, len(rows)) if not rows[x][1].strip() or not ok(x)), len(rows))
            mark = line.strip()[:3]
            if not line.strip():
                i += 1
                continue
            if mark in ("```", "~~~"):
                i = next((x + 1 for x in range(i + 1, len(rows)) if rows[x][1].strip().startswith(mark)), len(rows))
                kind = "mermaid" if line.strip()[3:].strip().lower() == "mermaid" else "code_fence"
            elif rule(i):
                i, kind = take(i + 2, lambda x: "|" in rows[x][1]), "table"
            elif ITEM.match(line):
                i, kind = take(i + 1, lambda x: ITEM.match(rows[x][1]) or rows[x][1][:1] in " \t"), "list"
            elif HTML.match(line.strip()):
                i, kind = take(i + 1, lambda x: HTML.match(rows[x][1].strip())), "raw_html_or_unsupported"
            else:
                i, kind = take(i + 1, lambda x: rows[x][1].strip()[:3] not in ("```", "~~~") and not ITEM.match(rows[x][1]) and not rule(x) and not HTML.match(rows[x][1].strip())), "paragraph"
            end = rows[start][0] if kind == "table" and i == start + 2 < len(rows) else rows[i - 1][0]
            out.append((k, kind, rows[start][0], end, "\n".join(x for _, x in rows[start:i]).strip()))
    return out


def got(spark, texts):
    rows = markdown.blocks(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")).collect()
    return [sorted((r["section"], r["kind"], r["line_start"], r["line_end"], r["text"]) for r in rows if r["doc"] == str(i)) for i in range(len(texts))]


def test_random_texts(spark):
    rng = random.Random(8)
    some = ["", " ", "text", "# Head", "## Two words ", "#no head", "```", "```py", "  ```", "~~~", "~~~ mermaid", "``` Mermaid", "- item", " 1. item", "  more", "\tmore", "a | b", "|---|---|", "--- | :--:", "<br>", " <div class='x'> ", "<a> b", "---", "title: x", "a|b", "| c", "#  ", "é | ü"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n", "\r\n"]) for _ in range(400)]
    texts += ["---\n" + "\n".join(rng.choice(some) for _ in range(rng.randint(0, 6))) + "\n---\n" + rng.choice(texts) for _ in range(100)]
    assert got(spark, texts) == [sorted(plain(t)) for t in texts]


@pytest.mark.parametrize("text,kinds", [
    ("---\ntitle: T\n---\n# A\np\n\n- x\n  y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```mermaid\ngraph\n```\n<br>\n", ["front_matter", "paragraph", "list", "table", "mermaid", "raw_html_or_unsupported"]),
    ("```\n~~~\n# not a head\n```\n# a head\n", ["code_fence"]),
    ("a | b\n---|---\n\nend", ["table", "paragraph"]),
    ("```\nopen", ["code_fence"]),
])
def test_cases(spark, text, kinds):
    assert [k for _, k, *_ in sorted(got(spark, [text])[0], key=lambda b: b[2])] == kinds


def test_sections_see_the_marker_of_a_fence(spark):
    texts = ["```\n~~~\n# no\n```\n# yes", "---\n# no: 1\n---\n# yes", "~~~\n```\n# no", None, ""]
    rows = markdown.sections(spark.createDataFrame(list(zip("abcde", texts)), "doc string, text string")).collect()
    assert sorted((r["doc"], r["section"], r["level"], r["title"], r["line"]) for r in rows) == [("a", 2, 1, "yes", 5), ("b", 1, 1, "yes", 4)]


def test_a_section_number_counts_lines_before_the_first_heading(spark):
    rows = markdown.sections(spark.createDataFrame([("a", "# one\n## two"), ("b", "x\n# two")], "doc string, text string")).collect()
    assert sorted((r["doc"], r["section"], r["title"]) for r in rows) == [("a", 1, "one"), ("a", 2, "two"), ("b", 2, "two")]
