"""What a question, an answer, a line or a path says of itself: column expressions over one text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import strip, tokens

#: Patterns and markers.
COMPARE_SCOPE = r"(?i)\b(compare|versus|vs\.?|difference|between)\b|对比(?:分析)?|比较(?:分析)?|差异和联系|差异|区别|异同"
SINGLE_SOURCE = r"(?i)\b(using only|use only|only the document|only the deck|only the file|do not use any other source|don't use any other source|no other source|single document|single source)\b"
COMPARATIVE = ["compare", "comparison", "versus", "vs", "difference", "different", "between", "against"]
ABSTENTION = ["i cannot answer", "i can't answer", "i cannot determine", "i can't determine", "i do not have enough evidence", "i don't have enough evidence", "insufficient evidence", "cannot verify"]
AMBIGUITY = ["contradiction", "contradict", "inconsistent", "ambigu", "final negotiated", "award decision", "exact dependency order"]
CONSTRAINT_UPDATE = ["reconsider", "update", "correction", "clarify", "constraint", "wrong", "should", "must"]
MACHINE_PATH = r"(?:/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+|[A-Za-z]:\\(?:[^\\\s]+\\)+[^\\\s]+)"
CAPTION = r"(?i)^(figure|fig\.|table|chart|diagram|exhibit)\s+[A-Za-z0-9.-]+\s*[:.-]?\s+"
CHART = ["chart", "graph", "trend", "forecast", "actual", "budget", "target", "variance", "revenue", "sales", "growth", "performance", "q1", "q2", "q3", "q4"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"]
ROLES = {
    "architecture-like": ["architecture", "platform", "service", "system", "integration"],
    "flow-like": ["flow", "workflow", "process", "step", "stage", "journey"],
    "ui-like": ["screen", "ui", "interface", "dashboard", "login", "button"],
    "comparison-like": ["compare", "comparison", "versus", "vs", "before", "after"],
    "roadmap-like": ["roadmap", "timeline", "milestone", "phase", "quarter"],
    "kpi-like": ["kpi", "metric", "scorecard", "performance", "variance"],
    "overview-like": ["overview", "summary", "at a glance"],
    "appendix-like": ["appendix", "backup"],
}
NUMBER = r"\b\d+(?:\.\d+)?%?\b"


def has_any(text: Column, markers: list[str]) -> Column:
    """Whether the text holds any of the markers, which are lower-case."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (lowered.contains(m) for m in markers))


def comparative(text: Column) -> Column:
    return has_any(text, [" vs ", " versus "]) | F.arrays_overlap(tokens(text), F.array(*map(F.lit, COMPARATIVE)))


def abstains(text: Column) -> Column:
    return has_any(F.regexp_replace(strip(text), r"\s+", " "), ABSTENTION)


def machine_path(text: Column) -> Column:
    """Whether the text names an absolute path; one right behind the two slashes of a web address is none."""
    return F.regexp_replace(text, "(?i)https?://" + MACHINE_PATH, " ").rlike(MACHINE_PATH)


def mixed_language(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & text.rlike("[一-鿿]")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_title(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters with dots for the rest; text without any is untitled."""
    flat = squeezed(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(F.coalesce(F.nullif(flat, F.lit("")), F.lit("Untitled Section")))


def excerpt(text: Column, limit: int = 180) -> Column:
    """At most ``limit`` characters, without the word that is cut and marks before it, and dots."""
    flat = squeezed(text)
    cut = F.substring(flat, 1, limit)
    whole = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(whole, r"[ ,;:.]+$", ""), F.lit("...")))


def slug48(text: Column) -> Column:
    """Runs of letters and digits joined by dashes, cut at 48; only as much of the text is read as that needs, marks at its end make no dash."""
    most = F.regexp_extract(F.lower(text), "^[^0-9A-Za-z]*+((?:[0-9A-Za-z](?:[^0-9A-Za-z]++(?=[0-9A-Za-z]))?+){0,48})", 1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(most, "[^0-9A-Za-z]+", "-"), 1, 48), F.lit("")), F.lit("untitled"))


def chart_like(text: Column, drawings: Column) -> Column:
    """Words of charts count 2; months, two numbers and three drawings 1 each; three make a chart."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    numbers = F.size(F.regexp_extract_all(F.lower(text), F.lit(f"({NUMBER})"), F.lit(1)))
    return points(has_any(text, CHART), 2) + points(has_any(text, MONTHS), 1) + points(numbers >= 2, 1) + points(drawings >= 3, 1) >= 3


def caption(text: Column) -> Column:
    """The text as a caption of at most 18 words, or null."""
    flat = excerpt(text, 160)
    return F.when(flat.rlike(CAPTION) & (F.size(F.split(flat, " ")) <= 18), flat)


def heading_level(text: Column, font_size: Column, body_size: Column) -> Column:
    """By the depth of a number in front, else by the size of the font."""
    number = F.regexp_extract(text, r"^\s*+(\d+(?:\.\d+)*)", 1)
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(number != "", F.least(depth + 1, F.lit(6))).when(font_size >= body_size * 1.75, 1).when(font_size >= body_size * 1.45, 2).otherwise(3)


def roles(text: Column) -> Column:
    """Names of the families of words that the text has, in order, joined by commas."""
    # the join leaves nulls out; compacting them first would lower-case the text once for each word
    return F.array_join(F.array(*(F.when(has_any(text, words), F.lit(role)) for role, words in ROLES.items())), ",")


def inner_path(path: Column) -> Column:
    """Parts of a path under the corpus root, without what is inside an attachment."""
    return F.split(F.element_at(F.split(F.regexp_replace(path, "^corpus/", ""), "#attachment/"), 1), "/")


def lineage(parts: Column) -> Column:
    """Every folder above a file, outermost first."""
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def may_be_exact(alias: Column) -> Column:
    """Aliases of a single character, or of two bare letters, never count as named."""
    toks, one = tokens(alias), F.try_element_at(tokens(alias), F.lit(1))
    bare = (F.length(one) <= 1) | ((F.length(one) == 2) & one.rlike("^[a-z]+$") & ~alias.rlike("[/.]"))
    return (F.size(toks) > 1) | ((F.size(toks) == 1) & ~bare)


def stem_aliases(stem: Column) -> Column:
    """A file's stem with spaces for dashes, as words, and without numbers and hexadecimal ids if two words are left."""
    spaced = F.regexp_replace(stem, "[_-]", " ")
    words = F.array_join(tokens(spaced), " ")
    named = F.filter(tokens(spaced), lambda t: ~t.rlike("^[0-9]+$|^[0-9a-f]{8,}$"))
    return F.array_distinct(F.array_compact(F.array(F.nullif(spaced, F.lit("")), F.when(may_be_exact(words), words), F.when(F.size(named) >= 2, F.array_join(named, " ")))))
