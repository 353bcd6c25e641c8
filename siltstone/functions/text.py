"""Text functions as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What ends a line, and what counts as white space.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
W = "[\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

TOKEN = "([0-9A-Za-z]+|[一-鿿]+)"

#: Words that never need support of their own.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "had", "has", "have", "how", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "there", "these", "this", "those", "to", "was", "were", "with",
]


def tokens(text: Column) -> Column:
    """ASCII alphanumeric or CJK runs, lower-cased after matching; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), F.lower)


def query_tokens(text: str) -> list[str]:
    """The same on the driver, for the text of a query."""
    return [t.lower() for t in re.findall(TOKEN, text)]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def present(text: Column) -> Column:
    """The text without outer white space; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def significant_terms(text: Column) -> Column:
    """Distinct tokens that must be covered: no stop words, and digits or two letters at least."""
    return F.filter(F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOPWORDS))), lambda t: t.rlike("^[0-9]+$") | (F.length(t) >= 2))


def coverage(terms: Column, matched: Column) -> Column:
    """The share of terms that are matched; 0 without terms."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(terms, matched)).cast("double"), F.size(terms).cast("double")), F.lit(0.0))


def guessed_language(text: Column) -> Column:
    """``en`` for text that is over 95 % ASCII, ``unknown`` for empty text, else ``other``."""
    text = F.coalesce(text, F.lit(""))
    share = F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.length(strip(text)) == 0, "unknown").when(share > 0.95, "en").otherwise("other")


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word; an ellipsis tells of the cut."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), r"\s\S*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(StringType())
def unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references as characters, all that HTML knows, with or without a semicolon where it allows that."""
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def html_to_text(source: Column) -> Column:
    """Text of HTML: no scripts or styles; breaks and block ends are line feeds; tags go, references are undone, blanks are squeezed, three line feeds or more are two, lines are stripped."""
    out = F.regexp_replace(source, r"(?is)<(script|style)\b.*?>.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|li|tr|h[1-6]|table|section|article)>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.when(out.contains("&"), unescaped(out)).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(out, LINE_END), lambda x: F.regexp_replace(x, f"^{W}+|{W}+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), f"^{W}+|{W}+$", "")


def duck_html_to_text(source: str) -> str:
    """The same as a DuckDB expression, for the references that the pages have."""
    out = rf"regexp_replace(regexp_replace({source}, '(?is)<script\b.*?>.*?</script>', ' ', 'g'), '(?is)<style\b.*?>.*?</style>', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|li|tr|h[1-6]|table|section|article)>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&middot;?", "·"), ("&copy;?", "©"), ("&quot;?", '"'), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{name}', '{char}', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(array_to_string(list_transform(string_split({out}, chr(10)), lambda l: regexp_replace(l, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g')"


def duck_tokens(text: str) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({text}, ''), '[0-9A-Za-z]+|[\x{{4e00}}-\x{{9fff}}]+'), lambda t: lower(t))"
