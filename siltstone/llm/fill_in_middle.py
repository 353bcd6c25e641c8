"""Fill-in-middle documents by escaped marker injection, with DataFrame functions only.

A text is cut into units (lines, if no other pattern is given). A delimiter is escaped where the text has it, and appended after every
unit; the delimiters are counted, two ranks from 0 to that count are drawn from the digest of the id, and ``substring_index`` takes the parts
before, between and after the two. Then delimiters go and escapes are taken back. The middle is moved behind the suffix:
prefix-suffix-middle (psm) or suffix-prefix-middle (spm), each part behind its marker.

A text that is empty or has a marker of its own stays plain, so every output can be undone: ``restored`` finds the markers from left to right, as no part holds one.
Null text counts as empty, a null id is drawn as the word ``null``. Rows that repeat an id are cut at the same ranks. A pattern for
units must match the whole text from left to right, and end no unit right after U+0002, the escape character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import text_or_empty

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "7", 100, 50
DELIMITER, ESCAPE = "\x01", "\x02"
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(marked: Column) -> Column:
    """A part of a marked text as it was: without the delimiters that were put in."""
    plain = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _before(marked: Column, rank: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def transformed(docs: DataFrame, units: str = LINES, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, text, n, form, prefix_chars, middle_chars, output).

    ``rate`` percent of the texts that can be are transformed, ``spm`` percent of these to suffix-prefix-middle.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), units, "$0" + DELIMITER)).withColumn("digest", digest)
    drawn = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("n", (F.char_length("marked") - F.char_length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    rows = rows.withColumns({"low": F.least(drawn(0) % (F.col("n") + 1), drawn(1) % (F.col("n") + 1)), "high": F.greatest(drawn(0) % (F.col("n") + 1), drawn(1) % (F.col("n") + 1))})
    plain = (F.col("text") == "") | (drawn(2) % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("text", F.lit(marker))
    rows = rows.withColumn("form", F.when(plain, "plain").when(drawn(3) % 100 < spm, "spm").otherwise("psm"))
    # the last delimiter is behind the last unit, so what follows the high rank is n - high delimiters and the end
    rows = rows.withColumns({
        "prefix": unescaped(_before(F.col("marked"), F.col("low"))),
        "middle": unescaped(_before(_before(F.col("marked"), F.col("high")), F.col("low") - F.col("high"))),
        "suffix": unescaped(_before(F.col("marked"), F.col("high") - F.col("n") - 1)),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_text = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    chars = lambda part: F.when(F.col("form") != "plain", F.char_length(part).cast("long"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_text).otherwise(F.col("text"))
    return rows.select("doc_id", "text", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""

    def behind(text: Column, part: Column) -> Column:
        """What follows ``part`` and the marker after it."""
        return F.substring(text, F.char_length(part) + F.lit(len(MIDDLE) + 1), F.char_length(text))

    def parts(second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))
        first = F.substring_index(rest, second, 1)
        rest = behind(rest, first)
        middle_marker = F.substring_index(rest, MIDDLE, 1)
        return first, middle_marker, behind(rest, middle_marker)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def round_trip(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    rows = transformed(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


#: The same in DuckDB's SQL, over lists of lines.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS a, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:n], ''), '') AS z FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
