"""From seeds, places where two texts agree, to the whole passages that they share.

A seed says that text ``b_id`` from byte ``b_at`` and text ``a_id`` from byte ``a_at`` agree for ``size`` words. Seeds of the same two
texts on about the same diagonal are one request. A request reads from each text only the bytes around its seeds (sliced by the JVM), so
a long text that very many others copy from is never handed to Python whole. The slices are compared word by word from a seed to the
left and to the right. White space does not count: a passage that is wrapped in another way is still the same.

A seed also says which word of its text it is (``b_nth``, ``a_nth``), so matches of the same two texts with the same shift in words are united
where they touch. An end at which a match left its slice, not at a mismatch or at the end of a text, is open: from its last word there the
comparison goes on in a wider slice, until no end is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, text_or_empty, written
from siltstone.llm.words import SPACE

#: Bytes that the first slice holds beyond the outermost seeds, and by how much each next one is wider.
MARGIN, WIDER = 2048, 8
#: Seeds of two texts that are this near, in bytes and in the shift between the texts, are compared as one.
NEAR = 1024
#: So many ids may be broadcast.
FEW_IDS = 1 << 17

#: Words low to high (exclusive) of b_id's text, and the first bytes of the first and of the last word and the end.
MATCHES = "b_id long, a_id long, b_bytes long, a_bytes long, shift long, low long, high long, b_start long, a_start long, b_last long, a_last long, b_end long, a_end long, open_left boolean, open_right boolean"
NAMES = [c.split(" ")[0] for c in MATCHES.split(", ")]


def common(x: list, y: list) -> int:
    """The length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # x[:low] == y[:low], x[:high] != y[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def located(piece: bytes, at: int, total: int) -> tuple[list[bytes], np.ndarray]:
    """Whole words of a slice that begins at byte ``at`` of a text of ``total`` bytes, and where each begins in the text."""
    words = piece.split()
    space = SPACE[np.frombuffer(piece, np.uint8)]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) + at
    if words and at > 0 and not space[0]:
        words, start = words[1:], start[1:]
    if words and at + len(piece) < total and not space[-1]:
        words, start = words[:-1], start[:-1]
    return words, start


def _extended():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            requests = (batch.column(c).to_pylist() for c in ("b_id", "a_id", "b_from", "a_from", "b_bytes", "a_bytes", "b_piece", "a_piece"))
            seeds, turns = batch.column("seeds"), batch.column("seeds").offsets.to_pylist()
            flat = list(zip(*(c.to_pylist() for c in seeds.values.flatten()), strict=True))
            for k, (b_id, a_id, b_from, a_from, b_bytes, a_bytes, b_piece, a_piece) in enumerate(zip(*requests, strict=True)):
                b, b_start = located(b_piece, b_from, b_bytes)
                a, a_start = located(a_piece, a_from, a_bytes)
                done: list[tuple[int, int, int]] = []
                b_more, a_more = b_from + len(b_piece) < b_bytes, a_from + len(a_piece) < a_bytes
                for b_at, a_at, b_nth, a_nth in sorted(flat[turns[k] : turns[k + 1]]):
                    i, j = int(b_start.searchsorted(b_at)), int(a_start.searchsorted(a_at))
                    if i >= len(b) or j >= len(a) or b_start[i] != b_at or a_start[j] != a_at:
                        continue
                    if any(f <= i < t and i - j == d for f, t, d in done):
                        continue
                    left, right = common(b[:i][::-1], a[:j][::-1]), common(b[i:], a[j:])
                    if not right:
                        continue
                    done.append((i - left, i + right, i - j))
                    open_left = bool(left == min(i, j) and (left < i or b_from > 0) and (left < j or a_from > 0))
                    open_right = bool(right == min(len(b) - i, len(a) - j) and (right < len(b) - i or b_more) and (right < len(a) - j or a_more))
                    i0, i1, j0, j1 = i - left, i + right - 1, j - left, j + right - 1
                    ends = [int(x) for x in (b_start[i0], a_start[j0], b_start[i1], a_start[j1], b_start[i1] + len(b[i1]), a_start[j1] + len(a[j1]))]
                    out.append((b_id, a_id, b_bytes, a_bytes, b_nth - a_nth, b_nth - left, b_nth + right, *ends, open_left, open_right))
            columns = list(zip(*out, strict=True)) or [[]] * len(NAMES)
            kinds = [*[pa.int64()] * 13, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    return run


def _digest(text: Column) -> Column:
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit("text"), text), F.octet_length(text))


def text_ids(docs: DataFrame) -> DataFrame | None:
    """(_id, _digest, _text_id) of texts that share their id with a lesser text (by digest): ids of their own, behind all others (before them, if ids go beyond 2**62); None without any.

    So texts of one id are told apart, and what one of them repeats is never cut from another.
    """
    digests = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), _digest(F.col("text")).alias("_digest"))
    several = digests.groupBy("_id").agg(F.min("_digest").alias("_low"), F.max("_digest").alias("_high")).where("_low <> _high").select("_id", "_low")
    more = written(digests.distinct().join(several, "_id").where("_digest <> _low").select("_id", "_digest", F.monotonically_increasing_id().alias("_n")), "more")
    if more.isEmpty():
        return None
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    # above the ids; below them where these reach the top
    free = F.lit(max(high, 0) + 1) + F.col("_n") if high < 1 << 62 else F.lit(min(low, 0) - 1) - F.col("_n")
    return more.select("_id", "_digest", free.alias("_text_id"))


def with_text_ids(rows: DataFrame, ids: DataFrame | None, own: str = "doc_id") -> DataFrame:
    """``rows`` (``own``, text) with the ids of ``text_ids`` in place of their own."""
    if ids is None:
        return rows
    met = rows.withColumn("_own_digest", _digest(text_or_empty())).join(ids, (F.col(own) == F.col("_id")) & (F.col("_own_digest") == F.col("_digest")), "left")
    return met.withColumn(own, F.coalesce("_text_id", own)).drop("_id", "_digest", "_own_digest", "_text_id")


def with_own_ids(passages: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Passages with the ids that the documents came with."""
    if ids is None:
        return passages
    for c in ("doc_id", "other_id"):
        passages = passages.join(ids.select(F.col("_id"), F.col("_text_id")), F.col(c) == F.col("_text_id"), "left").withColumn(c, F.coalesce("_id", c)).drop("_id", "_text_id")
    return passages


def thinned(seeds: DataFrame, words: int) -> DataFrame:
    """Of seeds of ``words`` words each, the first in each ``words`` words of b_id's text among those of the same texts and shift.

    Two of these that begin in the same ``words`` words overlap or touch, so they lie in one passage.
    """
    key = ["b_id", "a_id", F.expr("b_nth - a_nth").alias("_d"), F.floor(F.col("b_nth") / words).alias("_p")]
    first = F.min(F.struct("b_nth", "b_at", "a_nth", "a_at", "bytes")).alias("s")
    return seeds.groupBy(*key).agg(first).select("b_id", "s.b_at", "s.b_nth", "a_id", "s.a_at", "s.a_nth", "s.bytes")


def first_places(rows: DataFrame) -> DataFrame:
    """Each row of (digest, doc_id, at, nth, bytes) with the first place of its digest and the number of its places, from two on.

    The first places are a table of their own, so that the rows of a very frequent digest can be dealt to several tasks.
    """
    firsts = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "at", "nth")).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = rows.join(written(firsts, "firsts"), "digest")
    return named.select(F.col("doc_id").alias("b_id"), F.col("at").alias("b_at"), F.col("nth").alias("b_nth"), F.col("first.doc_id").alias("a_id"), F.col("first.at").alias("a_at"), F.col("first.nth").alias("a_nth"), "bytes", "n")


def _asked(whole: DataFrame, requests: DataFrame) -> DataFrame:
    """``whole`` without texts that no request names, if these are so few that their ids (8 bytes each) may be broadcast."""
    ids = written(requests.select(F.col("a_id").alias("_asked")).union(requests.select("b_id")).distinct(), "asked")
    return whole.join(F.broadcast(ids), F.col("doc_id") == F.col("_asked"), "left_semi") if ids.count() <= FEW_IDS else whole


def _compared(whole: DataFrame, seeds: DataFrame, margin: int) -> DataFrame:
    """Matches around the seeds, as far as slices of ``margin`` bytes beyond the outermost ones show them."""
    near_by = seeds.groupBy("b_id", "a_id", F.round((F.col("b_at") - F.col("a_at")) / NEAR).alias("_shift"), F.floor(F.col("b_at") / (16 * NEAR)).alias("_part")).agg(
        F.min("b_at").alias("b_low"), F.max(F.col("b_at") + F.col("bytes")).alias("b_high"), F.min("a_at").alias("a_low"), F.max(F.col("a_at") + F.col("bytes")).alias("a_high"), F.collect_list(F.struct("b_at", "a_at", "b_nth", "a_nth")).alias("seeds")
    )

    def sliced(requests: DataFrame, side: str) -> DataFrame:
        low = F.greatest(F.col(f"{side}_low") - margin, F.lit(0)).cast("int")
        size = (F.col(f"{side}_high") + margin - low).cast("int")
        with_text = requests.join(whole, requests[f"{side}_id"] == whole["doc_id"])
        return with_text.withColumns({f"{side}_from": low, f"{side}_piece": F.substring("body", low + 1, size), f"{side}_bytes": F.length("body")}).drop("doc_id", "body")

    near_by = written(near_by, "requests")
    whole = _asked(whole, near_by)
    pieces = sliced(sliced(near_by, "a"), "b")
    rows = pieces.select("b_id", "a_id", "b_from", "a_from", "b_bytes", "a_bytes", "b_piece", "a_piece", "seeds").mapInArrow(_extended(), MATCHES)
    rows = written(rows, "compared")
    discard(near_by)
    return rows


def _united(matches: DataFrame) -> DataFrame:
    """Matches with the same shift that touch or overlap, as one; an end is open where none of those that reach it ends there for good."""
    key = ["b_id", "a_id", "b_bytes", "a_bytes", "shift"]
    order = Window.partitionBy(*key).orderBy("low", "high")
    parts = matches.withColumn("_before", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("_island", F.sum(F.when(F.col("low") > F.col("_before"), 1).otherwise(0)).over(order))
    both = parts.groupBy(*key, "_island").agg(
        F.min(F.struct("low", "open_left", "b_start", "a_start")).alias("l"),
        F.max(F.struct("high", (~F.col("open_right")).alias("shut"), "b_last", "a_last", "b_end", "a_end")).alias("r"),
    )
    return both.select(*key, "l.low", "r.high", "l.b_start", "l.a_start", "r.b_last", "r.a_last", "r.b_end", "r.a_end", "l.open_left", (~F.col("r.shut")).alias("open_right"))


def grown(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``seeds`` (b_id, b_at, b_nth, a_id, a_at, a_nth, bytes) to the passages of any length around them.

    Offsets are bytes of the UTF-8 text, ends are exclusive; ``b_nth`` and ``a_nth`` count words. Each passage is returned once and whole.
    """
    whole = docs.where("doc_id is not null").select("doc_id", F.encode(text_or_empty(), "utf-8").alias("body"))
    margin = MARGIN
    compared = _compared(whole, seeds, margin)
    found = written(_united(compared), "united")
    discard(compared)
    while not (further := found.where("open_left or open_right")).isEmpty():
        margin *= WIDER
        left = further.where("open_left").select("b_id", F.col("b_start").alias("b_at"), F.col("low").alias("b_nth"), "a_id", F.col("a_start").alias("a_at"), (F.col("low") - F.col("shift")).alias("a_nth"), F.lit(0).alias("bytes"))
        right = further.where("open_right").select("b_id", F.col("b_last").alias("b_at"), (F.col("high") - 1).alias("b_nth"), "a_id", F.col("a_last").alias("a_at"), (F.col("high") - 1 - F.col("shift")).alias("a_nth"), (F.greatest(F.col("b_end") - F.col("b_last"), F.col("a_end") - F.col("a_last"))).alias("bytes"))
        more = _compared(whole, left.union(right), margin)
        before, found = found, written(_united(found.union(more)), "united")
        discard(before)
    return found.select(F.col("b_id").alias("doc_id"), F.col("b_start").alias("span_start"), F.col("b_end").alias("span_end"), (F.col("high") - F.col("low")).alias("n_words"), F.col("a_id").alias("other_id"), F.col("a_start").alias("other_start"), F.col("a_end").alias("other_end"))


def shared_passages(docs: DataFrame, seeds: DataFrame, min_words: int) -> DataFrame:
    """The passages of ``min_words`` or more around the seeds, as ``grown`` has them."""
    return grown(docs, seeds).where(F.col("n_words") >= min_words).distinct()


def without(docs: DataFrame, spans: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``docs`` with the bytes of ``spans`` (doc_id, span_start, span_end) cut from ``text``; overlapping spans are united.

    ``spans`` name documents by ``ids`` of ``text_ids``, if given. All columns and rows stay; a text without spans is unchanged, what is left of others is joined by single line feeds.
    """
    by_doc = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans"))
    # keep[i] runs from the furthest end before span i to its start
    pieces = F.expr(
        """transform(sequence(0, size(_spans)), i -> named_struct(
             'low', coalesce(array_max(transform(slice(_spans, 1, i), s -> s.span_end)), 0L),
             'high', if(i = size(_spans), cast(octet_length(text) as long), element_at(_spans, least(i + 1, size(_spans))).span_start)))"""
    )
    body = F.expr(
        r"""array_join(filter(transform(_keep, p -> regexp_replace(decode(substring(encode(text, 'utf-8'), cast(p.low as int) + 1, greatest(cast(p.high - p.low as int), 0)), 'utf-8'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '')), x -> x <> ''), '\n')"""
    )
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), "text")  # set aside, whatever the names of its columns
    rows = with_text_ids(rows, ids, "_doc")
    joined = rows.join(by_doc, F.col("_doc") == F.col("_id"), "left").withColumn("_keep", pieces)
    joined = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(body))
    return joined.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
