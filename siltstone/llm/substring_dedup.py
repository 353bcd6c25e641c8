"""Substring deduplication by content-defined chunks.

A gear hash rolls over the words of a text: the hash of each step is the last one, shifted left by 16 of its 64 bits, plus a fixed random
value of the word, so that four words decide it. A cut is where the (mixed) hash is least, the last of equals, among some ``reach``
consecutive ones, with 2 * reach + 3 <= ``min_words``. A chunk reaches from the four words of one cut to the four words of the next, so it has
5 words or more. An insertion moves the chunks after it but does not change them, and every ``min_words`` (50) words, repetitive ones
as well, hold a chunk that they alone decide: of the spans that lie within them there are more than one cut can be the least of, and a
span that reaches beyond them adds no cut between two of their own.

Chunks are deduplicated by digest: each is paired with its digest's first occurrence, by (doc_id, position). Pairs are the seeds from
which the exact shared passages are grown. Stretches of a short period would have a chunk at each word; of these only the chunks near both
ends are retained, as the stretch is itself a passage that repeats one period later (one more seed).

The first places of a passage's chunks may be in texts that hold only parts of it. So of what no passage found so far covers, all windows of
``min_words`` words whose chunks stand in three places or more are hashed, and each is paired with the first one of its hash. A chunk that
stands in two places has its pair already, and a window with a chunk that stands alone repeats nothing. So no passage is missed.

Texts that are null or empty have no chunks. Rows with a null id are left as they are. Rows that repeat an id are taken as texts of the
same document. Passages that a text repeats within itself count like those of other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.repeats import first_places, shared_passages, text_ids, thinned, with_own_ids, with_text_ids, without
from siltstone.llm.shared import discard, slices, small_batches, text_or_empty, written
from siltstone.llm.words import covered, least, mix, powers, spans_in_words, windows_of, words

CONTEXT, PERIOD = 4, 32
CHUNKS = "digest long, doc_id long, at int, nth int, bytes int, back int, back_nth int"
CHUNK_NAMES = [c.split(" ")[0] for c in CHUNKS.split(", ")]


def cuts(hashes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of one text, by the first of their four words, and for each the first and the last span of ``reach`` gear hashes that it is the least of."""
    n = len(hashes) - CONTEXT + 1
    if n < reach:
        return (np.zeros(0, np.int64),) * 3
    gear = np.zeros(n, np.uint64)
    values = mix(hashes + np.uint64(0x5851F42D4C957F2D))
    for back in range(CONTEXT):
        ahead = CONTEXT - 1 - back
        gear += values[ahead : ahead + n] << np.uint64(16 * back)
    by_span = least(mix(gear), reach)  # never decreases
    first = np.flatnonzero(np.append(True, by_span[1:] != by_span[:-1]))
    return by_span[first], first, np.append(first[1:], len(by_span)) - 1


def stretches(hashes: np.ndarray, begin: np.ndarray, digest: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first word, end, period) of stretches with a period of up to 32 words that repeat at least ``least`` words one period later."""
    order = np.argsort(digest, kind="stable")
    apart = np.diff(begin[order])[digest[order][1:] == digest[order][:-1]]
    found = []
    for period in np.unique(apart[apart <= PERIOD]):
        same = np.concatenate([[False], hashes[period:] == hashes[:-period], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        found += [(int(a), int(b + period), int(period)) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a >= least]
    return found


def chunks_of(hashes: np.ndarray, min_words: int):
    """Chunks of one text: (begin, end, digest, low, high, retained), and the stretches of a short period.

    ``low`` to ``high`` are the first words of all windows of ``min_words`` words that alone decide the chunk.
    """
    reach = max(1, (min_words - CONTEXT + 1) // 2)
    at, first, last = cuts(hashes, reach)
    begin, end = at[:-1], at[1:] + CONTEXT
    power, inverse = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    digest = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    retained, periodic = np.ones(len(begin), bool), stretches(hashes, begin, digest, min_words)
    for a, b, period in periodic:
        retained &= (begin < a + period + min_words) | (end > b - period - min_words)
    return begin, end, digest, first[1:] + reach + CONTEXT - 1 - min_words, last[:-1], retained, periodic


def _chunk_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                w = words(texts.slice(a, b - a))
                parts: list[list[np.ndarray]] = [[] for _ in range(7)]
                for d in range(b - a):
                    low, high = w.first[d], w.first[d + 1]
                    if high - low < min_words:
                        continue
                    start, stop = w.start[low:high] - w.offsets[d], w.end[low:high] - w.offsets[d]
                    begin, end, digest, _, _, retained, periodic = chunks_of(w.hash[low:high], min_words)
                    begin, end = begin[retained], end[retained]
                    rows = [(digest[retained].view(np.int64), np.full(len(begin), a + d), start[begin], begin, stop[end - 1] - start[begin], np.full(len(begin), -1), np.full(len(begin), -1))]
                    for x, y, period in periodic:
                        rows.append(([0], [a + d], [start[x + period]], [x + period], [stop[y - 1] - start[x + period]], [start[x]], [x]))
                    for row in rows:
                        for part, x in zip(parts, row, strict=True):
                            part.append(np.asarray(x))
                if parts[0]:
                    digest, owner, *rest = (np.concatenate(p) for p in parts)
                    yield pa.RecordBatch.from_arrays([pa.array(digest), ids.take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in rest)], CHUNK_NAMES)

    return run


def _window_rows(min_words: int):
    """The windows of ``min_words`` words all of whose chunks stand in three places or more (``places``) and that no passage (``spans``) covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places, spans = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                w = words(texts.slice(i, 1))
                every = windows_of(w.hash, min_words)
                if not len(every):
                    continue
                begin, end, _, low, high, retained, _ = chunks_of(w.hash, min_words)
                often = np.isin(w.start[begin], places[i].values.to_numpy())
                alone = retained & ~often
                open_ = covered(low[often], high[often] + 1, len(every)) & ~covered(low[alone], high[alone] + 1, len(every))
                first, end_of = spans_in_words(w, spans[i])
                at = np.flatnonzero(open_ & ~covered(first, end_of - min_words + 1, len(every)))
                size = w.end[at + min_words - 1] - w.start[at]
                yield pa.RecordBatch.from_arrays([pa.array(every[at].view(np.int64)), pa.array(np.full(len(at), ids[i].as_py(), np.int64)), *(pa.array(x.astype(np.int32)) for x in (w.start[at], at, size))], ["digest", "doc_id", "at", "nth", "bytes"])

    return run


LATER = "b_id <> a_id or b_at <> a_at"


def _uncovered(docs: DataFrame, paired: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Seeds for passages whose chunks come first elsewhere, in texts that hold only parts of the passage."""
    places = paired.where("n > 2").groupBy(F.col("b_id").alias("_doc")).agg(F.collect_list(F.col("b_at").cast("long")).alias("places"))
    spans = found.groupBy(F.col("doc_id").alias("_span_doc")).agg(F.collect_set(F.struct("span_start", "span_end")).alias("spans"))
    rows = docs.join(places, F.col("doc_id") == F.col("_doc")).join(spans, F.col("doc_id") == F.col("_span_doc"), "left")
    rows = rows.select("doc_id", "text", "places", "spans").mapInArrow(_window_rows(min_words), "digest long, doc_id long, at int, nth int, bytes int")
    return thinned(first_places(written(rows, "windows")).where(LATER).drop("n"), min_words)


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text) to one row for each passage of a text that an earlier place has as well.

    (doc_id, span_start, span_end, n_words, other_id, other_start, other_end): bytes of ``doc_id``'s text, and the earlier place. Of different texts that share
    an id, all but one stand behind all other documents; equal rows are one text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = text_ids(docs)
    return with_own_ids(_passages(with_text_ids(docs, ids), min_words), ids)


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    chunks = written(docs.mapInArrow(_chunk_rows(min_words), CHUNKS), "chunks")
    later = chunks.where("back >= 0").select(F.col("doc_id").alias("b_id"), F.col("at").alias("b_at"), F.col("nth").alias("b_nth"), F.col("doc_id").alias("a_id"), F.col("back").alias("a_at"), F.col("back_nth").alias("a_nth"), "bytes")
    paired = written(first_places(chunks.where("back < 0").drop("back", "back_nth")), "paired")
    found = written(shared_passages(docs, paired.where(LATER).drop("n").union(later), min_words), "passages")
    discard(chunks)
    rest = written(shared_passages(docs, _uncovered(docs, paired, found, min_words), min_words), "passages")
    discard(paired)
    return found.union(rest).distinct()


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with each repeated passage kept at its first place alone; rows and other columns stay as they are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = text_ids(texts)
    return without(docs, written(_passages(with_text_ids(texts, ids), min_words), "repeats"), ids)
