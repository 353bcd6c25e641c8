"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts (at word boundaries) only those are retained that begin at a minimiser: the word 10-gram whose hash is least among 40
consecutive ones. Any passage of 49 words or more holds at least one, and holds it in every text. A retained suffix is represented by three
hashes, of its words 0-9, 10-29 and 30-59, compared in this order.

The suffixes are sorted over the cluster by range, ties of one 10-gram included, so a passage that a third of all texts share is
spread over many tasks. Equal suffixes are a run, whose first member is the earliest place. Each of a run is compared with this first one, and first ones with
that of the run before, where they begin with the same 10-gram; such a pair is the seed of a match, which is then
extended left and right in the texts. Runs that go on beyond a sorted partition are joined at its border.

Suffixes are sorted by what follows, so a neighbour may agree in fewer than ``min_words`` although a third text with the same 10-gram agrees in more, and a place
that comes before both of its neighbours need not be the first of its passage. Where a 10-gram stands in three places or more, all windows of ``min_words`` words
that hold it and that no match found so far names as a later place are hashed, and each is compared with the first one of its hash. The first place of a window
is never a later one, so it is among them: every later place of every window is named.

Null and empty texts have no suffixes; rows with a null id take no part; rows that repeat an id are texts of the same document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.repeats import first_places, shared_passages, text_ids, thinned, with_own_ids, with_text_ids
from siltstone.llm.shared import discard, slices, small_batches, text_or_empty, written
from siltstone.llm.words import covered, least, spans_in_words, windows_of, words

GRAM, WINDOW = 10, 40
SUFFIXES = "h0 long, h1 long, h2 long, doc_id long, at int, nth int, bytes int"


def minimisers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose hash is least (the last of equals) in some window of consecutive positions."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    at = least(hashes, min(window, len(hashes)))  # never decreases
    return at[np.append(True, at[1:] != at[:-1])]


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            w = words(texts.slice(a, b - a))
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            padded = np.zeros(len(w.hash) + 60 * (b - a), np.uint64)  # beyond the end of each text: one word that no text has
            padded[np.arange(len(w.hash)) + np.repeat(60 * np.arange(b - a), np.diff(w.first))] = w.hash
            grams, second, third = (windows_of(padded[skip:], k) for skip, k in ((0, GRAM), (10, 20), (30, 30)))
            for d in range(b - a):
                low, high = w.first[d], w.first[d + 1]
                if high - low < GRAM:
                    continue
                begin = low + 60 * d
                at = minimisers(grams[begin : begin + high - low - GRAM + 1])
                by = begin + at
                for part, x in zip(parts, (grams[by].view(np.int64), second[by].view(np.int64), third[by].view(np.int64), np.full(len(at), a + d), w.start[low + at] - w.offsets[d], at, w.end[low + at + GRAM - 1] - w.start[low + at]), strict=True):
                    part.append(x)
            if parts[0]:
                h0, h1, h2, rows, *rest = (np.concatenate(p) for p in parts)
                yield pa.RecordBatch.from_arrays([pa.array(h0), pa.array(h1), pa.array(h2), ids.take(pa.array(rows)), *(pa.array(x.astype(np.int32)) for x in rest)], NAMES)


NAMES = ["h0", "h1", "h2", "doc_id", "at", "nth", "bytes"]


def _runs(both: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted suffixes: the row that each is compared with, whether both have the same 10-gram, and whether more than two rows may have it."""
    h0, h1, h2 = (both.column(c).to_numpy() for c in ("h0", "h1", "h2"))
    n = len(h0)
    opens = np.ones(n, bool)
    opens[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    starts = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    partner = np.where(opens, starts[np.maximum(run - 1, 0)], starts[run])
    same = h0[partner] == h0
    same[0] = False
    turns = np.concatenate([[0], np.flatnonzero(h0[1:] != h0[:-1]) + 1, [n]])
    sizes = np.diff(turns)
    sizes[[0, -1]] = n + 3  # may go on in the batches before and after
    return partner, same, np.repeat(sizes, np.diff(turns)) > 2


def neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """Pairs of suffixes with the same 10-gram, within partitions and across their borders; ``more`` if a third one may have it."""
    pairs = "inner boolean, more boolean, part int, last boolean, " + ", ".join(f"{s}_{c}" for s in "ba" for c in SUFFIXES.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch.select(NAMES)])
            first = first or now.slice(0, 1)
            both = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            partner, same, more = _runs(both)
            at = np.flatnonzero(same)
            yield from _rows(both.take(pa.array(at)), both.take(pa.array(partner[at])), True, part, False, more[at])
            last = both.num_rows - 1
            opened = last if last == 0 or not _equal(both, last) else int(partner[last])
            held = both.slice(opened, 1)
        if held is not None:
            yield from _rows(first, first, False, part, False, [True])
            yield from _rows(held, held, False, part, True, [True])

    def _equal(both: pa.Table, i: int) -> bool:
        """Whether a suffix goes on with the run before it."""
        return all(both.column(c)[i] == both.column(c)[i - 1] for c in ("h0", "h1", "h2"))

    def _rows(b: pa.Table, a: pa.Table, inner: bool, part: int, last: bool, more):
        n = b.num_rows
        fixed = {"inner": pa.array([inner] * n), "more": pa.array(more, pa.bool_()), "part": pa.array([part] * n, pa.int32()), "last": pa.array([last] * n)}
        yield from pa.table(fixed | {f"{s}_{c}": t.column(c) for s, t in (("b", b), ("a", a)) for c in NAMES}).to_batches()

    found = written(sorted_suffixes.mapInArrow(run, pairs), "neighbours")
    a, b = [f"a_{c}" for c in NAMES], [f"b_{c}" for c in NAMES]
    edge = found.where("not inner").select("more", "part", "last", *b)  # two rows a partition
    order = Window.orderBy("part", "last")
    across = edge.select("more", "part", "last", *b, *(F.lag(x).over(order).alias(y) for x, y in zip(b, a, strict=True))).where("not last and a_h0 = b_h0")
    return found.where("inner").select("more", *b, *a).union(across.select("more", *b, *a))


def _window_rows(min_words: int):
    """The windows of min_words words that hold the 10-gram at one of the given places and that no passage (``spans``) covers, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places, spans = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                w = words(texts.slice(i, 1))
                every = windows_of(w.hash, min_words)
                if not len(every):
                    continue
                at = np.searchsorted(w.start, places[i].values.to_numpy())
                first, end = spans_in_words(w, spans[i])
                wanted = covered(at - (min_words - GRAM), at + 1, len(every)) & ~covered(first, end - min_words + 1, len(every))
                begin = np.flatnonzero(wanted)
                size = w.end[begin + min_words - 1] - w.start[begin]
                yield pa.RecordBatch.from_arrays([pa.array(every[begin].view(np.int64)), pa.array(np.full(len(begin), ids[i].as_py(), np.int64)), *(pa.array(x.astype(np.int32)) for x in (w.start[begin], begin, size))], ["digest", "doc_id", "at", "nth", "bytes"])

    return run


def _settled(docs: DataFrame, pairs: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Seeds for later places of windows that no passage found so far names as such."""
    sides = reduce(DataFrame.union, (pairs.where("more").select(F.col(f"{s}_doc_id").alias("_doc"), F.col(f"{s}_at").cast("long").alias("at")) for s in "ab"))
    places = sides.groupBy("_doc").agg(F.collect_set("at").alias("places"))  # of one text
    spans = found.groupBy(F.col("doc_id").alias("_span_doc")).agg(F.collect_set(F.struct("span_start", "span_end")).alias("spans"))
    rows = docs.join(places, F.col("doc_id") == F.col("_doc")).join(spans, F.col("doc_id") == F.col("_span_doc"), "left")
    rows = rows.select("doc_id", "text", "places", "spans").mapInArrow(_window_rows(min_words), "digest long, doc_id long, at int, nth int, bytes int")
    return thinned(first_places(written(rows, "windows")).where("b_id <> a_id or b_at <> a_at").drop("n"), min_words)


def suffix_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text) to the passages of ``min_words`` or more that an earlier place has as well.

    (doc_id, span_start, span_end, n_words, other_id, other_start, other_end), byte offsets, the other place before this one by (id, offset).
    The rows of a text cover every window of ``min_words`` words that an earlier place has, and nothing else. Texts that share an id are told apart as in
    ``substring_dedup``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = text_ids(docs)
    return with_own_ids(_passages(with_text_ids(docs, ids), min_words), ids)


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    suffixes = docs.mapInArrow(_suffix_rows, SUFFIXES)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h0", "h1", "h2", "doc_id", "at"]
    suffixes = written(suffixes, "suffixes")
    pairs = neighbours(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    discard(suffixes)
    pairs = pairs.where("a_doc_id <> b_doc_id or a_at <> b_at")
    swap = F.expr("a_doc_id > b_doc_id or (a_doc_id = b_doc_id and a_at > b_at)")
    pick = lambda side, c: F.when(swap, F.col(f"{'a' if side == 'b' else 'b'}_{c}")).otherwise(F.col(f"{side}_{c}"))
    seeds = pairs.select(pick("b", "doc_id").alias("b_id"), pick("b", "at").alias("b_at"), pick("b", "nth").alias("b_nth"), pick("a", "doc_id").alias("a_id"), pick("a", "at").alias("a_at"), pick("a", "nth").alias("a_nth"), F.greatest("a_bytes", "b_bytes").alias("bytes"))
    found = written(shared_passages(docs, seeds, min_words), "passages")
    rest = written(shared_passages(docs, _settled(docs, pairs, found, min_words), min_words), "passages")
    discard(pairs)
    return found.union(rest).distinct()
