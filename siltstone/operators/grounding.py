"""Grounding answer text: segments, coverage by evidence, statuses, reasons, and the state of the answer."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import coverage, significant_terms, tokens
from siltstone.storage import settled

#: Limits of a trace and thresholds of the statuses.
SEGMENT_CHARS, SEGMENTS_MOST = 960, 24
GROUNDED = (6.0, 3.0, 0.75)
PARTIAL_TOTAL, PARTIAL_COVERAGE = 2.5, 0.35
SET_COVERAGE, SET_DIRECT = 0.6, 2.5
#: Terms of segments that all tasks get at once, and how many tasks the words of sources are dealt to for each shuffle partition.
BLOCK_TERMS, SPREAD = 200_000, 4
#: Meetings of words and segments that a task counts at once.
WALK_HITS = 1_000_000

SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")


def packed(paragraph: str) -> list[str]:
    """A paragraph in parts of at most SEGMENT_CHARS: as many whole sentences as fit, a longer sentence in slices of its own.

    ``end[i]`` is how far sentences 0 to i reach when they are joined by spaces, so the last one that fits is found by bisection.
    """
    sentences = [s.strip() for s in SENTENCE_END.split(paragraph) if s.strip()]
    if len(paragraph) <= SEGMENT_CHARS or not sentences:
        return [paragraph]
    end = [*accumulate(len(s) + 1 for s in sentences)]
    parts, i = [], 0
    while i < len(sentences):
        start = end[i] - len(sentences[i]) - 1
        fits = bisect_right(end, start + SEGMENT_CHARS + 1)
        if fits > i:
            parts.append(" ".join(sentences[i:fits]))
            i = fits
        else:
            parts += [sentences[i][at : at + SEGMENT_CHARS].strip() for at in range(0, len(sentences[i]), SEGMENT_CHARS)]
            i += 1
    return [p for p in parts if p]


def segmented(answer: str) -> tuple[list[str], int]:
    """The segments of an answer, and how many there were before the budget: the shortest neighbours that fit together are joined first."""
    parts = [p for paragraph in answer.split("\n\n") if paragraph.strip() for p in packed(paragraph.strip())]
    before = len(parts)
    while len(parts) > SEGMENTS_MOST:
        sizes = [len(a) + len(b) for a, b in zip(parts, parts[1:], strict=False)]
        i = sizes.index(min(sizes))  # if any pair fits, so does the shortest
        parts[i : i + 2] = [f"{parts[i]}\n\n{parts[i + 1]}".strip()]
    return parts, before


def segments(answers: DataFrame) -> DataFrame:
    """(answer_id, text) to (answer_id, segment, before, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts, before = segmented(r["text"] or "")
                out += [(r["answer_id"], i, before, p) for i, p in enumerate(parts)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["answer_id", "segment", "before", "text"])

    return answers.select("answer_id", "text").mapInArrow(run, "answer_id string, segment long, before long, text string")


def _blocks(segments_: DataFrame) -> list[DataFrame]:
    """(answer_id, segment, token) of the segments in blocks of about BLOCK_TERMS terms, each small enough to be sent to all tasks."""
    terms = settled(segments_.select("answer_id", "segment", significant_terms(F.col("text")).alias("terms")))
    n = (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS + 1
    return [terms.where(F.pmod(F.xxhash64("answer_id", "segment"), F.lit(n)) == k).select("answer_id", "segment", F.explode("terms").alias("token")) for k in range(n)]


def _best(wanted: DataFrame, evidence: DataFrame, top: int) -> DataFrame:
    """(answer_id, segment, source_id, matched, place) for a block: words that no segment has are dropped first, the others dealt out by source, where they are counted and the best ones chosen.

    Tasks go by a number: words shrink to little, but each meets all segments that have it, so tasks that go by bytes would hold too many. A task walks through its sources in their order, counts for about
    WALK_HITS meetings at once, and keeps ``top`` sources of each segment; nothing is held for pairs of segments and sources. Later sources must match more words than those that are kept.
    """
    spark = evidence.sparkSession
    rows = wanted.select("token", "answer_id", "segment").toArrow()  # BLOCK_TERMS rows
    words, names = rows["token"].combine_chunks().dictionary_encode(), rows.select(["answer_id", "segment"]).group_by(["answer_id", "segment"]).aggregate([]).combine_chunks()
    at = {k: i for i, k in enumerate(zip(*(names[c].to_pylist() for c in ("answer_id", "segment")), strict=True))}
    word, segment = words.indices.to_numpy(), np.array([at[k] for k in zip(rows["answer_id"].to_pylist(), rows["segment"].to_pylist(), strict=True)], np.int64)
    segment, starts = segment[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words.dictionary)))])
    known = spark.createDataFrame(pa.table({"token": words.dictionary, "word": pa.array(range(len(words.dictionary)), pa.int32())}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, floor, kept, held = len(at), np.zeros(len(at), np.int64), [np.zeros(0, np.int64)] * 2 + [np.zeros(0, object)], None
        for batch in chain(batches, [None]):
            rows = [b for b in (held, batch) if b is not None]
            if not rows:
                return
            ids, word = (pa.chunked_array([b.column(i) for b in rows]).combine_chunks() for i in (0, 1))
            ids, word = ids.dictionary_encode(null_encoding="encode"), word.to_numpy()
            source, ids = ids.indices.to_numpy(), ids.dictionary.to_numpy(zero_copy_only=False)
            if batch is not None:  # the last source may go on
                whole = int(np.searchsorted(source, source[-1])) if len(source) else 0
                held = pa.RecordBatch.from_arrays([pa.array(ids[source[whole:]], pa.string()), pa.array(word[whole:])], ["source_id", "word"])
                source, word = source[:whole], word[:whole]
            size = starts[word + 1] - starts[word]
            done = np.cumsum(size)
            while len(source):
                cut = max(int(np.searchsorted(done, done[0] - size[0] + WALK_HITS, "right")), 1)
                cut = int(np.searchsorted(source, source[cut] if cut < len(source) and source[cut] > source[0] else source[cut - 1] + 1))
                part = size[:cut]
                met = segment[np.repeat(starts[word[:cut]] - np.cumsum(part) + part, part) + np.arange(part.sum())]
                pair, matched = np.unique(np.repeat(source[:cut], part).astype(np.int64) * n + met, return_counts=True)
                more = matched > floor[pair % max(n, 1)]
                pair, matched = pair[more], matched[more]
                seg, count, who = (np.concatenate(x) for x in zip(kept, (pair % max(n, 1), matched, ids[pair // max(n, 1)]), strict=True))
                order = np.lexsort((-count, seg))  # stable: sources come in their order
                seg, count, who = seg[order], count[order], who[order]
                place = np.arange(len(seg)) - np.searchsorted(seg, seg)
                floor[seg[place == top - 1]] = count[place == top - 1]
                kept = [x[place < top] for x in (seg, count, who)]
                source, word, size, done = source[cut:], word[cut:], size[cut:], done[cut:]
        seg, count, who = kept
        yield pa.RecordBatch.from_arrays([names["answer_id"].combine_chunks().take(pa.array(seg)), names["segment"].combine_chunks().take(pa.array(seg)), pa.array(who, pa.string()), pa.array(count)], ["answer_id", "segment", "source_id", "matched"])

    dealt = evidence.join(F.broadcast(known), "token").select("source_id", "word").repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "source_id").sortWithinPartitions("source_id")
    hits = dealt.mapInArrow(run, "answer_id string, segment long, source_id string, matched long")
    order = Window.partitionBy("answer_id", "segment").orderBy(F.desc("matched"), "source_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def support(segments_: DataFrame, evidence: DataFrame, top: int = 3) -> DataFrame:
    """(answer_id, segment, place, source_id, matched, total): the sources whose words cover a segment best.

    ``evidence``: (source_id, token), distinct. ``total`` is 1.2 for each matched distinct token of the segment. Tokens meet by an equi-join, so stop words
    are left out on both sides beforehand. Segments come in blocks, and only ``top`` sources of each segment leave a task.
    """
    found = reduce(DataFrame.union, [_best(wanted, evidence, top) for wanted in _blocks(segments_)])
    return found.withColumn("total", F.col("matched") * 12 / 10)


def top_status(total, lexical, units, cover):
    need, words, share = GROUNDED
    partial = (cover >= PARTIAL_COVERAGE) & (total >= PARTIAL_TOTAL)
    return F.when((total >= need) & ((lexical >= words) | (units > 0)) & (cover >= share), "grounded").when(partial, "partially-grounded").otherwise("unresolved")


def set_status(status, cover, direct):
    """A set of sources can lift an unresolved segment to partial support, never further."""
    return F.when((status == "unresolved") & (cover >= SET_COVERAGE) & (direct >= SET_DIRECT), "partially-grounded").otherwise(status)


def reasons(status, final, total, cover, set_cover):
    """Codes in their fixed order, joined by commas."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(total.isNull(), "no-canonical-support"), F.when(total < PARTIAL_TOTAL, "low-top-result-score"), F.when(total.isNotNull() & (cover < PARTIAL_COVERAGE), "low-top-result-coverage"),
                F.when((status == "unresolved") & (final == "partially-grounded"), "support-set-partial-support"), F.when((status == "partially-grounded") & (final == "partially-grounded"), "top-result-partial-support"),
                F.when((set_cover < SET_COVERAGE) & (final == "unresolved"), "weak-support-set-coverage"), F.when(final == "grounded", "strong-top-result-support"),
            )
        ),
        ",",
    )


def statuses(segments_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every segment with its coverage by the top source and by the set of three, its status, the reasons, and the ids of the three."""
    parts = []
    for wanted in _blocks(segments_):
        best = settled(_best(wanted, evidence, 3))  # three rows a segment
        # words are asked for again of the sources that were found, so the others need not be taken apart
        again = evidence.join(F.broadcast(best.select("source_id").distinct()), "source_id", "left_semi").join(F.broadcast(wanted), "token").join(F.broadcast(best), ["answer_id", "segment", "source_id"], "left_semi")
        by_set = again.groupBy("answer_id", "segment").agg(F.countDistinct("token").alias("by_set"))
        parts.append((best, by_set, best.groupBy("answer_id", "segment").agg(F.sort_array(F.collect_set("source_id")).alias("supporting"))))
    shown, covered, supporting = (reduce(DataFrame.union, p) for p in zip(*parts, strict=True))
    shown = shown.withColumn("total", F.col("matched") * 12 / 10)
    terms = segments_.select("answer_id", "segment", significant_terms(F.col("text")).alias("terms"))
    best = shown.where("place = 1").select("answer_id", "segment", "source_id", "total", "matched")
    rows = terms.select("answer_id", "segment", F.size("terms").alias("n_terms")).join(best, ["answer_id", "segment"], "left").join(covered, ["answer_id", "segment"], "left").join(supporting, ["answer_id", "segment"], "left")
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("n_terms").cast("double")), F.lit(0.0))
    cover, set_cover, total = share(F.col("matched")), share(F.col("by_set")), F.col("total")
    status = F.when(total.isNull(), "unresolved").otherwise(top_status(total, total, F.lit(1), cover))
    rows = rows.withColumns({"top_coverage": cover, "set_coverage": set_cover, "top_status": status})
    rows = rows.withColumn("final_status", set_status(F.col("top_status"), F.col("set_coverage"), F.coalesce(total, F.lit(0.0))))
    codes = reasons(F.col("top_status"), F.col("final_status"), total, F.col("top_coverage"), F.col("set_coverage"))
    return rows.withColumn("reasons", codes).select("answer_id", "segment", "source_id", F.col("n_terms").cast("long").alias("n_terms"), "top_coverage", "set_coverage", "top_status", "final_status", "reasons", F.coalesce("supporting", F.array().cast("array<string>")).alias("supporting"))


def answer_states(traced: DataFrame) -> DataFrame:
    """(answer_id, segments, grounded, partial, unresolved, state)"""
    count = lambda s: F.count_if(F.col("final_status") == s)
    rolled = traced.groupBy("answer_id").agg(F.count("*").alias("segments"), count("grounded").alias("grounded"), count("partially-grounded").alias("partial"), count("unresolved").alias("unresolved"), F.countDistinct("source_id").alias("sources"))
    state = F.when(F.col("grounded") == F.col("segments"), "grounded").when(F.col("grounded") + F.col("partial") > 0, "partially-grounded").otherwise("unresolved")
    return rolled.withColumn("state", state)
