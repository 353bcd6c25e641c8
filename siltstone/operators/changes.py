"""Change detection between two inventories: identity, classification, statistics, signatures, materiality."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values.
CLASSES = ["unchanged", "modified", "moved_or_renamed", "ambiguous", "added", "deleted"]
NAME_LEAST, SIZE_LEAST, NAME_SHARE = 0.65, 0.9, 0.7
PARTS = 16


def classified(now: DataFrame, before: DataFrame) -> DataFrame:
    """(current_path, source_id, change, basis, traits) for all files of either inventory.

    A path that was there before keeps its source. Of the rest, a fingerprint that exactly one source without its path has moves that source; several make
    it ambiguous. What is left is new; sources that nothing has claimed are deleted. A source that several new paths could claim goes to the first path.
    """
    old = before.select(F.col("source_id").alias("old_id"), F.col("current_path").alias("old_path"), F.col("fingerprint").alias("old_print"))
    by_path = now.join(old, now["current_path"] == old["old_path"], "left")
    stay = by_path.where("old_id is not null").select("current_path", F.col("old_id").alias("source_id"), F.when(F.col("fingerprint") == F.col("old_print"), "unchanged").otherwise("modified").alias("change"), F.lit("path").alias("basis"))
    strangers = by_path.where("old_id is null").select("current_path", "fingerprint")
    free = old.join(now.select(F.col("current_path").alias("old_path")), "old_path", "left_anti")
    twins = free.groupBy(F.col("old_print").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("old_id").alias("only_id"))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("current_path"))
    met = strangers.join(twins, "fingerprint", "left").withColumn("turn", first)
    change = F.when(F.col("n").isNull() | ((F.col("n") == 1) & (F.col("turn") > 1)), "added").when(F.col("n") == 1, "moved_or_renamed").otherwise("ambiguous")
    others = met.select("current_path", change.alias("change"), "only_id").select("current_path", F.when(F.col("change") == "moved_or_renamed", F.col("only_id")).alias("source_id"), "change", F.when(F.col("change") == "added", "new").otherwise("fingerprint").alias("basis"))
    moved = others.where("source_id is not null").select(F.col("source_id").alias("old_id"))
    gone = free.join(moved, "old_id", "left_anti").select(F.col("old_path").alias("current_path"), F.col("old_id").alias("source_id"), F.lit("deleted").alias("change"), F.lit("absent").alias("basis"))
    return stay.union(others).union(gone)


def statistics(changes: DataFrame) -> DataFrame:
    """One row with the count of every class, zeros included."""
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in CLASSES))


def materiality(stats: DataFrame, active: DataFrame, published: bool) -> DataFrame:
    """Whether changes are large enough to publish for, and why."""
    row = stats.crossJoin(active.agg(F.count("*").alias("active")))  # one row each
    total = F.col("added") + F.col("modified") + F.col("moved_or_renamed") + F.col("deleted") + F.col("ambiguous")
    lost = F.col("deleted") + F.col("moved_or_renamed") + F.col("ambiguous")
    row = row.withColumns({"changed_total": total, "changed_ratio": F.coalesce(F.try_divide(total.cast("double"), F.col("active").cast("double")), F.lit(0.0)), "destructive_total": lost})
    why = F.array_compact(F.array(F.when(F.col("changed_total") >= 12, "changed_total"), F.when(F.col("changed_ratio") >= 0.15, "changed_ratio"), F.when(F.col("destructive_total") >= 3, "destructive"), F.when(~F.lit(published) & (F.col("active") >= 12), "first_publish")))
    return row.select("changed_total", F.round("changed_ratio", 6).alias("changed_ratio"), "destructive_total", F.when(F.size(why) > 0, "material").otherwise("minor").alias("materiality"), F.array_join(why, ",").alias("reasons"))


def signature(files: DataFrame, by: str) -> DataFrame:
    """(by, files, signature): a digest of each group's sorted paths, sizes and contents. Files are digested first, so that a group's list stays short."""
    line = F.sha2(F.concat_ws("|", "current_path", F.col("file_size").cast("string"), "fingerprint"), 256)
    return files.withColumn("line", line).groupBy(by).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("signature"))


#: From this length on difflib leaves frequent characters out.
POPULAR_FROM = 200
#: Cells of a table of common parts that are worked on at once.
CELLS = 1 << 16


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in a, start in b) of each column's longest common part, the first one in a and then in b: the largest of numbers made of size and, backwards, both starts."""
    run, best = np.zeros((len(b) + 1, b.shape[1]), np.int32), np.zeros(b.shape[1], np.int32)
    ends = np.arange(len(b), dtype=np.int32)[:, None]
    for i in range(len(a)):
        grown = (run[:-1] + 1) * (b == a[i])
        run[1:] = grown
        grown *= 0x10101
        grown += (254 - i) * 256 + 254 - ends
        np.maximum(best, grown.max(0), out=best)
    return best >> 16, 255 - (best >> 8 & 255), 255 - (best & 255)


def _common(a: np.ndarray, b: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """How many characters of each pair match: those of its longest common part, and of what lies left and right of it. All pairs go through a step together."""
    codes = lambda texts: np.ascontiguousarray(texts.astype("U").view(np.uint32).reshape(len(texts), -1).T.astype(np.int32))
    x, y = codes(a), codes(b)
    total, none = np.zeros(len(a), np.int64), np.zeros(len(a), np.int32)
    open_ = np.stack([np.arange(len(a), dtype=np.int32), none, long_a, none, long_b])
    open_ = open_[:, (open_[2] > 0) & (open_[4] > 0)]

    def part(codes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, other: int) -> np.ndarray:
        at = start + np.arange((end - start).max(), dtype=np.int32)[:, None]
        return np.where(at < end, codes[np.minimum(at, len(codes) - 1), row], other)

    while open_.shape[1]:
        row, from_a, to_a, from_b, to_b = open_
        size, at_a, at_b = _longest(part(x, row, from_a, to_a, -1), part(y, row, from_b, to_b, -2))
        total += np.bincount(row, size, len(total)).astype(np.int64)
        at_a, at_b = at_a + from_a, at_b + from_b
        sides = np.concatenate([np.stack([row, from_a, at_a, from_b, at_b]), np.stack([row, at_a + size, to_a, at_b + size, to_b])], 1)
        open_ = sides[:, (np.tile(size, 2) > 0) & (sides[1] < sides[2]) & (sides[3] < sides[4])]
    return total


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """What SequenceMatcher(None, x, y).ratio() gives for each pair."""
    long_a, long_b = (np.fromiter(map(len, x), np.int32, len(x)) for x in (a, b))
    out, longest, both = np.ones(len(a)), np.maximum(long_a, long_b), long_a + long_b
    for i in np.flatnonzero(longest >= POPULAR_FROM):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    short = np.flatnonzero((longest < POPULAR_FROM) & (both > 0))
    x, y = np.array(a, object)[short], np.array(b, object)[short]
    step = max(1, CELLS // max(1, longest[short].max(initial=1)))
    for at in range(0, len(short), step):
        some = short[at : at + step]
        out[some] = 2.0 * _common(x[at : at + step], y[at : at + step], long_a[some], long_b[some]) / both[some]
    return out


@F.pandas_udf(DoubleType())
def name_likeness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series(likenesses(a.tolist(), b.tolist()))


name_likeness = name_likeness.asNondeterministic()  # else it runs once for a filter and again for the rows that are left


#: Pairs of names that are worked on at once, lost sources that they are looked for among, and rows of the result that go out together.
PAIRS, HELD, ROWS = 1 << 16, 1 << 12, 1 << 16
#: A missing size, which ``least`` passes over.
NO_SIZE = np.iinfo(np.int64).max


def _codes(texts: list[str]) -> np.ndarray:
    """A row for each place, a column for each text; 0 behind its end."""
    return np.ascontiguousarray(np.array(texts, "U").view(np.uint32).reshape(len(texts), -1).T)


def _places(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each letter, and in a last row for all others, the places at which each text has it, as bits."""
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if len(codes) <= 8 * np.dtype(k).itemsize)
    out = np.zeros((len(letters) + 1, codes.shape[1]), kind)
    for place, row in enumerate(codes):
        at = np.flatnonzero(row)
        out[np.searchsorted(letters, row[at]), at] |= kind(1 << place)
    return out


def _in_order(a: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many characters of each text of ``a`` (letters' numbers, a row for each place) and each one of ``places`` match in order: no fewer than difflib finds. A bit for each place, all pairs together."""
    left = np.full((a.shape[1], places.shape[1]), np.iinfo(places.dtype).max, places.dtype)
    more = np.empty_like(left)
    for row in a:
        at = places[row]
        at &= left
        np.add(left, at, out=more)
        left -= at
        left |= more
    return np.bitwise_count(~left)


def _matching(rows: np.ndarray) -> np.ndarray:
    """How many characters of each pair difflib finds to match. ``rows`` has for each place in the first text the places in the second with the same character, as bits.

    The longest common part (the first one in the first text and then in the second) counts, and what crosses it goes, until nothing is left. Parts that are left of it or right of it don't
    touch each other, so it makes no difference that the longest of them all comes next.
    """
    kind = rows.dtype.type
    one, place, total, pair = kind(1), np.arange(len(rows))[:, None], np.zeros(rows.shape[1], np.int64), np.arange(rows.shape[1])
    while True:
        some = np.flatnonzero(np.bitwise_or.reduce(rows, 0))
        if len(some) < len(pair):
            rows, pair = rows.take(some, 1), pair[some]
        if not len(pair):
            return total
        size, start, end = np.empty(len(pair), np.int64), np.empty(len(pair), np.int64), np.empty(len(pair), kind)
        runs, at, long = rows, np.arange(len(pair)), 1  # where a common part of this length ends in the second text, by its start in the first
        while len(at):
            longer = runs[1:] & (runs[:-1] << one)
            grows = np.bitwise_or.reduce(longer, 0) != 0 if len(longer) else np.zeros(len(at), bool)
            ready = np.flatnonzero(~grows)
            if len(ready):
                ends = runs.take(ready, 1)
                first = (ends != 0).argmax(0)
                ends = ends[first, np.arange(len(ready))]
                to = at[ready]
                size[to], start[to], end[to] = long, first, ends & (~ends + one)
                on = np.flatnonzero(grows)
                longer, at = longer.take(on, 1), at[on]
            runs, long = longer, long + 1
        total[pair] += size
        before, behind = (end >> (size - 1).astype(kind)) - one, ~((end << one) - one)
        rows = np.where(place < start, rows & before, np.where(place >= start + size, rows & behind, kind(0)))


def _sizes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return pc.fill_null(rows.column("size"), NO_SIZE).to_numpy()


def _size_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What SQL makes of least / greatest of both and 1, a missing one left out; 0 if both are missing."""
    low, known = np.minimum(a, b), lambda x: np.where(x == NO_SIZE, 1, x)
    return np.where(low == NO_SIZE, 0.0, low / np.maximum(np.maximum(known(a), known(b)), 1))


class _Lost:
    """The lost sources of a cell, their names as bits where these have place in a word."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.ids, self.sizes = rows.column("id").combine_chunks(), _sizes(rows)
        self.names = rows.column("stem").to_pylist()
        self.lengths = np.fromiter(map(len, self.names), np.int64, len(self.names))
        order = np.argsort(self.lengths, kind="stable")
        bits = np.searchsorted(self.lengths[order], (16, 32, 64), side="right")
        self.long, self.blocks = order[bits[2] :], []
        for low, high in zip((0, *bits[:2]), bits, strict=True):
            for at in range(low, high, HELD):
                some = order[at : min(at + HELD, high)]
                codes = _codes([self.names[i] for i in some])
                letters = np.unique(codes[codes > 0])
                self.blocks.append((some, letters, _places(codes, letters)))

    def alike(self, new: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of ``new``, rows of lost sources, scores) of the pairs of like name and size."""
        names, sizes = new.column("stem").to_pylist(), _sizes(new)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(lengths, kind="stable")
        short = np.searchsorted(lengths[order], POPULAR_FROM)

        def scored(i: np.ndarray, j: np.ndarray, ratio: np.ndarray, matching: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            both = lengths[i] + self.lengths[j]
            name = likenesses([names[k] for k in i], [self.names[k] for k in j]) if matching is None else np.where(both > 0, 2.0 * matching / np.maximum(both, 1), 1.0)
            good = name >= NAME_LEAST
            return i[good], j[good], NAME_SHARE * name[good] + (1 - NAME_SHARE) * ratio[good]

        for b, letters, places in self.blocks:
            step = max(1, PAIRS // len(b))
            for at in range(0, short, step):
                a = order[at : min(at + step, short)]
                codes = _codes([names[i] for i in a])
                number = np.minimum(np.searchsorted(letters, codes), max(0, len(letters) - 1))
                number = np.where(letters[number] == codes, number, len(letters)) if len(letters) else np.zeros_like(number)
                both = lengths[a][:, None] + self.lengths[b]
                i, j = np.nonzero((2.0 * _in_order(number, places) >= NAME_LEAST * both * (1 - 1e-9)) | (both == 0))
                ratio = _size_ratios(sizes[a[i]], self.sizes[b[j]])
                near = np.flatnonzero(ratio >= SIZE_LEAST)
                i, j, ratio = i[near], j[near], ratio[near]
                yield scored(a[i], b[j], ratio, _matching(places[number[:, i], j]))
        # names that are too long for a word, or of which difflib leaves characters out
        for a, b in ((order[:short], self.long), (order[short:], np.arange(len(self.names)))):
            step = max(1, CELLS // max(1, len(b)))
            for at in range(0, len(a) if len(b) else 0, step):
                i, j = (x.ravel() for x in np.meshgrid(a[at : at + step], b, indexing="ij"))
                ratio = _size_ratios(sizes[i], self.sizes[j])
                near = np.flatnonzero(ratio >= SIZE_LEAST)
                for some in np.array_split(near, -(-len(near) // CELLS) or 1):
                    yield scored(i[some], j[some], ratio[some], None)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, new, id, size, stem), in each cell the lost sources first, to the pairs that are alike. A task holds the lost sources of a cell."""
    cell, parts, lost = None, [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cells, new = batch.column("cell"), batch.column("new")
        other = lambda c: pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        cuts = [0, *(np.flatnonzero(other(cells) | other(new)) + 1).tolist(), n]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(at, to - at)
            if cells[at].as_py() != cell:
                cell, parts, lost = cells[at].as_py(), [], None
            if not new[at].as_py():
                parts.append(rows)
            elif parts:
                lost, held, many = lost or _Lost(parts), [], 0
                for found in lost.alike(rows):
                    held, many = [*held, found], many + len(found[0])
                    if many >= ROWS:
                        yield _pairs(rows, lost, held)
                        held, many = [], 0
                if many:
                    yield _pairs(rows, lost, held)


def _pairs(new: pa.RecordBatch, lost: _Lost, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([new.column("id").take(pa.array(i)), lost.ids.take(pa.array(j)), pa.array(score)], ["current_path", "source_id", "score"])


def relocations(strangers: DataFrame, missing: DataFrame) -> DataFrame:
    """(current_path, source_id, score): for new paths the lost sources of like name and size, by score.

    Candidates meet in blocks of the same type and file size class (powers of 1/0.9, each file in its own class and the next), so no pair of all is formed. A block is dealt out in
    ``PARTS`` parts of its new paths, each with all lost sources of the block: few rows make many pairs, so tasks go by a number and not by bytes. Pairs are made and compared in the task
    that has both, and only those that are alike become rows.
    """
    step = F.floor(F.log(F.greatest("file_size", F.lit(1))) / F.log(F.lit(1 / SIZE_LEAST))).cast("long")
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split("current_path", "/"), -1)), r"\.[^.]*$", ""), "[^a-z0-9]+", " ")
    cell = F.concat_ws("|", "block", "part", "document_type")  # one key, so that a cell is one task's
    part = F.pmod(F.xxhash64("current_path"), F.lit(PARTS))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    side = lambda df, new, name: df.where("document_type is not null").select(F.lit(new).alias("new"), F.col(name).cast("string").alias("id"), "document_type", F.col("file_size").cast("long").alias("size"), stem.alias("stem"), part.alias("own"), step.alias("step")).where("stem is not null")
    a = side(strangers, True, "current_path").withColumn("block", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).withColumn("part", F.col("own"))
    b = side(missing, False, "source_id").withColumn("block", F.col("step")).withColumn("part", parts)
    tasks = 2 * int(strangers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = a.unionByName(b).select(cell.alias("cell"), "new", "id", "size", "stem").repartition(tasks, "cell").sortWithinPartitions("cell", "new")
    return dealt.mapInArrow(_meetings, "current_path string, source_id string, score double")
