"""Geometry of pages: words to lines, cells and tables, clusters of drawings, section paths, what connectors connect.

Boxes are (x0, y0, x1, y1), x to the right and y downwards. Two boxes overlap if they have a point in common, borders included; with a padding both are widened by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import settled

#: How far a word's centre may lie from the mean of its line, gaps within a cell and between rows, spread of a column, rows of a table and of its preview.
LINE_GAP, CELL_GAP, ROW_GAP, COLUMN_SPREAD, LEAST_ROWS, PREVIEW, TABLE_PADDING = 4.5, 32.0, 28.0, 38.0, 3, 8, 6.0
#: The padding of drawings, of the end of a connector, and how far a corner may be from it.
DRAWING_PADDING, END_PADDING, CORNER_DISTANCE = 24.0, 180_000.0, 320_000.0
NEAR = 1e-6  # so near to LINE_GAP, means are computed without rounding
BATCH, LONG_PAGE = 1 << 16, 1 << 10  # words that are worked on at once, and words of a page from which on it's numbered by itself
CELL = 256.0  # side of the grid cells in which drawings meet
CHUNK = 256  # drawings of a page that are merged where they lie
#: How far from a shape an end may be that links with it, with some room for rounding, and the side of the grid cells in which they meet.
REACH, LINK_CELL = CORNER_DISTANCE + 1, 8 * CORNER_DISTANCE
BOX = ("x0", "y0", "x1", "y1")


def overlap(a: str, b: str, padding: float = 0.0) -> Column:
    """Whether the boxes in columns ``a_x0`` ... and ``b_x0`` ... overlap."""
    inside = lambda low, high: F.col(low) - padding <= F.col(high) + padding
    return inside(f"{a}_x0", f"{b}_x1") & inside(f"{b}_x0", f"{a}_x1") & inside(f"{a}_y0", f"{b}_y1") & inside(f"{b}_y0", f"{a}_y1")


def _around() -> list[Column]:
    """The box around all boxes of a group."""
    return [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]


def cells_of(x0: Column, y0: Column, x1: Column, y1: Column, side: float) -> Column:
    """The grid cells that a box lies in, as an array of (column, row)."""
    span = lambda a, b: F.sequence(F.floor(a / side), F.floor(b / side))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _whole(words: DataFrame) -> DataFrame:
    whole = words.select("page", "word", "text", *(F.col(c).cast("double").alias(c) for c in BOX)).dropna(subset=["page", "word", *BOX])
    return whole.repartition("page").sortWithinPartitions("page", "y0", "x0", "word")


def _numbering() -> Callable[[], Callable[[list, list, list], list[int]]]:
    """What opens a count: a function of words (pages, tops, bottoms) that come in order, batch by batch, to their lines. It goes to tasks by value."""

    def numbered() -> Callable[[list, list, list], list[int]]:
        page, line, total, centres = None, 0, 0.0, []

        def number(pages: list, tops: list, bottoms: list) -> list[int]:
            nonlocal page, line, total, centres
            lines = []
            for p, top, bottom in zip(pages, tops, bottoms, strict=True):
                centre = (top + bottom) / 2.0
                if p != page:
                    page, line, total, centres = p, 0, 0.0, []
                if centres:
                    away = abs(centre - total / len(centres))
                    if abs(away - LINE_GAP) < NEAR:
                        away = abs(centre - float(sum(map(Fraction, centres)) / len(centres)))
                if not centres or away > LINE_GAP:
                    line, total, centres = line + 1, 0.0, []
                total += centre
                centres.append(centre)
                lines.append(line)
            return lines

        return number

    return numbered


def word_lines(words: DataFrame) -> DataFrame:
    """``words`` (page, word, text, x0, y0, x1, y1) with ``line``: from 1, from the top of each page.

    Words are taken in the order of (y0, x0, word). A word joins the line before it if its centre is within LINE_GAP of the mean centre of that line so far, else it opens the next
    one. Means are exact where it matters. Pages are sorted and streamed, so a task holds one line. Words without a page, a word number or a whole box have no row.
    """
    whole, numbered = _whole(words), _numbering()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered()
        for batch in batches:
            lines = number(*(batch.column(c).to_pylist() for c in ("page", "y0", "y1")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int32())], [*batch.schema.names, "line"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return whole.mapInArrow(run, f"{fields}, line int")


def word_cells(words: DataFrame) -> DataFrame:
    """``line_cells(word_lines(words))`` in the one pass over sorted pages: words are sent once, and a task holds one line."""
    whole, numbered = _whole(words), _numbering()
    names, kinds = ["page", "line", "cell", "text", *BOX], [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4]

    def cells(line: list[tuple]) -> Iterator[tuple]:
        """Words (x0, y0, word, x1, y1, text) from left to right, to number, text and box."""
        parts, end = [], None
        for x0, y0, _, x1, y1, text in sorted(line, key=lambda w: w[:3]):
            if end is None or x0 - end > CELL_GAP:
                parts.append([[], x0, y0, x1, y1])
            part, end = parts[-1], x1
            part[0].append(text or "")
            part[1:] = min(part[1], x0), min(part[2], y0), max(part[3], x1), max(part[4], y1)
        texts = [(" ".join(p[0]).strip(" \t\n\x0b\f\r"), *p[1:]) for p in parts]
        return ((k, *c) for k, c in enumerate((c for c in texts if c[0]), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, held, kind = numbered(), None, [], None
        for batch in batches:
            out, kind = [], batch.column("page").type
            page, top, bottom = (batch.column(c).to_pylist() for c in ("page", "y0", "y1"))
            rest = zip(batch.column("x0").to_pylist(), top, batch.column("word").to_pylist(), batch.column("x1").to_pylist(), bottom, batch.column("text").to_pylist(), strict=True)
            for p, n, word in zip(page, number(page, top, bottom), rest, strict=True):
                if (p, n) != key:
                    out += ((*key, *c) for c in cells(held)) if held else ()
                    key, held = (p, n), []
                held.append(word)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *kinds], strict=True)], names)
        last = [(*key, *c) for c in cells(held)] if held else []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last, strict=True), [kind, *kinds], strict=True)], names)

    return whole.mapInArrow(run, f"page {whole.schema['page'].dataType.simpleString()}, line int, cell int, text string, x0 double, y0 double, x1 double, y1 double")


def line_cells(lines: DataFrame) -> DataFrame:
    """``lines`` as of ``word_lines`` to (page, line, cell, text, x0, y0, x1, y1): words from left to right, a gap of more than CELL_GAP opens a cell. Cells without text go."""
    across = Window.partitionBy("page", "line").orderBy("x0", "y0", "word")
    opens = F.col("x0") - F.lag("x1").over(across) > CELL_GAP
    parts = lines.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("part", F.sum("opens").over(across))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "word", F.coalesce("text", F.lit("")).alias("text")))), lambda w: w["text"]), " ")
    cells = parts.groupBy("page", "line", "part").agg(joined.alias("text"), *_around()).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    return cells.withColumn("cell", F.row_number().over(Window.partitionBy("page", "line").orderBy("part"))).select("page", "line", "cell", "text", *BOX)


def tables(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(page, first_line, rows, columns, x0, y0, x1, y1, preview): tables made of lines with two cells or more.

    Neighbouring lines belong together while no other line comes between them and the tops of their first cells are within ROW_GAP. A table has LEAST_ROWS rows with as many cells as is most usual
    in its lines (the first of equals) or more, and its columns begin within COLUMN_SPREAD. Boxes of ``known`` (page, x0, ...) keep tables away. Cells are sent once, by page; windows and
    groups within pages do the rest.
    """
    of_line = F.array_sort(F.collect_list(F.struct("cell", "text", *BOX)))  # of one line
    rows = cells.repartition("page").groupBy("page", "line").agg(of_line.alias("cells")).withColumn("n", F.size("cells")).where("n > 1")
    top = F.element_at("cells", 1)["y0"]
    down = Window.partitionBy("page").orderBy("line")
    # every line of the page counts, so two rows are neighbours exactly if their numbers are
    apart = (F.col("line") - F.lag("line").over(down) > 1) | (F.abs(F.col("top") - F.lag("top").over(down)) > ROW_GAP)
    runs = rows.withColumn("top", top).withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(down)).drop("top", "apart")
    alike, run = Window.partitionBy("page", "run", "n"), Window.partitionBy("page", "run")
    counted = runs.withColumns({"times": F.count("*").over(alike), "seen": F.min("line").over(alike)})
    usual = counted.withColumns({"columns": F.max(F.struct("times", -F.col("seen"), "n")).over(run)["n"], "first_line": F.min("line").over(run), "lines": F.count("*").over(run)})
    fits = usual.where((F.col("lines") >= LEAST_ROWS) & (F.col("n") >= F.col("columns"))).withColumn("place", F.row_number().over(run.orderBy("line")))
    inner = fits.select("page", "run", "first_line", "columns", "place", F.explode(F.slice("cells", F.lit(1), F.col("columns"))).alias("c")).select("page", "run", "first_line", "columns", "place", "c.*")
    shown = F.collect_list(F.when(F.col("place") <= PREVIEW, F.struct("place", "cell", "text")))  # of the first lines
    columns = inner.groupBy("page", "run", "first_line", "columns", "cell").agg(F.count("*").alias("rows"), (F.max("x0") - F.min("x0")).alias("spread"), *_around(), shown.alias("shown"))
    found = columns.groupBy("page", "run", "first_line", "columns").agg(F.max("rows").alias("rows"), F.max("spread").alias("spread"), *_around(), F.array_sort(F.flatten(F.collect_list("shown"))).alias("shown"))
    found = found.where((F.col("rows") >= LEAST_ROWS) & (F.col("spread") <= COLUMN_SPREAD))
    if known is not None:
        a = found.select("page", "run", *(F.col(c).alias(f"a_{c}") for c in BOX))
        hit = a.join(known.select("page", *(F.col(c).alias(f"b_{c}") for c in BOX)), "page").where(overlap("a", "b", TABLE_PADDING)).select("page", "run").distinct()
        found = found.join(hit, ["page", "run"], "left_anti")
    line = lambda p: F.array_join(F.transform(F.filter("shown", lambda x: x["place"] == p), lambda x: x["text"]), " | ")
    preview = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.col("rows"), F.lit(PREVIEW)).cast("int")), line), "\n")
    return found.select("page", "first_line", "rows", "columns", *BOX, preview.alias("preview"))


def _lines_of(starts: np.ndarray, sizes: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """``word_lines`` for the words of some pages, each page's in their order: one word of every page at a time, and long pages word by word."""
    centre, line, numbered = (y0 + y1) / 2.0, np.zeros(len(y0), np.int32), _numbering()
    for k in np.flatnonzero(sizes > LONG_PAGE):
        some = slice(starts[k], starts[k] + sizes[k])
        line[some] = numbered()([0] * int(sizes[k]), y0[some].tolist(), y1[some].tolist())
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= LONG_PAGE]
    first, left = starts[order], -sizes[order]
    total, many, opened, n = centre[first], np.ones(len(first)), first.copy(), np.ones(len(first), np.int32)
    line[first] = 1
    for t in range(1, -left[0] if len(left) else 0):
        k = np.searchsorted(left, -t)  # pages that have more words than that
        at = first[:k] + t
        here = centre[at]
        away = np.abs(here - total[:k] / many[:k])
        for i in np.flatnonzero(np.abs(away - LINE_GAP) < NEAR):
            centres = centre[opened[i] : at[i]].tolist()
            away[i] = abs(here[i] - float(sum(map(Fraction, centres)) / len(centres)))
        opens = away > LINE_GAP
        n[:k] += opens
        total[:k] = np.where(opens, here, total[:k] + here)
        many[:k] = np.where(opens, 1, many[:k] + 1)
        opened[:k][opens] = at[opens]
        line[at] = n[:k]
    return line


def _opens(*columns: np.ndarray) -> np.ndarray:
    """Where one of some columns isn't what it was in the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _joined(texts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    """The texts from each start to the next one as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), texts), by)


def _tables_of(words: pa.Table) -> tuple[pa.Array, list] | None:
    """``tables(word_cells(words))`` for the words of whole pages, in the order of pages: a row of words for each table, and the columns of tables but the page."""
    page = words.column("page").combine_chunks()
    new = np.concatenate([[True], pc.not_equal(page.slice(1), page.slice(0, len(page) - 1)).to_numpy(zero_copy_only=False)])
    number, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
    word = words.column("word").to_numpy()
    word = np.unique(word, return_inverse=True)[1] if word.dtype == object else word
    x0, y0, x1, y1 = (words.column(c).to_numpy() for c in BOX)
    order = np.lexsort((word, x0, y0, number))
    line = np.empty(len(order), np.int32)
    line[order] = _lines_of(firsts, np.diff(np.append(firsts, len(order))), y0[order], y1[order])

    order = np.lexsort((word, y0, x0, line, number))
    number, line, x0, y0, x1, y1 = (c[order] for c in (number, line, x0, y0, x1, y1))
    opens = _opens(number, line)
    opens[1:] |= x0[1:] - x1[:-1] > CELL_GAP
    at = np.flatnonzero(opens)
    texts = pc.utf8_trim(_joined(pc.fill_null(words.column("text").combine_chunks().take(pa.array(order)), ""), at, " "), " \t\n\x0b\f\r")
    said = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    box = [f.reduceat(c, at)[said] for f, c in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    number, line, texts = number[at][said], line[at][said], texts.take(pa.array(said))

    # lines of two cells or more, each from its first cell
    at = np.flatnonzero(_opens(number, line))
    n = np.diff(np.append(at, len(line)))
    at, n = at[n > 1], n[n > 1]
    if not len(at):
        return None
    number, line, top = number[at], line[at], box[1][at]
    opens = _opens(number)
    opens[1:] |= (np.diff(line) > 1) | ~(np.abs(np.diff(top)) <= ROW_GAP)
    run, begins = np.cumsum(opens) - 1, np.flatnonzero(opens)
    by = np.lexsort((line, n, run))  # the most usual number of cells of each run, the first of equals
    alike = np.flatnonzero(_opens(run[by], n[by]))
    times, seen = np.diff(np.append(alike, len(by))), line[by][alike]
    best = np.lexsort((seen, -times, run[by][alike]))
    columns = n[by][alike][best][_opens(run[by][alike][best])]
    lines = np.diff(np.append(begins, len(run)))
    fits = np.flatnonzero((lines >= LEAST_ROWS)[run] & (n >= columns[run]))
    rows = np.bincount(run[fits], minlength=len(begins))
    fits = fits[rows[run[fits]] >= LEAST_ROWS]
    if not len(fits):
        return None
    at, run = at[fits], run[fits]
    opens = _opens(run)
    place = np.arange(len(run)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    wide = columns[run]
    column = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    cell, of = np.repeat(at, wide) + column, np.repeat(run, wide)
    box, starts = [c[cell] for c in box], np.flatnonzero(_opens(of))
    by = np.lexsort((column, of))
    each = np.flatnonzero(_opens(of[by], column[by]))
    spread = np.maximum.reduceat(box[0][by], each) - np.minimum.reduceat(box[0][by], each)
    spread = np.maximum.reduceat(spread, np.flatnonzero(_opens(of[by][each])))
    good, found = spread <= COLUMN_SPREAD, of[starts]
    shown = np.repeat(place < PREVIEW, wide)
    texts, place, of = texts.take(pa.array(cell[shown])), np.repeat(place, wide)[shown], of[shown]
    each = np.flatnonzero(_opens(of, place))
    preview = _joined(_joined(texts, each, " | "), np.flatnonzero(_opens(of[each])), "\n")
    out = [line[begins][found], rows[found], columns[found].astype(np.int32), *(f.reduceat(c, starts) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), box, strict=True)), preview]
    return pa.array(firsts[number[begins][found]][good]), [c.filter(pa.array(good)) if isinstance(c, pa.Array) else pa.array(c[good]) for c in out]


def word_tables(rows: DataFrame, words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``tables(word_cells(words(rows)))``, where ``words`` makes (page, word, text, x0, y0, x1, y1) of single rows; ``page`` is one of their columns.

    Only rows are sent and sorted; words and cells are made where the page is, and only tables leave the task. It holds about ``BATCH`` words and the page that goes beyond them. A row
    makes many words, so tasks go by a number and not by bytes.
    """
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = words(rows.where("page is not null").repartition(tasks, "page").sortWithinPartitions("page"))
    whole = sent.select("page", "word", "text", *(F.col(c).cast("double").alias(c) for c in BOX)).dropna(subset=["word", *BOX])
    kind = whole.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, enough = [], 0, BATCH

        def made(words: pa.Table) -> Iterator[pa.RecordBatch]:
            with np.errstate(invalid="ignore"):
                found = _tables_of(words) if words.num_rows else None
            if found and len(found[0]):
                yield pa.RecordBatch.from_arrays([words.column("page").combine_chunks().take(found[0]), *found[1]], ["page", "first_line", "rows", "columns", *BOX, "preview"])

        for batch in batches:
            held, many = [*held, batch], many + batch.num_rows
            if many >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                page = table.column("page").combine_chunks()
                other = pc.not_equal(page, page[many - 1]).to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                yield from made(table.slice(0, cut))
                held, many = table.slice(cut).to_batches(), many - cut
                enough = max(BATCH, 2 * many)
        if held:
            yield from made(pa.Table.from_batches(held))

    return whole.mapInArrow(run, f"page {kind}, first_line int, rows bigint, columns int, x0 double, y0 double, x1 double, y1 double, preview string")


def _first_of_each(chunk: np.ndarray, boxes: list[np.ndarray], padding: float) -> np.ndarray:
    """For rows in order of their chunks the first row of each one's cluster: boxes of a chunk that overlap are one, and so are the boxes around them, until none do."""
    n = len(chunk)
    behind = np.searchsorted(chunk, chunk, side="right") - np.arange(n) - 1  # rows of the chunk that follow
    a = np.repeat(np.arange(n), behind)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)
    first, (x0, y0, x1, y1) = np.arange(n), [c.copy() for c in boxes]
    while len(a):
        u, v = first[a], first[b]
        hit = (x0[u] - padding <= x1[v] + padding) & (x0[v] - padding <= x1[u] + padding) & (y0[u] - padding <= y1[v] + padding) & (y0[v] - padding <= y1[u] + padding)
        u, v = u[hit], v[hit]
        to = np.arange(n)
        np.minimum.at(to, np.maximum(u, v), np.minimum(u, v))
        while (to[to] != to).any():
            to = to[to]
        for c, f in ((x0, np.minimum), (y0, np.minimum), (x1, np.maximum), (y1, np.maximum)):
            f.at(c, to, c)
        first = to[first]
        # only chunks in which boxes have grown can have more to merge
        grown = np.zeros(chunk[-1] + 1, bool)
        grown[chunk[np.maximum(u, v)]] = True
        left = grown[chunk[a]] & (first[a] != first[b])
        a, b = a[left], b[left]
    return first


def _merged_in_chunks(drawings: DataFrame, padding: float, most: int) -> DataFrame:
    """(page, drawing, cluster, box): clusters of ``most`` neighbouring drawings of a page at a time; ``box``, the drawing's own, is there only on pages that have more. A task holds a batch and a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = None, None  # rows of a page that may go on; the page of which rows are out already

        def merged(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, cut
            rows, n = rows.combine_chunks(), rows.num_rows
            pages = rows.column("page").combine_chunks()
            opens = np.concatenate([[True], pc.not_equal(pages.slice(1), pages.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(opens)
            sizes, page = np.diff(np.append(starts, n)), np.cumsum(opens) - 1
            wide = sizes > most
            wide[0] |= cut is not None and pages[0] == cut
            out = n if last else starts[-1] + sizes[-1] // most * most * wide[-1]
            if not last:
                held, cut = rows.slice(out), pages[n - 1] if wide[-1] else None
            if out:
                at = np.arange(n) - starts[page]
                chunk = np.cumsum(opens | (at % most == 0))[:out] - 1
                rows, wide = rows.slice(0, out), wide[page[:out]]
                boxes = [rows.column(c).combine_chunks() for c in BOX]
                first = _first_of_each(chunk, [c.to_numpy() for c in boxes], padding)
                number = rows.column("drawing").combine_chunks()
                box = pa.StructArray.from_arrays(boxes, names=list(BOX), mask=pa.array(~wide))
                yield pa.RecordBatch.from_arrays([pages.slice(0, out), number, number.take(pa.array(first)), box], ["page", "drawing", "cluster", "box"])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                yield from merged(rows if held is None else pa.concat_tables([held, rows]), False)
        if held is not None and held.num_rows:
            yield from merged(held, True)

    kind = {c: drawings.schema[c].dataType.simpleString() for c in ("page", "drawing")}
    box = ", ".join(f"{c}: double" for c in BOX)
    return drawings.sortWithinPartitions("page", "drawing").mapInArrow(run, f"page {kind['page']}, drawing {kind['drawing']}, cluster {kind['drawing']}, box struct<{box}>")


def drawing_clusters(drawings: DataFrame, padding: float = DRAWING_PADDING, side: float = CELL) -> DataFrame:
    """``drawings`` (page, drawing, x0, y0, x1, y1) to (page, drawing, cluster): cluster is the number of its first drawing.

    Drawings whose boxes overlap are one, and so are clusters whose boxes around all their drawings do, until none does. What comes out doesn't depend on the order of merging: a box only
    grows, so what overlaps once always will. (A first pass in the order of drawings with less padding merges nothing that this doesn't.) So up to CHUNK drawings of a page are merged
    where they lie, which is all of most pages; what is left of larger ones meets in rounds. Every round joins boxes that
    share a grid cell, and each goes to the least number among those that it meets. Rows that repeat a number are one drawing; those without a page, a number or a whole box have no row.
    """
    whole = drawings.select("page", "drawing", *(F.col(c).cast("double").alias(c) for c in BOX)).dropna()
    parts = 2 * int(drawings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = settled(_merged_in_chunks(whole.repartition(parts, "page").groupBy("page", "drawing").agg(*_around()), padding, CHUNK))
    rest, done = local.where("box is not null"), local.where("box is null").select("page", "drawing", "cluster")
    if rest.isEmpty():
        return done
    members, boxes = rest.select("page", "drawing", "cluster"), settled(rest.select("page", "cluster", "box.*").groupBy("page", "cluster").agg(*_around()))
    while True:
        wide = boxes.withColumn("at", F.explode(cells_of(F.col("x0") - padding, F.col("y0") - padding, F.col("x1") + padding, F.col("y1") + padding, side)))
        a, b = (wide.select("page", "at", F.col("cluster").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in BOX)) for p in "ab")
        meets = a.join(b, ["page", "at"]).where((F.col("a_id") > F.col("b_id")) & overlap("a", "b", padding))
        moves = settled(meets.groupBy("page", F.col("a_id").alias("cluster")).agg(F.min("b_id").alias("to")))
        if moves.isEmpty():
            return done.union(members)
        to = F.coalesce("to", "cluster")
        members = settled(members.join(moves, ["page", "cluster"], "left").select("page", "drawing", to.alias("cluster")))
        boxes = settled(boxes.join(moves, ["page", "cluster"], "left").withColumn("cluster", to).groupBy("page", "cluster").agg(*_around()))


def section_paths(pages: DataFrame, outline: DataFrame, headings: DataFrame, levels: int = 16) -> DataFrame:
    """(doc, page, section): for every page the titles of the sections that it stands in, outermost first, as an array.

    ``outline`` (doc, page, level, title) in the order of (page, level, title): a node ends all sections of its level and deeper ones. On pages without a node the first of ``headings``
    (doc, page, place, level, title) does so, unless it has no title or the title of the section opened last. For each level the last node counts that no node of a higher level has
    followed, so running maxima of positions give the stack. Levels below 1 count as 1, those above ``levels`` as ``levels``. Titles that are empty open sections that are not shown.
    """
    level = F.greatest(F.least(F.coalesce("level", F.lit(1)), F.lit(levels)), F.lit(1))
    nodes = outline.where("page is not null").select("doc", "page", level.alias("level"), F.coalesce("title", F.lit("")).alias("title"))
    first = headings.groupBy("doc", "page").agg(F.min_by(F.struct(level.alias("level"), F.coalesce("title", F.lit("")).alias("title")), "place").alias("h")).select("doc", "page", "h.level", "h.title")
    first = first.where("title <> ''").join(nodes.select("doc", "page"), ["doc", "page"], "left_anti")
    events = nodes.withColumn("given", F.lit(True)).unionByName(first.withColumn("given", F.lit(False)))
    # a heading that repeats the title before it opens nothing; that title is the last one opened, whether its own event was skipped or not
    order = Window.partitionBy("doc").orderBy("page", "level", "title")
    events = events.withColumn("last", F.lag("title").over(order)).where(F.col("given") | F.col("last").isNull() | (F.col("last") != F.col("title"))).drop("given", "last")
    events = events.withColumn("at", F.row_number().over(order))
    marks = events.union(pages.select("doc", "page", F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("int")))
    so_far = Window.partitionBy("doc").orderBy("page", F.col("at").isNull(), "at").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == k, F.struct("at", "title"))).over(so_far).alias(f"last{k}") for k in range(1, levels + 1)]
    out = marks.select("doc", "page", "at", *last).where("at is null")
    # a level's last node stands unless a higher level's last node came later
    kept, upper = [], F.lit(0)
    for k in range(1, levels + 1):
        here = F.col(f"last{k}")
        kept.append(F.when(here["at"] > upper, here["title"]))
        upper = F.greatest(upper, F.coalesce(here["at"], F.lit(0)))
    return out.select("doc", "page", F.filter(F.array_compact(F.array(*kept)), lambda t: t != "").alias("section"))


def connector_links(connectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """(slide, connector, shape): the shapes that an end of a connector touches or comes near to.

    ``connectors``: slide, connector, x0, y0, x1, y1, begin_x, begin_y, end_x, end_y; ``shapes``: slide, shape, x0, y0, x1, y1. An end touches a shape if it is within END_PADDING of its box
    on both axes, and is near if its distance from the nearest corner (across plus down) is at most CORNER_DISTANCE. Connectors without an end link what their own box overlaps. All meet in
    one pass over wide grid cells: an end is sent to its own cell, a shape to those that ends in its reach may lie in, mostly one. Incomplete shapes link with nothing.
    """
    whole = shapes.select("slide", "shape", *(F.col(c).cast("double").alias(f"s_{c}") for c in BOX)).dropna()
    both = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull()
    place = lambda x0, y0, x1, y1, end: F.struct(*(F.col(c).cast("double").alias(f"c_{k}") for c, k in zip((x0, y0, x1, y1), BOX, strict=True)), F.lit(end).alias("end"))
    ends = F.array_compact(F.array(*(F.when(both(f"{e}_x", f"{e}_y"), place(f"{e}_x", f"{e}_y", f"{e}_x", f"{e}_y", True)) for e in ("begin", "end"))))
    places = connectors.withColumn("ends", ends).select("slide", "connector", F.explode(F.when(F.size("ends") > 0, F.col("ends")).otherwise(F.array(place(*BOX, False)))).alias("e")).select("slide", "connector", "e.*").dropna(subset=[f"c_{c}" for c in BOX])
    low, high = lambda a, b: F.least(a, b) - REACH, lambda a, b: F.greatest(a, b) + REACH
    reach = cells_of(low("s_x0", "s_x1"), low("s_y0", "s_y1"), high("s_x0", "s_x1"), high("s_y0", "s_y1"), LINK_CELL)
    # two numbers as keys, not a structure: they are most of what is sent beside the boxes
    in_cells = lambda df, at: df.withColumn("at", F.explode(at)).withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).drop("at")
    met = in_cells(places, cells_of(*(F.col(f"c_{c}") for c in BOX), LINK_CELL)).join(in_cells(whole, reach), ["slide", "i", "j"])
    pad = F.when(F.col("end"), END_PADDING).otherwise(0.0)
    touches = (F.col("c_x0") - pad <= F.col("s_x1")) & (F.col("s_x0") <= F.col("c_x1") + pad) & (F.col("c_y0") - pad <= F.col("s_y1")) & (F.col("s_y0") <= F.col("c_y1") + pad)
    away = lambda c: F.least(F.abs(F.col(f"c_{c}0") - F.col(f"s_{c}0")), F.abs(F.col(f"c_{c}0") - F.col(f"s_{c}1")))
    return met.where(touches | (F.col("end") & (away("x") + away("y") <= CORNER_DISTANCE))).select("slide", "connector", "shape").distinct()
