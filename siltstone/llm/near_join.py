"""N-gram Jaccard join by signature trees.

Each text becomes the set of its distinct k-word shingles (64-bit hashes). Two texts link when
``100 * |A and B| >= percent * |A or B|``.

1. *Roots.* Sets that link differ in at most D elements, D following from their sizes. The hash space is cut into more than
   D segments, so linked sets agree on all elements of at least one segment. Every set reports a key for each segment that isn't empty; sets that
   share a key stand under the same root. Sets with so many empty segments that these alone may be the equal ones report their
   least elements as well, as many as can't all be missing in a linked set.
2. *Hubs.* Each set is compared with the one that comes first under most of its roots. What links is
   united, so that a group of near copies is one part before any pairs are looked at. Roots with sets of one part alone, and roots
   with the same sets as another root, are done with.
3. *Nodes.* The sets under a root are dealt to nodes of bounded size. In a node they hang in a tree whose inner nodes hold
   the OR of the token bitmaps below and the range of set sizes. A leaf also holds the parities of its tokens by bit.
4. *Dual traversal.* Pairs of nodes of a root descend together; a pair is dropped when the size ranges exclude a link or when the bits
   that both have, with the largest surplus of tokens over bits, stay below the overlap that the smallest sizes need. Two leaves are dropped
   when more of their parities differ than tokens of linked sets can.
5. *Spanning pairs.* Of the pairs that a pair of nodes leaves, nearest first, only those that unite two parts go out to be intersected
   exactly; members of pairs that are held back are marked. Then what links is united, and of marked members of a root every
   remaining pair of different parts goes out. A group of near copies so gives about as many pairs as it has members, and no link between parts is lost.

Equal sets are one class from the start. Texts without words link with nothing. Rows with a null id are returned with a null
component and link with nothing; rows that repeat an id are one vertex. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.shared import bucketed, discard, forget, slices, small_batches, text_or_empty, written
from siltstone.llm.words import mix, shingle_sets

RATIO = 1.5  # of a size band's end to its start
NODE_SETS, NODE_SHINGLES, FANOUT = 256, 1 << 18, 16
HUB_LEAST = 3  # a set is compared with a hub if they share so many roots; the trees find the other links
SEEN_MOST = 1 << 20


def smallest(percent: int) -> int:
    """The smallest set that can link with a set other than itself."""
    return math.ceil(percent / (100 - percent))


def band(n: int, percent: int) -> int:
    at = int(math.log(n / smallest(percent)) / math.log(RATIO))
    while band_start(at + 1, percent) <= n:
        at += 1
    while band_start(at, percent) > n:
        at -= 1
    return at


def band_start(at: int, percent: int) -> int:
    return math.ceil(smallest(percent) * RATIO**at)


def differences(at: int, percent: int) -> int:
    """The most elements in which linked sets differ whose smaller one is in this band."""
    small = band_start(at + 1, percent) - 1
    large = small * 100 // percent
    return (100 - percent) * (small + large) // (100 + percent)


def segments(at: int, percent: int) -> int:
    d = differences(at, percent)
    return d + 1 + max(2, math.ceil(0.12 * d))


def segment_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """The root keys of one set: its own size band's, and the next smaller one's if it can link with a set from there."""
    n = len(elements)
    if n < smallest(percent):
        return np.zeros(0, np.uint64)
    own, out = band(n, percent), []
    for at in (own, own - 1):
        if at < own and (at < 0 or -(-percent * n // 100) >= band_start(own, percent)):
            continue
        k, d = segments(at, percent), differences(at, percent)
        segment = ((elements >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(elements), out=total[1:])
        edge = np.searchsorted(segment, np.arange(k + 1, dtype=np.uint64))
        signature = total[edge[1:]] - total[edge[:-1]]
        full = edge[1:] > edge[:-1]
        if k - full.sum() >= k - d:  # empty segments alone may be what linked sets share: then both report their first elements too
            out.append(mix(elements[: n - -(-percent * n // 100) + 1] + np.uint64(at + 1)))
        where = np.flatnonzero(full).astype(np.uint64)
        out.append(mix(signature[full] + mix(where * np.uint64(1 << 20) + np.uint64(at + 1))))
    return np.concatenate(out)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                sets = [(len(s), xxhash.xxh3_128_digest(s.tobytes())) for s in shingle_sets(texts.slice(a, b - a), k)]
                half = lambda at: pa.array([int.from_bytes(d[at : at + 8], "big", signed=True) for _, d in sets], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for n, _ in sets], pa.int64()), half(0), half(8)], ["doc_id", "n_shingles", "d1", "d2"])

    return run


def _key_rows(k: int, percent: int):
    """The keys of each set; copies within a task report them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                rows = []
                for i, s in enumerate(shingle_sets(texts.slice(a, b - a), k)):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest in seen or not len(keys := segment_keys(s, percent)):
                        continue
                    if len(seen) > SEEN_MOST:
                        seen.clear()
                    seen.add(digest)
                    rows.append((a + i, len(s), int.from_bytes(digest[:8], "big", signed=True), keys.view(np.int64)))
                if rows:
                    at, n, d1, keys = zip(*rows, strict=True)
                    times = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                    own = [ids.take(pa.array(at)), pa.array(d1, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(x.take(times) for x in own)], ["key", "doc_id", "d1", "n"])

    return run


def sketch(s: np.ndarray, per_element: int) -> np.ndarray:
    """How many elements fall on each bit, by their last bits; the number of bits is a power of two."""
    bits = min(1 << 20, max(256, 1 << (per_element * len(s) - 1).bit_length()))
    return np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element: 2 to 4 bits an element."""
    return np.packbits(sketch(s, 2) > 0).tobytes()


def parities(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of elements falls on it, 4 to 8 bits an element: two sets differ in at least as many elements as bits."""
    return np.packbits((sketch(s, 4) & 1).astype(bool)).tobytes()


def folded(odd: np.ndarray, size: int) -> np.ndarray:
    """Parities on fewer bits: bits that now fall together are added."""
    return np.bitwise_xor.reduce(odd.reshape(-1, size), axis=0)


def _bodies(k: int):
    """The texts, bitmaps and parities of members; a row whose digest isn't the asked one (an id that repeats) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, texts = batch.column("d1"), batch.column("text")
            for a, b in slices(texts):
                keep, maps, odds = [], [], []
                for i, s in enumerate(shingle_sets(texts.slice(a, b - a), k)):
                    if int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True) == d1[a + i].as_py():
                        keep.append(a + i)
                        maps.append(bitmap(s))
                        odds.append(parities(s))
                part = batch.select(["doc_id", "text"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(maps, pa.binary()), pa.array(odds, pa.binary())], ["doc_id", "text", "map", "odd"])

    return run


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _verified(k: int, percent: int):
    """Pairs (u, v, text, other) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others, keep = batch.column("text"), batch.column("other"), []
            for a, b in slices(texts):
                pairs = zip(shingle_sets(texts.slice(a, b - a), k), shingle_sets(others.slice(a, b - a), k), strict=True)
                keep += [a + i for i, (s, t) in enumerate(pairs) if alike(s, t, percent)]
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


class Tree:
    """The sets of a node, by size; level 0 has a bitmap for each set, each next level the OR of FANOUT of the one below.

    Shorter bitmaps are repeated up to ``size`` bytes: they then hold more bits than the set has, never fewer.
    """

    def __init__(self, members: list[dict], size: int):
        members = sorted(members, key=lambda m: (m["n"], m["doc_id"]))
        self.ids, self.parts = [m["doc_id"] for m in members], [m["part"] for m in members]
        sizes = np.array([m["n"] for m in members], np.int64)
        own = [np.frombuffer(m["map"], np.uint8) for m in members]
        maps = np.stack([np.tile(x, size // len(x)) for x in own]).view(np.uint64)
        surplus = sizes - np.array([int(np.bitwise_count(x).sum()) for x in own], np.int64)
        self.sizes, self.odds = sizes, [np.frombuffer(m["odd"], np.uint8) for m in members]
        self.levels = [(maps, sizes, sizes, surplus)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, surplus = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at)))

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][0])))


def possible(x: tuple, rows: range, y: tuple, cols: range, percent: int) -> np.ndarray:
    """Pairs of nodes under which a link is possible by size and by the largest overlap."""
    (mx, lx, hx, sx), (my, ly, hy, sy) = ([a[r.start : r.stop] for a in t] for t, r in ((x, rows), (y, cols)))
    fits = (100 * hx[:, None] >= percent * ly[None, :]) & (100 * hy[None, :] >= percent * lx[:, None])
    if fits.any():
        shared = np.bitwise_count(mx[:, None, :] & my[None, :, :]).sum(2, dtype=np.int64)
        most = shared + np.minimum(sx[:, None], sy[None, :])
        fits &= (100 + percent) * most >= percent * (lx[:, None] + ly[None, :])
    return fits


def differing(x: Tree, rows: range, y: Tree, cols: range) -> np.ndarray:
    """In how many parities each two leaves differ, at the resolution of the coarsest."""
    size = min(len(t.odds[i]) for t, r in ((x, rows), (y, cols)) for i in r)
    a, b = (np.stack([folded(t.odds[i], size) for i in r]).view(np.uint64) for t, r in ((x, rows), (y, cols)))
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)


def candidates(first: list[dict], second: list[dict] | None, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(differing parities, ids, parts) of pairs of different parts within one node, or between two nodes, that may link."""
    size = max(len(m["map"]) for part in (first, second or []) for m in part)
    x = Tree(first, size)
    y = x if second is None else Tree(second, size)
    same, found = y is x, []
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        rows = x.children(lx, i) if lx else range(i, i + 1)
        cols = y.children(ly, j) if ly else range(j, j + 1)
        down_x, down_y = max(lx - 1, 0), max(ly - 1, 0)
        fits = possible(x.levels[down_x], rows, y.levels[down_y], cols, percent)
        if down_x == 0 and down_y == 0:
            if fits.any():
                apart = differing(x, rows, y, cols)
                fits &= (100 + percent) * apart <= (100 - percent) * (x.sizes[rows.start : rows.stop, None] + y.sizes[None, cols.start : cols.stop])
            for r, c in np.argwhere(fits):
                i, j = rows[r], cols[c]
                if x.parts[i] != y.parts[j] and not (same and i >= j):
                    found.append((int(apart[r, c]), min(x.ids[i], y.ids[j]), max(x.ids[i], y.ids[j]), x.parts[i], y.parts[j]))
            continue
        for r, c in np.argwhere(fits):
            if not (same and down_x == down_y and rows[r] > cols[c]):
                stack.append((down_x, rows[r], down_y, cols[c]))
    return found


def spanning(pairs: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int]], set[int]]:
    """Of pairs, nearest first, those that unite two parts; the ids of pairs that are held back."""
    root: dict[int, int] = {}

    def find(p: int) -> int:
        while (q := root.get(p, p)) != p:
            root[p] = root.get(q, q)
            p = q
        return p

    out, held = [], set()
    for _, u, v, p, q in sorted(pairs):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            out.append((u, v))
        else:
            held |= {u, v}
    return out, held


def _candidates(percent: int, every: bool):
    """Rows (u, v) of pairs to be intersected and, unless ``every`` pair goes out, rows (u, key) of members that are in pairs held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            held: set[tuple[int, int]] = set()
            for key, members, other in zip(*(batch.column(c) for c in ("key", "members", "other")), strict=True):
                pairs = candidates(members.as_py(), other.as_py(), percent)
                if every:
                    found.update(p[1:3] for p in pairs)
                    continue
                out, back = spanning(pairs)
                found.update(out)
                held.update((u, key.as_py()) for u in back)
            rows = [(u, v, None) for u, v in sorted(found)] + [(u, None, k) for u, k in sorted(held)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["u", "v", "key"])

    return run


def near_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_shingles, component_id), one row for each row of ``docs``.

    component_id is the smallest doc_id that links reach. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sets = written(docs.mapInArrow(_set_rows(k), "doc_id long, n_shingles long, d1 long, d2 long"), "sets")
    linkable = sets.where("n_shingles > 0 and doc_id is not null")

    # equal sets: the smallest id stands for all
    classes = written(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    copies = written(linkable.select(F.col("doc_id").alias("u"), "d1", "d2").join(classes, ["d1", "d2"]).where("u <> v").select("u", "v", F.col("d1").alias("_d1")).distinct(), "copies")
    # an id with several sets is one vertex: it links the classes of all of them
    several_sets = linkable.groupBy(F.col("doc_id").alias("u")).agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high").select("u")
    bridges = written(copies.join(several_sets, "u", "left_semi").select("u", "v").distinct(), "bridges")

    # what stands under a root with another set
    keyed = docs.where("doc_id is not null").mapInArrow(_key_rows(k, percent), "key long, doc_id long, d1 long, n long")
    by_key = Window.partitionBy("key")
    together = keyed.select("*", F.min("d1").over(by_key).alias("low"), F.max("d1").over(by_key).alias("high")).where("low < high").drop("low", "high")
    shared = together.join(copies, (F.col("doc_id") == F.col("u")) & (F.col("d1") == F.col("_d1")), "left").select("key", F.coalesce("v", "doc_id").alias("doc_id"), "d1", "n")
    shared = written(shared.distinct(), "shared")
    members = shared.select(F.col("doc_id").alias("member"), "d1").distinct()
    # members grow with the documents, so they are never broadcast
    bodies, table = bucketed(members.hint("merge").join(docs, F.col("member") == F.col("doc_id")).select("doc_id", "text", "d1").mapInArrow(_bodies(k), "doc_id long, text string, map binary, odd binary"), "bodies", "doc_id")
    texts = bodies.select("doc_id", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.withColumnRenamed("doc_id", "u"), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("other")), "v")
        return written(both.mapInArrow(_verified(k, percent), "u long, v long"), "links")

    def several(rows: DataFrame) -> DataFrame:
        """Rows of roots with several parts, parts by the links so far."""
        parts = components(reduce(DataFrame.union, linked)).withColumnsRenamed({"id": "doc_id", "component": "part"})
        named = rows.join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        return written(named.select("*", F.min("part").over(by_key).alias("low"), F.max("part").over(by_key).alias("high")).where("low < high").drop("low", "high"), "left")

    place = F.struct(F.xxhash64("doc_id"), "doc_id")
    stars = shared.select("doc_id", F.min(place).over(by_key).alias("hub")).where("doc_id <> hub.doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("n")).where(f"n >= {HUB_LEAST}")
    linked = [bridges, verified(stars.groupBy(F.col("doc_id").alias("u")).agg(F.max_by("hub.doc_id", F.struct("n", "hub")).alias("v")))]
    left = several(shared)
    discard(shared)

    # one of the roots with the same sets
    same = F.struct(F.count("*"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")), F.min("doc_id"), F.max("doc_id")).alias("same")
    roots = left.groupBy("key").agg(same, F.ceil(F.greatest(F.count("*") / NODE_SETS, F.sum("n") / NODE_SHINGLES)).cast("int").alias("n_nodes"))
    roots = written(roots.groupBy("same").agg(F.min(F.struct("key", "n_nodes")).alias("root")).select("root.*"), "roots")

    def pairs(rows: DataFrame, every: bool) -> DataFrame:
        """What the trees of the roots leave."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.col("n_nodes").cast("long")).cast("int").alias("bucket")
        rows = rows.select("key", "n_nodes", bucket, "doc_id", "part", "n").join(bodies.select("doc_id", "map", "odd"), "doc_id")
        members = F.collect_list(F.struct("doc_id", "part", "n", "map", "odd")).alias("members")
        alone = rows.where("n_nodes = 1").groupBy("key").agg(members)
        wide = written(rows.where("n_nodes > 1").groupBy("key", "n_nodes", "bucket").agg(members), "nodes")
        alone = alone.select("key", "members").union(wide.select("key", "members")).withColumn("other", F.lit(None).cast(wide.schema["members"].dataType))
        aimed = wide.where("bucket < n_nodes - 1").select("key", F.explode(F.expr("sequence(bucket + 1, n_nodes - 1)")).alias("bucket"), "members")
        across = aimed.join(wide.select("key", "bucket", F.col("members").alias("other")), ["key", "bucket"]).select("key", "members", "other")
        small_batches(spark, 64)
        found = written(alone.union(across).mapInArrow(_candidates(percent, every), "u long, v long, key long"), "pairs")
        small_batches(spark)
        discard(wide)
        return found

    left = left.join(roots, "key")
    found = pairs(left, False)
    linked.append(verified(found.where("key is null").select("u", "v").distinct()))
    back = found.where("key is not null").select("key", F.col("u").alias("doc_id")).distinct()
    held = several(left.drop("part").join(back, ["key", "doc_id"], "left_semi"))
    linked.append(verified(pairs(held, True).select("u", "v").distinct()))

    whole = components(reduce(DataFrame.union, linked)).select(F.col("id").alias("v"), F.col("component").alias("reached"))
    forget(bodies, table)
    named = sets.select("doc_id", "n_shingles").join(copies.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("v")), "doc_id", "left").withColumn("v", F.coalesce("v", "doc_id"))
    return named.join(whole, "v", "left").select("doc_id", "n_shingles", F.coalesce("reached", "v").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; columns and everything else stay.

    Rows with a null id stay. Of rows that repeat an id, all stay or go together.
    """
    gone = near_join(docs.select("doc_id", "text"), k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
