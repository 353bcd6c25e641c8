"""Near duplicates of embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` fixed random directions. On each, the projections are sorted, and a query collides with the vectors in the window
of ``+- WIDTH`` around its own projection: a range of ranks. Collisions are counted per pair over all projections. Pairs with at least as many
as a pair of exactly the threshold's cosine reaches with probability ``RECALL`` (binomial, from the window's share of a normal distribution)
are verified in double precision; nothing below the threshold links.

Only vectors with the same label and length are compared. Equal vectors are one weighted entry. The entries of a label are dealt to tiles of about
``TILE``; pairs of tiles are spread over the cluster. A pair of tiles returns sums of links and a spanning set of them, never all pairs.
Work still grows with the square of a label's distinct vectors, as collision windows hold a fixed share of them.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or id, link with nothing: n_links 0, their own component.
Repeated rows are other vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.shared import small_batches, written

PROJECTIONS, WIDTH, RECALL, TILE = 48, 0.3, 0.998, 1024


def collisions_needed(cosine: float) -> int:
    """The most collisions that a pair of this cosine has at least, with probability RECALL."""
    p = erf(WIDTH / sqrt(2 - 2 * cosine) / sqrt(2))
    tail, c = 0.0, PROJECTIONS
    while c > 0:
        tail += comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c)
        if tail >= RECALL:
            break
        c -= 1
    return c


def candidates(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y (unit vectors) with enough collisions."""
    directions = np.random.default_rng(20).normal(size=(x.shape[1], PROJECTIONS))
    px, py = x @ directions, y @ directions
    count = np.zeros((len(x), len(y)), np.uint8)
    for p in range(PROJECTIONS):
        order = np.argsort(py[:, p], kind="stable")
        line = py[order, p]
        rank = np.empty(len(y), np.uint16)
        rank[order] = np.arange(len(y))
        low = np.searchsorted(line, px[:, p] - WIDTH, "left").astype(np.uint16)
        size = np.searchsorted(line, px[:, p] + WIDTH, "right").astype(np.uint16) - low
        count += (rank[None, :] - low[:, None] < size[:, None]).view(np.uint8)  # modulo 2**16: below low wraps round
    return np.nonzero(count >= collisions_needed(cosine))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links i-j."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        if (root[i] == least).all() and (root[j] == least).all():
            break
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    return root


def _tile(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    items = column[row].values
    vectors = items.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return items.field("entry").to_numpy(), items.field("weight").to_numpy(), vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _compared(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entry, weight, x = _tile(batch.column("members"), row)
                alone = not batch.column("other")[row].is_valid
                if alone:
                    i, j = candidates(x, x, cosine)
                    i, j = i[i < j], j[i < j]
                else:
                    other, more, y = _tile(batch.column("other"), row)
                    i, j = candidates(x, y, cosine)
                    j = j + len(x)
                    entry, weight, x = np.concatenate([entry, other]), np.concatenate([weight, more]), np.concatenate([x, y])
                linked = np.concatenate([np.einsum("nd,nd->n", x[i[a : a + 65536]], x[j[a : a + 65536]]) >= cosine for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                i, j = i[linked], j[linked]
                links = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
                root, at = roots(len(x), i, j), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(entry[at]), pa.array(entry[root[at]]), pa.array(links[at].astype(np.int64))], ["entry", "root", "links"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row for each row."""
    small_batches(vectors.sparkSession, 8)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    usable = F.coalesce(usable, F.lit(False))
    group = [F.col("label"), F.size("embedding").alias("length")]
    digest = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("wide"), "embedding").alias("h2")]
    rows = written(vectors.select("vec_id", *group, *digest, usable.alias("usable")), "vectors")
    entries = vectors.where(usable).groupBy(*group, *digest, "embedding").agg(F.min("vec_id").alias("entry"), F.count("*").alias("weight"))
    entries = written(entries, "entries")

    tiles = entries.groupBy("label", "length").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    dealt = entries.join(tiles, ["label", "length"]).withColumn("tile", F.pmod(F.xxhash64("entry"), F.col("n_tiles").cast("long")).cast("int"))
    members = F.collect_list(F.struct("entry", "weight", "embedding")).alias("members")
    packed = written(dealt.groupBy("label", "length", "tile", "n_tiles").agg(members), "tiles")
    alone = packed.select("members", F.lit(None).cast(packed.schema["members"].dataType).alias("other"))
    aimed = packed.where("tile < n_tiles - 1").select("label", "length", F.explode(F.expr("sequence(tile + 1, n_tiles - 1)")).alias("tile"), "members")
    pairs = aimed.join(packed.select("label", "length", "tile", F.col("members").alias("other")), ["label", "length", "tile"]).select("members", "other")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(alone.union(pairs).repartition(parts).mapInArrow(_compared(cosine), "entry long, root long, links long"), "links")

    reached = components(found.select(F.col("entry").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"id": "entry", "component": "reached"})
    sums = found.groupBy("entry").agg(F.sum("links").alias("links"))
    known = entries.select("label", "length", "h1", "h2", "entry", "weight").join(sums, "entry", "left").join(reached, "entry", "left").withColumn("usable", F.lit(True))
    out = rows.join(known, ["label", "length", "h1", "h2", "usable"], "left")
    component = F.coalesce("reached", "entry", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
