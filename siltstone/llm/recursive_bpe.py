"""Byte-level BPE by recursive DuckDB queries inside each Spark partition: token positions, a merge table, contraction to a fixed point.

The vocabulary is a rank file: a token's rank is its id, and two neighbours merge if their bytes together are a token. The merge table
holds every split of a token into two tokens. Pieces of texts (matches of the pre-tokenizer's pattern) that are tokens themselves need no merging.
The distinct others of a batch become rows (fragment, position, token), one for each byte. Every round of the recursive query
joins neighbours to the merge table and contracts, in each fragment, the pair of least rank at its leftmost place; in long fragments also at the other places of
that pair if no token made from the new one has a lower rank (``alone`` marks the tokens for which one has), as nothing could come between them.
A fragment without a pair in the table drops out; the query ends when none is left. Decoding joins (row, position, token) to the vocabulary
and aggregates the bytes in the order of positions.

Long pieces are cut into fragments between bytes that stand side by side in no token, where no merge can cross. DuckDB runs with one thread,
writes nothing to disk, and gets at most ``POSITIONS`` bytes a query (one longer fragment stands alone).

Null texts encode like the empty text, to no tokens, and decode to it. Rows that repeat are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.shared import slices, small_batches, text_or_empty

POSITIONS = 1 << 18  # bytes of distinct pieces in a query
CACHED = 1 << 20  # pieces whose tokens a worker keeps
FEW = 48  # bytes of a short fragment; longer pieces are cut where no merge can cross

#: Short fragments: one contraction a round, and all rounds' rows are kept, which their length bounds.
SHORT = """
WITH RECURSIVE t(f, p, tok, going) AS (
  SELECT f, p, tok, true FROM start
  UNION ALL
  (WITH near AS (SELECT f, p, tok, lead(tok) OVER x AS next_tok, lag(p) OVER x AS last_p FROM t WHERE going WINDOW x AS (PARTITION BY f ORDER BY p)),
   least AS (SELECT near.f, min(merges.made::BIGINT << 32 | near.p) AS pair FROM near JOIN merges ON near.tok = merges.x AND near.next_tok = merges.y GROUP BY near.f)
   SELECT near.f, p, CASE WHEN p = (pair & 4294967295) THEN (pair >> 32)::INT ELSE tok END, pair IS NOT NULL FROM near LEFT JOIN least ON near.f = least.f
   WHERE pair IS NULL OR last_p IS NULL OR last_p <> (pair & 4294967295))
), done AS (SELECT f, p, tok FROM t WHERE NOT going)
"""

#: Long ones: all places of the pair in a round, and only the last state of each position is kept.
LONG = """
WITH RECURSIVE t(f, p, tok) USING KEY (f, p) AS (
  SELECT f, p, tok FROM start
  UNION
  (WITH near AS (SELECT f, p, tok, row_number() OVER x AS place, lead(tok) OVER x AS next_tok, lead(p) OVER x AS next_p
     FROM recurring.t AS held WHERE tok IS NOT NULL AND f IN (SELECT f FROM t) WINDOW x AS (PARTITION BY f ORDER BY p)),
   pairs AS (SELECT near.*, merges.made, merges.alone FROM near JOIN merges ON near.tok = merges.x AND near.next_tok = merges.y),
   least AS (SELECT pairs.* FROM pairs JOIN (SELECT f, min(made) AS made FROM pairs GROUP BY f) USING (f, made)),
   runs AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p) AS nth FROM least),
   free AS (SELECT *, row_number() OVER (PARTITION BY f, place - nth ORDER BY p) % 2 = 1 AND (nth = 1 OR NOT alone) AS mine FROM runs)
   SELECT f, unnest([p, next_p]) AS p, unnest([made, NULL]) AS tok FROM free WHERE mine)
), done AS (SELECT f, p, tok FROM t WHERE tok IS NOT NULL)
"""

ENCODED = """
SELECT own.w, list(done.tok ORDER BY done.p) AS ids, unhex(string_agg(vocabulary.hex, '' ORDER BY done.p)) AS bytes
FROM done JOIN own USING (f) JOIN vocabulary ON done.tok = vocabulary.id GROUP BY own.w
"""

DECODE = "SELECT r, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY r"


class RankedBpe:
    """A rank file (base64 of a token's bytes and its rank on each line) and the DuckDB session of a worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(self.ranks[x], self.ranks[y], rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (x := token[:i]) in self.ranks and (y := token[i:]) in self.ranks]
        x, y, made = np.array(splits, np.int32).reshape(-1, 3).T
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(lowest, x, made)
        np.minimum.at(lowest, y, made)
        self.glued = np.zeros((256, 256), bool)
        for token in self.ranks:
            b = np.frombuffer(token, np.uint8)
            self.glued[b[:-1], b[1:]] = True
        self.sql = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.sql.register("given", pa.table({"x": x, "y": y, "made": made, "alone": lowest[made] < made}))
        self.sql.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.sql.unregister("given")
        self.sql.register("given", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [token.hex() for token in self.ranks]}))
        self.sql.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.sql.unregister("given")
        self.ids: dict[str, bytes] = {}  # of known pieces, little-endian
        self.back: dict[str, bytes] = {}  # what these decode to

    def contracted(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each piece its ids (little-endian, four bytes each) and what they decode to, by merging alone."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.concatenate([[0], np.cumsum(size)[:-1]])
        edge = np.zeros(len(data), bool)
        edge[begins] = True
        loose = np.flatnonzero(~self.glued[data[:-1], data[1:]]) + 1
        edge[loose[np.repeat(size, size)[loose] > FEW]] = True
        fragment = np.cumsum(edge, dtype=np.int32) - 1
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)[edge]
        self.sql.register("start", pa.table({"f": fragment, "p": np.arange(len(data), dtype=np.int32), "tok": self.single[data]}))
        self.sql.register("own", pa.table({"f": np.arange(len(owner), dtype=np.int32), "w": owner}))
        longest = int(np.diff(np.append(np.flatnonzero(edge), len(data))).max())
        found = self.sql.sql((SHORT if longest <= FEW else LONG) + ENCODED).to_arrow_table().combine_chunks()
        out: list = [None] * len(pieces)
        ids = found["ids"].combine_chunks()
        flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        for w, a, b, back in zip(found["w"].to_pylist(), at[:-1], at[1:], found["bytes"].to_pylist(), strict=True):
            out[w] = (flat[a:b].tobytes(), back)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make the cache hold these pieces."""
        if len(self.ids) + len(pieces) > CACHED:
            self.ids.clear()
            self.back.clear()
        new = {p: p.encode() for p in pieces.difference(self.ids)}
        queue = []
        for p, raw in new.items():
            if raw in self.ranks:
                self.ids[p], self.back[p] = self.ranks[raw].to_bytes(4, "little"), raw
            else:
                queue.append(p)
        queue.sort(key=lambda p: len(new[p]))  # pieces of a query take about as many rounds
        first, total = 0, 0
        for i in range(len(queue) + 1):
            n = len(new[queue[i]]) if i < len(queue) else 0
            if i > first and (i == len(queue) or total + n > POSITIONS or len(new[queue[first]]) <= FEW < n):
                for p, (ids, back) in zip(queue[first:i], self.contracted([new[p] for p in queue[first:i]]), strict=True):
                    self.ids[p], self.back[p] = ids, back
                first, total = i, 0
            total += n

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them in the cache."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        return cut

    def encoded(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces))

    def decoded(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        self.sql.register("ids", pa.table({"r": np.repeat(np.arange(len(rows)), size), "p": np.arange(len(flat)), "id": flat}))
        out = [b""] * len(rows)
        for r, raw in self.sql.sql(DECODE).fetchall():
            out[r] = raw
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> RankedBpe:
    return RankedBpe(path, pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                count, encoded, decoded = [], [], []
                for pieces in bpe.cut(batch.column(1).slice(a, b - a).to_pylist()):
                    ids = bpe.encoded(pieces)
                    count.append(len(ids) // 4)
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(bpe.back.__getitem__, pieces))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                ids = [np.frombuffer(bpe.encoded(pieces), "<u4").astype(np.int32) for pieces in bpe.cut([t or "" for t in part.column(at).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "token_ids"])

    return run


def _bytes(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("token_ids"))
            back = bpe.decoded([np.asarray(x or [], np.int64) for x in ids.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def _with(df: DataFrame, run, column: str, kind: str) -> DataFrame:
    """``df`` with a column that ``run`` adds; any of that name before is replaced."""
    df = df.drop(column)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {column} {kind}")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Digests of the ids as little-endian 32-bit integers, and of the bytes that they decode to. A document's bytes are those of its pieces one after
    the other, each aggregated from its ids in order.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with a column ``token_ids`` (array of int) added."""
    small_batches(docs.sparkSession, 200)
    return _with(docs, _tokens(path, pattern), "token_ids", "array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with a column ``decoded`` (binary) added: the bytes of ``token_ids``; a null array has none, ids that are no tokens are left out."""
    small_batches(rows.sparkSession, 200)
    return _with(rows, _bytes(path, pattern), "decoded", "binary")
