"""Byte-level BPE encoding and decoding: speculate, verify, merge.

A text is cut into pieces by the pre-tokenizer's pattern. For each distinct piece of a batch greedy longest match proposes tokens. A
proposal is the BPE encoding exactly when every adjacent pair of its tokens is compatible: when no merge across their border would have come
before the merges that built the two tokens. All pairs of a batch are tested at once with numpy: the tests walk back through the
merges on both sides of the border, latest first. Only pieces with an incompatible pair undergo exact merging with a heap.

Null texts encode like the empty text, to no tokens. Rows that repeat are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.shared import slices, small_batches, text_or_empty

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1 << 19  # pieces whose tokens a worker keeps
SHORT = 40  # bytes up to which merging goes without a heap


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = {name: bytes(letters[c] for c in name) for name in model["vocab"]}
        self.ids = {raw[name]: i for name, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        size = max(self.bytes) + 1
        # of each token: when it is made, and of what. Single bytes are there from the start.
        self.born, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            made = self.ids[raw[x] + raw[y]]
            self.merges.setdefault((self.ids[raw[x]], self.ids[raw[y]]), (rank, made))
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, self.ids[raw[x]], self.ids[raw[y]]
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # a token that merging does not rebuild from its own bytes is never proposed
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.proposed = dict(self.ids)
        tokens = [(b, i) for b, i in self.ids.items() if len(b) > 1]
        sound = self.compatible(self.left[[i for _, i in tokens]], self.right[[i for _, i in tokens]], self.born[[i for _, i in tokens]])
        for (b, i), whole in zip(tokens, sound, strict=True):
            if self.born[i] < 0 or not whole and self.merged(b) != [i]:
                del self.proposed[b]
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For pairs of adjacent tokens: does no merge cross their border (before the merge ``until``, if given)?"""
        x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
        never = np.int64(1) << 40
        x_ends = np.full(len(x), never) if until is None else until.astype(np.int64).copy()
        y_ends = x_ends - (until is not None)
        fine = np.ones(len(x), bool)
        open_ = np.arange(len(x))
        while len(open_):
            a, b = x[open_], y[open_]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
            # of equal merges the left one comes first: the crossing one is right of x's own and left of y's
            crossed = (rank < x_ends[open_]) & (rank <= y_ends[open_]) & (rank < never)
            fine[open_[crossed]] = False
            born_a, born_b = self.born[a], self.born[b]
            back_x = born_a > born_b
            going = ~crossed & ((born_a >= 0) | (born_b >= 0))
            i = open_[going & back_x]
            x_ends[i], x[i] = self.born[x[i]], self.right[x[i]]
            i = open_[going & ~back_x]
            y_ends[i], y[i] = self.born[y[i]], self.left[y[i]]
            open_ = open_[going]
        return fine

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals."""
        if len(piece) <= SHORT:
            return self.merged_short(piece)
        tokens = [self.single[b] for b in piece]
        after, before = [*range(1, len(tokens)), -1], [-1, *range(len(tokens) - 1)]
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (m := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := self.merges.get((tokens[k], tokens[after[k]]))):
                    heapq.heappush(heap, (m[0], k, tokens[k], tokens[after[k]]))
        return [t for t in tokens if t >= 0]

    def merged_short(self, piece: bytes) -> list[int]:
        """The same for few bytes: the ranks of all adjacent pairs are kept in a list."""
        never, get = (1 << 40, -1), self.merges.get
        tokens = [self.single[b] for b in piece]
        pairs = [get(p, never) for p in zip(tokens, tokens[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is never:
                break
            i = pairs.index(best)
            tokens[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((tokens[i - 1], best[1]), never)
            if i < len(pairs):
                pairs[i] = get((best[1], tokens[i + 1]), never)
        return tokens

    def greedy(self, piece: bytes) -> list[int]:
        out, i, n = [], 0, len(piece)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                token = self.proposed.get(piece[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
        return out

    def pieces(self, texts: list[bytes]) -> list[list[int]]:
        """The tokens of each piece of text."""
        found = [self.greedy(p) for p in texts]
        flat = np.fromiter((t for p in found for t in p), np.int64)
        size = np.fromiter(map(len, found), np.int64, len(found))
        owner = np.repeat(np.arange(len(found)), size)
        inner = owner[1:] == owner[:-1]
        wrong = ~self.compatible(flat[:-1][inner], flat[1:][inner])
        for i in np.unique(owner[1:][inner][wrong]):
            found[i] = self.merged(texts[i])
        return found

    def cut(self, text: str) -> Iterator[str]:
        """Pieces of a text; special tokens stand alone, even where a pattern would join them."""
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield part
            else:
                yield from self.pattern.findall(part)

    def learn(self, pieces: set[str]) -> None:
        """Make the cache hold these pieces."""
        if len(self.cache) + len(pieces) > CACHED:
            self.cache.clear()
        new = [p for p in pieces if p not in self.cache]
        plain = [p for p in new if p not in self.special]
        for p, ids in zip(plain, self.pieces([p.encode() for p in plain]), strict=True):
            self.cache[p] = (",".join(map(str, ids)), len(ids), self.decode_bytes(ids))
        for p in set(new) - set(plain):
            self.cache[p] = (str(self.special[p]), 1, self.bytes[self.special[p]])

    def encode(self, text: str) -> list[int]:
        pieces = [*self.cut(text)]
        self.learn({*pieces})
        return [int(x) for p in pieces for x in self.cache[p][0].split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                cut = [[*bpe.cut(t)] for t in texts.slice(a, b - a).to_pylist()]
                bpe.learn({p for pieces in cut for p in pieces})
                count, encoded, decoded = [], [], []
                for pieces in cut:
                    known = [bpe.cache[p] for p in pieces]
                    count.append(sum(n for _, n, _ in known))
                    encoded.append(hashlib.sha256(",".join([s for s, _, _ in known]).encode()).hexdigest())
                    back = b"".join([x for _, _, x in known]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                ids = [bpe.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "token_ids"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the decoded text."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a column ``token_ids`` (array of int) added; any of that name before is replaced."""
    small_batches(docs.sparkSession, 200)
    docs = docs.drop("token_ids")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_tokens(path), f"{fields}, token_ids array<int>")
