"""Depth-limited count tries over word sequences, level by level in numpy: built from texts, cut at borders, serialised sorted, merged.

A node stands for a sequence of words: level 0 for a group (a language), level k for k words behind one another in one piece. Nodes of a level are
sorted by parent and word, so a level is in the order of its sequences. In preorder (a sequence before its extensions) the nodes between two borders are one slice.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm.shared import buffers
from siltstone.llm.words import UPPER

#: Bytes that end a piece, and bytes that end a word within a piece.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2
WRITE = pa.ipc.IpcWriteOptions(compression="zstd")


@dataclass
class Stream:
    """Words behind one another: their bytes, which of them open a piece, and the group of each."""

    words: pa.LargeBinaryArray
    opens: np.ndarray
    group: np.ndarray


def stream(texts: pa.Array, groups: np.ndarray) -> Stream:
    """The words of texts with A-Z in lower case; text i belongs to the group number ``groups[i]``."""
    data, offsets = buffers(texts)
    kind = KIND[data]
    inner = kind == 0
    begins, ends = inner.copy(), inner.copy()
    if len(data):
        begins[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inner[edges]
        ends[edges - 1] = inner[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    first = np.searchsorted(start, offsets)
    opens = np.ones(len(start), bool)
    opens[1:] = piece[1:] != piece[:-1]
    opens[first[first < len(start)]] = True
    at = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(UPPER[data[inner]])])
    return Stream(words, opens, np.repeat(groups, np.diff(first)))


@dataclass
class Level:
    """Nodes: their parents' numbers in the level above, their words' numbers, counts, and whether they belong to the range at hand."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray
    own: np.ndarray


@dataclass
class Trie:
    words: pa.LargeBinaryArray  # sorted
    levels: list[Level]

    def nodes(self) -> int:
        return sum(len(x.word) for x in self.levels)


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the number of each word among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _grouped(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of each key among them, and the sum of ``count`` (of ones) for each."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    sums = np.diff(np.append(start, len(key))) if count is None else np.add.reduceat(count[order], start)
    return ordered[start], number, sums


def build(parts: list[Stream], groups: list[bytes], longest: int) -> Trie:
    """The trie of all sequences of up to ``longest`` words within pieces."""
    names, code = ranked(pa.concat_arrays([pa.array(groups, pa.large_binary()), *(s.words for s in parts)]))
    group, word = code[: len(groups)][np.concatenate([s.group for s in parts])], code[len(groups) :]
    opens = np.concatenate([s.opens for s in parts])
    at = np.flatnonzero(opens)
    left = np.append(at[1:], len(word))[np.cumsum(opens) - 1] - np.arange(len(word))  # words to the end of the piece
    v = np.int64(max(1, len(names)))
    where, levels = np.arange(len(word)), []
    key, number, count = _grouped(group)
    levels.append(Level(np.zeros(len(key), np.int64), key, count, np.ones(len(key), bool)))
    for k in range(1, longest + 1):
        keep = left[where] >= k
        where, number = where[keep], number[keep]
        key, number, count = _grouped(number * v + word[where + k - 1])
        levels.append(Level(key // v, key % v, count, np.ones(len(key), bool)))
    return Trie(names, levels)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of all; nodes that all have are one node."""
    if len(tries) == 1:
        return tries[0]
    names, code = ranked(pa.concat_arrays([t.words for t in tries]))
    codes = np.split(code, np.cumsum([len(t.words) for t in tries])[:-1])
    v, numbers, levels = np.int64(max(1, len(names))), [np.zeros(1, np.int64)] * len(tries), []
    for k in range(len(tries[0].levels)):
        mine = [t.levels[k] for t in tries]
        keys = np.concatenate([n[x.parent] * v + c[x.word] for n, c, x in zip(numbers, codes, mine, strict=True)])
        key, number, count = _grouped(keys, np.concatenate([x.count for x in mine]))
        own = np.zeros(len(key), bool)
        own[number] = np.concatenate([x.own for x in mine])
        levels.append(Level(key // v, key % v, count, own))
        numbers = np.split(number, np.cumsum([len(x.word) for x in mine])[:-1])
    return Trie(names, levels)


class Preorder:
    """The nodes of a trie in preorder, to be cut at borders."""

    def __init__(self, trie: Trie):
        self.trie, self.levels = trie, trie.levels
        self.listed = trie.words.to_pylist()
        sizes = [np.ones(len(x.word), np.int64) for x in self.levels]
        self.child: list[np.ndarray] = []  # of each node the first child's number; one more at the end
        for k in range(len(self.levels) - 1, 0, -1):
            total = np.concatenate([[0], np.cumsum(sizes[k])])
            child = np.searchsorted(self.levels[k].parent, np.arange(len(sizes[k - 1]) + 1))
            sizes[k - 1] += total[child[1:]] - total[child[:-1]]
            self.child.insert(0, child)
        self.place = [np.cumsum(sizes[0]) - sizes[0]]
        for k in range(1, len(self.levels)):
            before, parent = np.cumsum(sizes[k]) - sizes[k], self.levels[k].parent
            head = self.child[k - 1][:-1]
            self.place.append(self.place[-1][parent] + 1 + before - before[head[parent]] if len(parent) else before)
        self.sizes = sizes
        n = sum(map(len, sizes))
        self.depth, self.word, self.count = np.empty(n, np.int8), np.empty(n, np.int32), np.empty(n, np.int64)
        for k, (place, x) in enumerate(zip(self.place, self.levels, strict=True)):
            self.depth[place], self.word[place], self.count[place] = k, x.word, x.count

    def cut(self, border: tuple[bytes, ...]) -> tuple[int, list[int]]:
        """The place of the first node at or behind ``border``, and the places of the border's own beginnings before it."""
        low, high, end, above = 0, len(self.levels[0].word), len(self.depth), []
        for k, name in enumerate(border):
            rank = bisect_left(self.listed, name)
            i = low + int(np.searchsorted(self.levels[k].word[low:high], rank))
            if i == high:
                return end, above
            place = int(self.place[k][i])
            if k == len(border) - 1 or self.listed[self.levels[k].word[i]] != name:
                return place, above
            above.append(place)
            end = place + int(self.sizes[k][i])
            low, high = (int(self.child[k][i]), int(self.child[k][i + 1])) if k < len(self.child) else (0, 0)
        return end, above

    def ranges(self, borders: list[tuple[bytes, ...]]):
        """(range, blob, beginnings): range i lies before border i; its blob begins with the beginnings of its lower border."""
        low, above = 0, []
        for i, border in enumerate([*borders, None]):
            high, following = self.cut(border) if border else (len(self.depth), [])
            if high > low or above:
                yield i, self.serialised(np.concatenate([np.array(above, np.int64), np.arange(low, high)])), len(above)
            low, above = high, following

    def serialised(self, places: np.ndarray) -> bytes:
        used, word = np.unique(self.word[places], return_inverse=True)
        coded = pa.DictionaryArray.from_arrays(pa.array(word.astype(np.int32)), self.trie.words.take(pa.array(used)))
        batch = pa.record_batch({"depth": pa.array(self.depth[places]), "word": coded, "count": pa.array(self.count[places])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=WRITE) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def restored(blob: bytes, beginnings: int, longest: int) -> Trie:
    """The trie of a blob; its first ``beginnings`` nodes belong to ranges before."""
    batch = pa.ipc.open_stream(blob).read_next_batch()
    depth, count = batch["depth"].to_numpy(), batch["count"].to_numpy()
    word = batch["word"].indices.to_numpy().astype(np.int64)
    levels, above = [], None
    for k in range(longest + 1):
        here = depth == k
        at = np.flatnonzero(here)
        parent = above[at] if k else np.zeros(len(at), np.int64)
        above = np.cumsum(here) - 1  # of each place the last node of this level up to it
        levels.append(Level(parent, word[at], count[at], at >= beginnings))
    return Trie(batch["word"].dictionary, levels)


def walked(trie: Trie, least: int):
    """(level, words, count, counts of all beginnings) of the range's own nodes with ``least`` or more, and of its groups."""
    names, above = trie.words.to_pylist(), []
    for k, x in enumerate(trie.levels):
        at = np.flatnonzero(x.own & (x.count >= least)) if k else np.flatnonzero(x.own)
        paths, counts, i = [x.word[at]], [x.count[at]], at
        for upper in range(k - 1, -1, -1):
            i = trie.levels[upper + 1].parent[i]
            paths.insert(0, trie.levels[upper].word[i])
            counts.insert(0, trie.levels[upper].count[i])
        above = np.stack(counts, 1) if len(at) else np.zeros((0, k + 1), np.int64)
        for path, beginnings in zip(np.stack(paths, 1).tolist() if len(at) else [], above.tolist(), strict=True):
            yield k, [names[w] for w in path], beginnings
