"""Passages whose places were found only by luck: repetitive ones, few cuts, parts that come first elsewhere, long words."""

import random

import pytest

from helpers import WORD, documents, prose
from siltstone.llm import substring_dedup, suffixes


def missed(texts, rows, k=50):
    """Windows of k words that an earlier place has as well, but no row covers."""
    spans, seen, out = {}, set(), []
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["span_start"], r["span_end"]))
    for i in sorted(texts):
        found = [*WORD.finditer(texts[i])]
        for a in range(len(found) - k + 1):
            key = tuple(m[0] for m in found[a : a + k])
            low, high = (len(texts[i][:x].encode()) for x in (found[a].start(), found[a + k - 1].end()))
            if key in seen and not any(s <= low and high <= e for s, e in spans.get(i, [])):
                out.append((i, a))
            seen.add(key)
    return out


FINDERS = pytest.mark.parametrize("find", [substring_dedup.repeated_passages, suffixes.suffix_repeats])


@FINDERS
def test_repetitive_passages(spark, find):
    texts = {}
    for n, unit in enumerate(["0", "| -", "a b c", "no more of it"]):
        for m, size in enumerate([60, 100, 200, 700]):
            run = " ".join((unit.split() * size)[:size])
            texts[10 * n + m] = f"{prose(10 * n + m, 23 + m)} {run} {prose(500 + 10 * n + m, 17 + 3 * m)}"
    assert missed(texts, find(documents(spark, [*texts.items()])).collect()) == []


def test_every_window_decides_a_chunk():
    rng = random.Random(5)
    for n in range(4000):
        passage = [rng.getrandbits(63) for _ in range(50)]
        found = []
        for _ in range(2):
            before = [rng.getrandbits(63) for _ in range(30)]
            h = substring_dedup.np.array([*before, *passage, *before[::-1]], dtype="uint64")
            begin, end, digest, low, high, *_ = substring_dedup.chunks_of(h, 50)
            found.append({(b, e, d) for b, e, d, x, y in zip(begin, end, digest, low, high) if x <= 30 <= y and b >= 30 and e <= 80})
        assert found[0] == found[1] and found[0], n


def test_passages_whose_parts_come_first_elsewhere(spark):
    for seed in range(3):
        p = prose(7000 + seed, 60).split()
        parts = {1: p[:49], 2: p[11:], 5: p, 9: p}
        texts = {i: " ".join([prose(seed + 10 * i, 40), *w, prose(seed + 10 * i + 5, 40)]) for i, w in parts.items()}
        rows = substring_dedup.repeated_passages(documents(spark, [*texts.items()])).collect()
        assert [(r["doc_id"], r["other_id"], r["n_words"]) for r in rows] == [(9, 5, 60)]
        assert missed(texts, rows) == []


@FINDERS
def test_no_window_is_missed_among_many_parts(spark, find):
    rng = random.Random(3)
    pool = [prose(8000 + i, 140).split() for i in range(3)]
    texts = {}
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            p, a = rng.choice(pool), rng.randint(0, 100)
            words += [*p[a : a + rng.randint(10, 75)], *prose(9000 + 7 * i + len(words), rng.randint(0, 12)).split()]
        texts[i] = " ".join(words)
    assert missed(texts, find(documents(spark, [*texts.items()])).collect()) == []


@FINDERS
def test_later_copies_of_short_passages_are_named(spark, find):
    """Passages of 50 to 58 words in four texts each: every copy but the first is a doc_id, wherever it stands in suffix order."""
    rng, words = random.Random(11), {i: [] for i in range(160)}
    homes = []
    for n in range(40):
        passage = prose(20_000 + n, 50 + n % 9)
        homes.append(sorted(rng.sample(range(160), 4)))
        for i in homes[-1]:
            words[i] += [prose(rng.random(), rng.randint(5, 40)), passage]
    texts = {i: " ".join([*w, prose(rng.random(), 20)]) for i, w in words.items()}
    rows = find(documents(spark, [*texts.items()])).collect()
    assert missed(texts, rows) == []
    assert {r["doc_id"] for r in rows} == {i for h in homes for i in h[1:]}
    assert all((r["other_id"], r["other_start"]) < (r["doc_id"], r["span_start"]) for r in rows)


@FINDERS
def test_passages_of_long_words(spark, find):
    """50 words of 120 to 9,000 bytes, between other words: one slice around a seed does not hold them."""
    texts, rng = {}, random.Random(8)
    for n, size in enumerate([120, 400, 9000]):
        passage = " ".join(prose(60 * n + i, 1 + size // 6).replace(" ", "")[:size] for i in range(50))
        for m in range(2):
            texts[10 * n + m] = f"{prose(rng.random(), 60)} {passage} {prose(rng.random(), 60)}"
    rows = find(documents(spark, [*texts.items()])).collect()
    assert sorted((r["doc_id"], r["other_id"], r["n_words"]) for r in rows) == [(10 * n + 1, 10 * n, 50) for n in range(3)]
    assert missed(texts, rows) == []
