"""Collocations against a plain version, for shards and ranges of any size."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import DOCS, awkward, documents, prose
from siltstone.llm import collocations, count_tries, registry


def plain(rows, longest=4, least=30, covers=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the contract, of (lang, text) rows."""
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    most = Counter()
    for (lang, *p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, *p[i : i + k]] = max(most[lang, *p[i : i + k]], a)
    found = {}
    for (lang, *p), a in candidates.items():
        if 100 * most[lang, *p] >= covers * a and most[lang, *p]:
            continue
        score, k = min((2_000_000 * a // (counts[lang, *p[:k]] + counts[lang, *p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, *p[:k]], counts[lang, *p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, sizes[lang], -s) for lang, some in found.items() for i, (s, a, p, x, y) in enumerate(sorted(some)[:top]))


def corpus(seed, n=60):
    """Few words, so that phrases repeat; phrases that stand in longer ones; every separator."""
    rng = random.Random(seed)
    words = ["a", "B", "cc", "dé", "é", "e-f", "\x01", "x\x1cy", "\U0001f600", "the"]
    ends = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "! ", ";", ":", "?", "..."]
    return [(rng.choice(["en", "fr", "", None, "d e"]), "".join(rng.choice(words) + rng.choice(ends) if rng.random() < 0.8 else "one two three four " for _ in range(rng.randint(0, 200)))) for _ in range(n)]


def test_counts_and_walks():
    import numpy as np
    import pyarrow as pa

    rows = corpus(1)
    langs = sorted({lang or "und" for lang, _ in rows})
    parts = [count_tries.stream(pa.array([t for _, t in rows[i : i + 7]]), np.array([langs.index(lang or "und") for lang, _ in rows[i : i + 7]])) for i in range(0, len(rows), 7)]
    whole = count_tries.build(parts, [x.encode() for x in langs], 4)
    expected = sorted(count_tries.walked(whole, 1))
    rng = random.Random(2)
    borders = sorted(tuple(p[: rng.randint(1, len(p))]) for _, p, _ in rng.sample(expected, 40))
    borders = sorted({*borders, (b"en", b"a"), (b"en", b"a", b"nowhere"), (b"zz",), (b"",)})
    ranges = {}
    for part in ([p] for p in parts):
        for i, blob, beginnings in count_tries.Preorder(count_tries.build(part, [x.encode() for x in langs], 4)).ranges(borders):
            ranges.setdefault(i, []).append(count_tries.restored(blob, beginnings, 4))
    got = [node for tries in ranges.values() for node in count_tries.walked(count_tries.merged(tries), 1)]
    assert sorted(got) == expected


@pytest.mark.parametrize("seed,range_bytes,shard_words", [(3, 1 << 23, 1 << 21), (4, 300, 500), (5, 40, 1)])
def test_frequencies_for_any_division(spark, seed, range_bytes, shard_words, monkeypatch):
    rows = corpus(seed)
    docs = documents(spark, [(i, t, lang, "web") for i, (lang, t) in enumerate(rows)]).repartition(3)
    got = {(r["lang"], r["phrase"]): (r["f"], *r["lefts"]) for r in collocations.frequencies(docs, least=3, range_bytes=range_bytes, shard_words=shard_words).where("level > 0").collect()}
    want = {}
    counts = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts.update((lang or ("und" if lang is None else ""), *words[i : i + k]) for i in range(len(words) - k + 1))
    for (lang, *p), f in counts.items():
        if f >= 3:
            want[lang, " ".join(p)] = (f, *(counts[lang, *p[:k]] for k in range(1, len(p))))
    assert got == want


@pytest.mark.parametrize("seed,top", [(7, 2000), (8, 5)])
def test_collocations(spark, seed, top):
    rows = [(lang, t) for lang, t in corpus(seed, 120) if lang != ""]
    docs = documents(spark, [(i, t, lang, "web") for i, (lang, t) in enumerate(rows)])
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=top).collect())
    assert got == plain(rows, top=top) and got


def test_products_beyond_64_bits(spark):
    big = 1 << 61
    nodes = spark.createDataFrame([("en", 1, "a", "", 3 * big, []), ("en", 1, "b", "", 3 * big + 1, []), ("en", 2, "a b", "b", big + 5, [3 * big])], collocations.NODES)
    row = collocations.scored(nodes).first()
    assert (row["score"], row["l"], row["r"]) == (2_000_000 * (big + 5) // (6 * big + 1), 3 * big, 3 * big + 1)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == plain(rows)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    one = documents(spark, [(1, "word " * 400, None, None)]).withColumn("n", F.lit("extra"))
    assert [tuple(r)[:3] for r in collocations.collocations(one).collect()] == [t[:3] for t in plain([(None, "word " * 400)])]


def test_hot_words_make_few_rows(spark):
    """What is shuffled for a word with a third of all places does not grow with its count."""
    docs = documents(spark, [(i, f"the {prose(i % 3, 4)} the of the") for i in range(3000)])
    assert collocations.frequencies(docs).where("level = 1 and phrase = 'the'").first()["f"] == 9000


def test_query_has_rows(spark, sf_dir):
    assert registry.op12_collocations(spark, sf_dir).count() > 0
