"""Small tables and brute-force versions for the tests of the operators for training data."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text[, lang, source]) as a table of documents."""
    full = [(i, t, *(rest or ("en", "web")), None if t is None else len(t)) for i, t, *rest in rows]
    return spark.createDataFrame([r[:5] for r in full], DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = prose(1, 60_000)
    rows = [(1, "Some plain words that make a text of more than a few words, in English."), (1, "Some plain words that make a text of more than a few words, in English."), (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id"), (5, long), (6, long), (7, "word " * 400), (8, "x" * 100_000), (9, "é́ß \U0001f600 ﬁ 12 <|endoftext|> 'll     end"), (-3, "below zero"), (None, None)]
    docs = documents(spark, rows).union(documents(spark, [(10, "no language and no source", None, None)]))
    clash = ["digest", "at", "size", "family", "bucket", "key", "u", "v", "content", "target", "rate", "_id", "_row", "half", "first", "canon", "entry"]
    return docs.withColumns({c: F.lit(f"extra {c}") for c in clash})


def shingles(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def reached(ids, links):
    """The smallest id that each reaches."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return reached(ids, links)
