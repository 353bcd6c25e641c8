"""Phrase collocation mining with depth-limited count tries.

Every task counts the sequences of up to four words of its texts (a shard) in a trie, cuts the trie at borders of prefixes and serialises each range, sorted.
Ranges are shuffled, and the tries of a range are merged: that gives each sequence's frequency in the corpus. Walking down a merged trie passes the counts of
all beginnings of a phrase, its left parts; where a border cuts a trie, the beginnings of the border go with the range. Right parts follow suffix links:
a phrase without its first word is a node of another range, as frequent as the phrase at least, whose own right parts are the phrase's further ones. So
one join by the linked phrase a level gives all of them, among frequent nodes only.

Borders come from a sample of bounded size; they divide the work and change no result. Nothing is pruned before its frequency in the whole corpus is known.
Frequent first words are no hot spots: a shard sends a node once, whatever its count, and borders may be four words deep.

Null texts count as empty, a null language as ``und``. Rows that repeat are counted each. Languages without candidates have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import count_tries
from siltstone.llm.shared import slices, small_batches, text_or_empty, written

LONGEST, LEAST, SCALE, COVERS, TOP = 4, 30, 2_000_000, 80, 2000
SHARD_WORDS = 1 << 20  # words after which a task sends its trie and begins another
RANGE_BYTES, RANGES = 4 << 20, 1 << 15  # text for each range, and the most ranges
SAMPLE_BYTES, PER_RANGE = 64 << 20, 24  # text that borders are taken from, and sequences of it for each
MERGE_NODES = 1 << 21  # nodes that wait for a merge
SALTS = (256, 16, 1)  # the best phrases are found in so many parts of a language, then in fewer

NODES = "lang string, level int, phrase string, rest string, f long, lefts array<long>"


def _streams(batches: Iterator[pa.RecordBatch]):
    """Streams of words of (lang, text) batches, and the languages that their group numbers stand for so far."""
    names: dict[bytes, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b in slices(batch.column(1), 4 << 20):
            group = np.array([names.setdefault(x.encode(), len(names)) for x in langs[a:b]], np.int64)
            yield count_tries.stream(batch.column(1).slice(a, b - a), group), names


def _sampled(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, names in _streams(batches):
            names, words, piece = [*names], s.words, np.cumsum(s.opens)
            paths = []
            for i in range(step // 2, len(words), step):
                inner = [j for j in range(i, min(i + LONGEST, len(words))) if piece[j] == piece[i]]
                paths.append([names[s.group[i]], *(words[j].as_py() for j in inner)])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.binary()))], ["path"])

    return run


def borders(rows: DataFrame, ranges: int, total: int, seed: int = 1) -> list[tuple[bytes, ...]]:
    """``ranges`` - 1 sequences at most that divide the sequences of a sample of the rows (lang, text) evenly."""
    if ranges < 2:
        return []
    step = max(1, int(min(total, SAMPLE_BYTES) // (8 * ranges * PER_RANGE)))
    sample = rows.sample(min(1.0, SAMPLE_BYTES / total), seed) if total > SAMPLE_BYTES else rows
    paths = sorted(tuple(map(bytes, r["path"])) for r in sample.mapInArrow(_sampled(step), "path array<binary>").toLocalIterator())
    picked = [paths[len(paths) * i // ranges] for i in range(1, ranges)] if paths else []
    return [b for a, b in zip([None, *picked], picked, strict=False) if a != b]


def _shards(cuts, longest: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, names = [], 0, {}

        def sent():
            trie = count_tries.build(parts, [*names], longest)
            found = [*count_tries.Preorder(trie).ranges(cuts.value)] if trie.nodes() else []
            for i in range(0, len(found), 256):
                number, blob, beginnings = zip(*found[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blob, pa.binary()), pa.array(beginnings, pa.int32())], ["range", "blob", "beginnings"])

        for s, names in _streams(batches):  # noqa: B007
            if held and held + len(s.words) > shard_words:
                yield from sent()
                parts, held = [], 0
            parts, held = [*parts, s], held + len(s.words)
        if held:
            yield from sent()

    return run


def _merge(longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(tries):
            rows = [*count_tries.walked(count_tries.merged(tries), least)]
            for i in range(0, len(rows), 10_000):
                some = rows[i : i + 10_000]
                text = lambda words: b" ".join(words).decode()
                columns = [[p[0].decode() for _, p, _ in some], [k for k, _, _ in some], [text(p[1:]) for _, p, _ in some], [text(p[2:]) for _, p, _ in some], [c[-1] for *_, c in some], [c[1:-1] for *_, c in some]]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "level", "phrase", "rest", "f", "lefts"])

        now, held, waiting = None, [], 0
        for batch in batches:
            for number, blob, beginnings in zip(*(batch.column(c).to_pylist() for c in ("range", "blob", "beginnings")), strict=True):
                if number != now and held:
                    yield from frequent(held)
                    held, waiting = [], 0
                now = number
                trie = count_tries.restored(blob, beginnings, longest)
                held, waiting = [*held, trie], waiting + trie.nodes()
                if waiting > max(MERGE_NODES, held[0].nodes()):
                    held, waiting = [count_tries.merged(held)], 0
        if held:
            yield from frequent(held)

    return run


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (lang, text) to (lang, level, phrase, rest, f, lefts): sequences of up to ``longest`` words with their frequencies.

    rest is the phrase without its first word, lefts the frequencies of its shorter beginnings. Sequences rarer than ``least`` have no row; level 0 has
    for each language the number of its words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, min(RANGES, -(-total // range_bytes)))
    cuts = spark.sparkContext.broadcast(borders(rows, ranges, total))
    blobs = rows.mapInArrow(_shards(cuts, longest, shard_words), "range int, blob binary, beginnings int")
    return blobs.repartition(F.col("range")).sortWithinPartitions("range").mapInArrow(_merge(longest, least), NODES)


def scored(nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Frequent nodes to candidates (lang, words, phrase, a, l, r, score): the cut with the lowest score, of equals the first."""
    known = nodes.where("level = 1").select("lang", "phrase", "f", F.array().cast("array<long>").alias("rights"))
    found = []
    for k in range(2, longest + 1):
        # the suffix link: what is left of a phrase is a node of the level below, whose right parts are the further ones
        link = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.concat(F.array("f"), "rights").alias("rights"))
        here = nodes.where(F.col("level") == k)
        known = here.join(link, (here["lang"] == link["_lang"]) & (here["rest"] == link["_phrase"])).select("lang", "phrase", "f", "rights", "lefts")
        found.append(known.withColumn("words", F.lit(k)))
        known = known.drop("lefts")
    wide = lambda x: x.cast("decimal(19,0)")
    # whole numbers all the way: decimals of 29 digits over sums of 20, and a division that drops the rest
    score = lambda a, x, y: F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(a), wide(x) + wide(y))
    cut = F.array_min(F.transform(F.arrays_zip("lefts", "rights"), lambda c, k: F.struct(score(F.col("f"), c["lefts"], c["rights"]).alias("score"), k.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r"))))
    rows = reduce(DataFrame.unionByName, found).withColumn("cut", cut)
    return rows.select("lang", "words", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def _inner(longest: int) -> Column:
    """The phrases of two words or more that stand inside a phrase."""
    words = F.split("phrase", " ")
    every = [F.when(F.col("words") >= i + k, F.concat_ws(" ", F.slice(words, i + 1, k))) for k in range(2, longest) for i in range(longest - k + 1)]
    return F.array_except(F.array_compact(F.array(*every)), F.array("phrase"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covers: int = COVERS, top: int = TOP) -> DataFrame:
    """``docs`` (lang, text) to (lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase goes if a longer candidate that holds it has ``covers`` percent of its frequency or more.
    """
    nodes = written(frequencies(docs, longest, least), "frequent")
    candidates = written(scored(nodes, longest), "candidates")
    longer = candidates.where("words > 2").select("lang", "a", F.explode(_inner(longest)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = candidates.join(longer.withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"}), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    best = free.where(F.col("most").isNull() | (100 * wide("most") < covers * wide("a"))).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in SALTS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    sizes = nodes.where("level = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return best.join(sizes, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same in DuckDB's SQL, over all sequences.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score, i
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:c.k], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
v AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, k, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL),
b AS (SELECT m.* FROM m LEFT JOIN v ON m.lang = v.lang AND m.phrase = v.phrase WHERE v.most IS NULL OR 100 * v.most < 80 * m.a),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM b JOIN n ON b.lang = n.lang QUALIFY rank <= 2000
"""
