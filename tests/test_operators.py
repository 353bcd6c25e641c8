"""Operators that SQL does not express, and edge cases."""

from difflib import SequenceMatcher

from siltstone.operators import changes, graph, grounding, layout, parsing, references, retrieval
from siltstone.functions import text as T
from pyspark.sql import functions as F


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tokens_are_lower_cased_after_matching(spark):
    df = spark.createDataFrame([("Ab-9 İx 漢字 é",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["ab", "9", "x", "漢字"], []]
    assert T.query_tokens("Ab-9 İx 漢字 é") == ["ab", "9", "x", "漢字"]


def test_language_guess(spark):
    df = spark.createDataFrame([("plain",), ("éàü",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.guessed_language(F.col("t"))).collect()] == ["en", "other", "unknown", "unknown"]


def test_html(spark):
    df = spark.createDataFrame([("<p>a&amp;lt;</p><script>x</script><div> b<br>c </div>",)], "h string")
    assert df.select(T.html_to_text(F.col("h"))).first()[0] == "a&lt;\nb\nc"


def test_term_counts_twice_at_most(spark):
    docs = spark.createDataFrame([("s", "tax tax tax law", "x")], "source_id string, title string, path string")
    got = retrieval.lexical(docs, ["source_id"], {"title": 5.0, "path": 1.5}, {"q": "Tax law law"})
    assert rows(got, "query_id", "source_id", "lexical") == [("q", "s", 15.0)]


def test_propagation_follows_the_order_of_origins(spark):
    scores = spark.createDataFrame([("q", "a", 10.0), ("q", "b", 4.0)], "query_id string, source_id string, total double")
    edges = spark.createDataFrame([("a", "b", "q", "high"), ("a", "b", "r", "low"), ("b", "c", "r", "medium")], "source_id string, related_source_id string, relation_type string, strength string")
    got = {r["source_id"]: r["total"] for r in graph.in_order(scores, edges, ["relation_type"]).collect()}
    b = 4.0 + 10 * 0.15 * 1.5  # a passes on first
    assert abs(got["b"] - b) < 1e-9 and abs(got["c"] - b * 0.15 * 0.8) < 1e-9 and abs(got["a"] - (10 + b * 0.15 * 1.5)) < 1e-9


def test_propagation_against_a_walk_in_order(spark):
    import random

    rng = random.Random(4)
    ids = [f"s{i:02d}" for i in range(30)]
    given = {i: round(rng.uniform(0.5, 20), 3) for i in ids[:22]}
    links = [(rng.choice(ids), rng.choice(ids), f"r{n}", rng.choice(["high", "medium", "low"])) for n in range(80)]
    totals, weight = dict(given), {"high": 1.5, "medium": 0.8, "low": 0.5}
    first = {}
    for a, b, n, w in sorted(links, key=lambda e: e[2]):
        first.setdefault((a, b), weight[w])
        first.setdefault((b, a), weight[w])
    for origin in sorted(given, key=lambda i: (-given[i], i)):
        live = totals[origin]
        for (a, b), w in first.items():
            if a == origin:
                totals[b] = totals.get(b, 0.0) + live * 0.15 * w
    scores = spark.createDataFrame([("q", i, t) for i, t in given.items()], "query_id string, source_id string, total double")
    edges = spark.createDataFrame(links, "source_id string, related_source_id string, relation_type string, strength string")
    got = {r["source_id"]: r["total"] for r in graph.in_order(scores, edges, ["relation_type"]).collect()}
    assert set(got) == set(totals) and all(abs(got[i] - totals[i]) < 1e-9 for i in totals)


def test_segments_fit_their_budget():
    answer = "\n\n".join(f"Paragraph {i} says something. " * 3 for i in range(40))
    parts, before = grounding.segmented(answer)
    assert before == 40 and len(parts) == grounding.SEGMENTS_MOST and "".join(parts).count("Paragraph") == 120
    long, _ = grounding.segmented("x" * 2000 + " end. " + "Short one.")
    assert max(map(len, long)) <= grounding.SEGMENT_CHARS and grounding.segmented(" \n\n ") == ([], 0)


def test_likeness_of_names_is_the_sequence_matcher(spark):
    df = spark.createDataFrame([("report final", "final report"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(changes.name_likeness("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "report final", "final report").ratio(), 0.0]


def test_relocation_blocks_lose_no_pair(spark):
    sizes = [(f"n/report {i}.txt", "txt", int(100 * 1.013**i)) for i in range(60)]
    new = spark.createDataFrame(sizes, "current_path string, document_type string, file_size long")
    old = spark.createDataFrame([(f"o{i}", f"o/report {i}.txt", t, s) for i, (_, t, s) in enumerate(sizes)], "source_id string, current_path string, document_type string, file_size long")
    got = set(rows(changes.relocations(new, old), "current_path", "source_id"))
    want = set()
    for p, _, a in sizes:
        for j, (o, _, b) in enumerate(sizes):
            if min(a, b) / max(a, b) >= 0.9 and SequenceMatcher(None, p[2:-4], o[2:-4]).ratio() >= 0.65:
                want.add((p, f"o{j}"))
    assert got == want


def test_changes_of_every_class(spark):
    schema = "current_path string, fingerprint string"
    now = spark.createDataFrame([("same", "1"), ("edited", "2x"), ("moved", "3"), ("twin", "4"), ("new", "9")], schema)
    before = spark.createDataFrame([("i1", "same", "1"), ("i2", "edited", "2"), ("i3", "was", "3"), ("i4", "t1", "4"), ("i5", "t2", "4"), ("i6", "lost", "6")], "source_id string, current_path string, fingerprint string")
    got = dict(rows(changes.classified(now, before).where("change <> 'deleted'"), "current_path", "change"))
    assert got == {"same": "unchanged", "edited": "modified", "moved": "moved_or_renamed", "twin": "ambiguous", "new": "added"}
    assert rows(changes.classified(now, before).where("change = 'deleted'"), "source_id") == [("i4",), ("i5",), ("i6",)]


def test_clear_winner(spark):
    given = [("q", "a", 90.0, True), ("q", "b", 80.0, True), ("r", "a", 20.0, False), ("r", "b", 17.0, False), ("s", "a", 1.0, False), ("t", "a", 20.0, True), ("t", "b", 17.0, False), ("u", "a", 9.0, True), ("u", "b", 9.0, True), ("v", "a", 0.0, False)]
    df = spark.createDataFrame(given, "question_id string, source_id string, score double, exact boolean")
    assert rows(references.winners(df), "question_id", "status") == [("q", "exact"), ("r", "ambiguous"), ("s", "exact"), ("t", "exact"), ("u", "ambiguous"), ("v", "ambiguous")]


def test_aliases_as_phrases_and_by_words(spark):
    asked = spark.createDataFrame([("q", "what does the annual energy report say")], "question_id string, text string")
    known = spark.createDataFrame([("a", "Annual-Energy Report", "title"), ("b", "energy plan", "path"), ("c", "report", "path"), ("d", "xy", "title"), ("e", "annual gas grid price", "title"), ("f", "the", "title")], "source_id string, alias string, basis string")
    assert rows(references.alias_matches(asked, known), "source_id", "exact", "score") == [("a", True, 72.0), ("b", False, 45.0), ("c", True, 90.0), ("f", True, 72.0)]


def test_continuations_need_adjacent_pages(spark):
    df = spark.createDataFrame([("d", 1, "t"), ("d", 2, "t"), ("d", 4, "t")], "doc string, page int, kind string")
    assert rows(layout.continuations(df, "doc", "page", ["kind"]), "first_page", "pages") == [(1, 2)]


def test_links_of_every_kind(spark):
    df = spark.createDataFrame([(1, '<a href="#x"><a href="http://h/"><img src="../y"><a href=""><a href="z.html">')], "page_id long, html string")
    assert [r[0] for r in parsing.links(df).orderBy("place").select("kind").collect()] == ["anchor", "external", "outside", "missing", "local"]
