"""Ids that repeat with other texts, and headers with every separator: one row out for each row in, and nothing else touched."""

import io

from helpers import documents, prose
from siltstone.llm import fingerprints, near_join, substring_dedup, suffixes, warc

SEPARATORS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x00", "\x7f", "\x85", "\u2028", "\u2029"]


def test_urls_with_separators_and_long_urls(spark):
    urls = [f"http://h/a{s}b{s}WARC-Refers-To: <urn:page:5>{s}" for s in SEPARATORS] + ["http://h/" + "x" * 200_000, "http://h/é漢", ""]
    pages = spark.createDataFrame([(i, u, "<p>" + prose(i, 40)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = warc.round_trip(spark, pages).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [(i, "response", None) for i in range(len(urls))]


def test_long_headers_of_plain_records():
    raw = warc.record(1, "http://h/" + "y" * 300_000, b"body", "x", None).replace(b"WARC-Payload-Digest: sha256:x\r\n", b"")
    rows = [*warc.salvaged(warc.Source(io.BytesIO(raw + raw), 2 * len(raw)))]
    assert [(r["kind"], r["page_id"], len(r["url"])) for r in rows] == [("record", 1, 300_009)] * 2


def test_separators_in_headers_of_others():
    """A reader cuts header lines at line feeds alone."""
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: a\xe2\x80\xa8b\x1cc\xc2\x85\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (row,) = warc.salvaged(warc.Source(io.BytesIO(raw), len(raw)))
    assert (row["kind"], row["url"]) == ("record", "a\u2028b\x1cc\x85")


def test_a_text_is_not_cut_for_another_of_its_id(spark):
    shared, other = prose(1, 60), prose(2, 130)
    rows = [(1, f"{shared} {prose(3, 20)}"), (7, f"{shared} {prose(4, 5)}"), (7, other), (9, f"{other} end")]
    out = sorted((r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(documents(spark, rows)).collect())
    assert len(out) == 4 and out[0] == rows[0]
    # of the two texts of id 7 one stands behind all others: either it or the text of 9 keeps the passage
    assert sum(shared in t for _, t in out) == 1 and sum(other in t for _, t in out) == 1
    for find in (substring_dedup.repeated_passages, suffixes.suffix_repeats):
        pairs = {frozenset((r["doc_id"], r["other_id"])) for r in find(documents(spark, rows)).collect()}
        assert pairs == {frozenset((1, 7)), frozenset((7, 9))}


def test_repeated_ids_with_unlike_texts_lose_nothing(spark):
    rows = [(1, prose(1, 200)), (1, prose(2, 200)), (1, prose(2, 200)), (2, prose(3, 200))]
    out = sorted((r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(documents(spark, rows)).collect())
    assert out == sorted(rows)


def test_an_id_with_several_sets_is_one_vertex(spark):
    a, b, c, d = (prose(i, 80) for i in range(4))
    rows = [(1, a), (2, b), (7, a), (7, b), (7, c), (9, c), (11, d), (12, d), (13, prose(9, 30))]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_join.near_join(documents(spark, rows), 3, 90).collect())
    assert got == [(1, 1), (2, 1), (7, 1), (7, 1), (7, 1), (9, 1), (11, 11), (12, 11), (13, 13)]


def test_fingerprints_of_one_canonical_form(spark):
    rows = [(1, "Ab cd"), (1, "aB cd"), (1, "aB cd"), (2, "zz yy")]
    got = fingerprints.edited_fingerprints(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1 and len({r["edited_sha256"] for r in got if r["doc_id"] == 1}) == 2
