"""Every operator on empty tables and on rows with nulls, long texts, ties, repeats and clashing columns."""

import public_tokenizers
import pytest

from helpers import DOCS, awkward
from siltstone.llm import bpe, embedding_dedup, fingerprints, language_id, mixing, near_join, substring_dedup, suffixes, token_counts, warc
from siltstone.llm.shared import new_folder

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ONE_ROW_EACH = {
    "token_counts": lambda d: token_counts.token_counts(d, PIECES, new_folder(d.sparkSession, "cache")),
    "fingerprints": fingerprints.fingerprints,
    "edited_fingerprints": fingerprints.edited_fingerprints,
    "language_ids": language_id.language_ids,
    "round_trip": lambda d: bpe.round_trip(d, BYTES),
    "encoded": lambda d: bpe.encoded(d, BYTES),
    "mixture": mixing.mixture,
    "near_join": near_join.near_join,
    "without_repeats": substring_dedup.without_repeats,
}
OTHERS = {"repeated_passages": substring_dedup.repeated_passages, "suffix_repeats": suffixes.suffix_repeats, "one_of_each": near_join.one_of_each, "mix": mixing.mix, "identified": language_id.identified}


@pytest.mark.parametrize("name", [*ONE_ROW_EACH, *OTHERS])
def test_empty_tables_give_no_rows(spark, name):
    assert (ONE_ROW_EACH | OTHERS)[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", [*ONE_ROW_EACH])
def test_awkward_rows_come_back_once_each(spark, name):
    docs = awkward(spark)
    want = sorted(str(r[0]) for r in docs.select("doc_id").collect())
    assert sorted(str(r["doc_id"]) for r in ONE_ROW_EACH[name](docs).collect()) == want


def test_filters_keep_the_columns_of_awkward_rows(spark):
    docs = awkward(spark)
    for keep in (near_join.one_of_each, mixing.mix, language_id.identified, substring_dedup.without_repeats):
        out = keep(docs)
        assert out.columns == docs.columns
        assert {r["canon"] for r in out.collect()} == {"extra canon"}


def test_awkward_repeats(spark):
    docs = awkward(spark)
    for find in (substring_dedup.repeated_passages, suffixes.suffix_repeats):
        rows = find(docs).collect()
        spans = sorted((r["span_start"], r["span_end"]) for r in rows if (r["doc_id"], r["other_id"]) == (6, 5))
        assert spans[0][0] == 0 and spans[-1][1] == docs.where("doc_id = 6").first()["n_chars"]
        assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))
        assert {r["doc_id"] for r in rows} <= {5, 6, 7}


def test_awkward_counts(spark):
    rows = ONE_ROW_EACH["token_counts"](awkward(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[2]["n_tokens"], by_id[3]["n_bytes"], by_id[5]["over_limit"], by_id[3]["over_limit"]) == (0, 0, True, False)


def test_pages_with_nulls(spark):
    schema = "page_id long, url string, html string, digest string"
    assert warc.round_trip(spark, spark.createDataFrame([], schema)).collect() == []
    long = "<p>" + "x" * 300_000
    rows = [(1, None, None, "d"), (2, "http://a/\r\nb", "", "d"), (3, "u", "é" * 60, "d"), (4, "u", "é" * 60, "d"), (4, "u", "é" * 60, "d"), (None, "u", "é" * 60, "d"), (None, None, None, None), (5, "u", long, "d"), (6, "u", "short", "d"), (7, "u", "short", "d")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    kinds = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None}
    assert kinds == {1: (0, "response", None), 2: (0, "response", None), 3: (120, "response", None), 4: (120, "revisit", 3), 5: (300_003, "response", None), 6: (5, "response", None), 7: (5, "response", None)}


def test_vectors_with_nulls(spark):
    schema = "vec_id long, embedding array<float>, label int, entry string, links string"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (None, [1.0, 0.0], 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()
    assert len(got) == len(rows)
    seen = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert [seen[i] for i in (1, 2, 3)] == [(2, 1, True), (2, 1, False), (2, 1, False)]
    assert all(seen[i] == (0, i, True) for i in range(4, 13))
    assert seen[None][0] == 0
