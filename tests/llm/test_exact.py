"""Operators against libraries, brute force and SQL."""

import hashlib
import os
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import documents, jaccard_classes, prose, reached, shingles
from siltstone.llm import bpe, components, embedding_dedup, fingerprints, language_id, mixing, near_join, registry, substring_dedup, suffixes, token_counts, warc
from siltstone.llm.shared import new_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("name", [*registry.ORACLES])
def test_queries_match_their_sql(compare, name):
    compare(registry.QUERIES[name], registry.ORACLES[name])


def test_token_counts_and_their_cache(spark, sf_dir):
    import sentencepiece

    docs, path, cache = table(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), new_folder(spark, "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {r["doc_id"]: len(model.encode(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path, cache).collect()} == want
    held = token_counts.read_cache(spark, cache).count()
    more = docs.union(documents(spark, [(-1, "a text that the cache lacks")]).select(docs.columns))
    assert len(token_counts.token_counts(more, path, cache).collect()) == len(want) + 1
    assert token_counts.read_cache(spark, cache).count() == held + 1
    other = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES, cache).collect()}
    assert other != want and token_counts.read_cache(spark, cache).count() > held + 1


def canonical(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(fold.split())


def edited(rows):
    """(doc_id, edited text) by the contract, of distinct ids."""
    rows = sorted(rows, reverse=True)
    out = {}
    for n, (i, text) in enumerate(rows):
        half = len(text) // 2
        out[i] = text[: len(text) - half] + rows[(n + 1) % len(rows)][1][:half]
    return out


@pytest.mark.parametrize("hashed", [fingerprints.wide_hash, lambda c: (c.substr(1, 1).cast("binary").cast("string").isNull().cast("long"), c.isNull().cast("long"))])
def test_fingerprints(spark, hashed):
    """The second hash puts all texts in one bucket: byte comparison must tell them apart."""
    texts = ["Straße  EINS", "STRASSE\neins ", "ﬁne", "fine", "É", "é", "", " ", "no", "yes, and more of it", "\U0001f600ab", "no"]
    rows = [(3 * i - 4, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents(spark, rows), hashed).collect()}
    want = edited(rows)
    for i, t in rows:
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        for j, u in rows:
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (canonical(t) == canonical(u)), (t, u)
        assert got[i]["near_edited"] == float(canonical(t) == canonical(want[i]))
    by_id = dict(rows)
    order = sorted(by_id, reverse=True)
    for n, i in enumerate(order):
        assert got[i]["near_next"] == float(canonical(by_id[i]) == canonical(by_id[order[(n + 1) % len(order)]]))


def test_neighbours_of_far_ids(spark):
    ids = sorted({0, 1, 2, 1023, 1024, 1 << 18, 1 << 40, (1 << 63) - 1, -1, -(1 << 62), -(1 << 63), 77_777_777})
    got = {r["doc_id"]: r["next_id"] for r in fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    assert got == {i: ids[n - 1] for n, i in enumerate(ids)}


def test_whole_query_of_fingerprints(spark, sf_dir):
    rows = [(r["doc_id"], r["text"] or "") for r in table(spark, sf_dir).collect()]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited(rows).items()}
    assert {r["doc_id"]: r["edited_sha256"] for r in registry.op2_fingerprints(spark, sf_dir).collect()} == want


def test_salvage_of_damaged_archives(spark, tmp_path):
    folder = str(tmp_path / "warc")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{prose(i, 80)}") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, folder)
    good = warc.read_archives(manifest, folder).orderBy("archive", "start").collect()
    assert len(good) == 40 and {r["kind"] for r in good} == {"record"}
    path = f"{folder}/{good[0]['archive']}"
    raw = bytearray(open(path, "rb").read())
    hit = [good[3], good[4], good[20]]
    for r in hit:
        raw[(r["start"] + r["end"]) // 2] ^= 255
    raw[good[30]["start"]] = 0
    raw = raw[: good[39]["start"] + 50]
    os.remove(path)
    with open(path, "wb") as f:
        f.write(raw)
    rows = warc.read_archives(manifest, folder).collect()
    lost = {r["page_id"] for r in [*hit, good[30], good[39]]}
    assert {r["page_id"] for r in rows if r["kind"] == "record"} == set(range(40)) - lost
    gaps = sorted((r["start"], r["end"]) for r in rows if r["kind"] == "gap")
    assert gaps == [(good[3]["start"], good[4]["end"]), (good[20]["start"], good[20]["end"]), (good[30]["start"], good[30]["end"]), (good[39]["start"], len(raw))]


def test_salvage_of_plain_records():
    import io

    records = [warc.record(i, "u", prose(i, 30).encode(), hashlib.sha256(prose(i, 30).encode()).hexdigest(), None) for i in range(3)]
    raw = records[0] + b"junk\r\n" + records[1] + records[2]
    rows = [*warc.salvaged(warc.Source(io.BytesIO(raw), len(raw)))]
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("record", 0), ("gap", None), ("record", 1), ("record", 2)]


PASSAGE = prose(900, 60)
COPIED = {1: prose(1, 200), 2: prose(2, 80) + " " + PASSAGE + " " + prose(3, 70), 3: PASSAGE.replace(" ", "\n"), 4: prose(4, 3) + " " + PASSAGE, 5: prose(5, 40) + " " + " ".join(PASSAGE.split()[:45]), 6: prose(6, 500)}


@pytest.mark.parametrize("find", [substring_dedup.repeated_passages, suffixes.suffix_repeats])
def test_repeated_passages_are_found_whole_and_no_others(spark, find):
    rows = find(documents(spark, [*COPIED.items()])).collect()
    assert {r["doc_id"] for r in rows} | {r["other_id"] for r in rows} == {2, 3, 4}
    for r in rows:
        here, there = COPIED[r["doc_id"]].encode()[r["span_start"] : r["span_end"]], COPIED[r["other_id"]].encode()[r["other_start"] : r["other_end"]]
        assert here.split() == there.split() == PASSAGE.encode().split() and r["n_words"] == 60


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
@pytest.mark.parametrize("find", [substring_dedup.repeated_passages, suffixes.suffix_repeats])
def test_planted_passages_at_random(spark, find, seed):
    import random

    rng = random.Random(seed)
    shared = [prose(seed + i, rng.randint(50, 120)) for i in range(4)]
    texts, homes = {}, {}
    for i in range(24):
        which = rng.sample(range(4), rng.randint(0, 2))
        texts[i] = " ".join([prose(seed + 100 + i, rng.randint(0, 90)), *(shared[k] + " " + prose(seed + 500 + 9 * i + k, rng.randint(1, 60)) for k in which)])
        for k in which:
            homes.setdefault(k, set()).add(i)
    named = set()
    for r in find(documents(spark, [*texts.items()])).collect():
        named |= {r["doc_id"], r["other_id"]}
    assert named == {i for h in homes.values() if len(h) > 1 for i in h}


def test_repeats_are_cut_but_for_the_first(spark):
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(documents(spark, [*COPIED.items(), (7, None)])).collect()}
    assert [out[i] for i in (1, 2, 5, 6, 7)] == [COPIED.get(i) for i in (1, 2, 5, 6, 7)]
    assert (out[3], out[4]) == ("", prose(4, 3))


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in language_id.language_ids(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    judged = [i for i, r in got.items() if r["held_out"] and truth[i] and r["lang_pred"] != "und"]
    assert len(judged) > 100 and sum(got[i]["lang_pred"] == truth[i] for i in judged) / len(judged) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_without_letters_or_labels(spark):
    docs = documents(spark, [(i, prose(i, 50), "xx", "s") for i in range(30)] + [(100, None, "xx", "s"), (101, "12 !? 7", "xx", "s")])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_ids(docs).collect()}
    assert (got[0], got[100], got[101]) == ("xx", "und", "und")
    assert {r["lang_pred"] for r in language_id.language_ids(documents(spark, [(1, "some text", None, "s")])).collect()} == {"und"}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_bpe_on_all_documents(spark, sf_dir, library):
    want = {}
    for r in table(spark, sf_dir).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = registry.op6_bpe(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeiou nrst'lv\n  ", max_size=80), st.text(alphabet="<|endoftxf>s ", max_size=60), st.sampled_from(["a<|endoftext|>b", "  <|endoftext|>  x", "a" * 3000, "ab" * 900, "  \x85　x", "'s't're", "İ ǅ ½ ²", "‍́"])))
def test_bpe_on_any_text(library, text):
    ours = bpe.vocabulary(BYTES)
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_near_vectors_reach_most_pairs(spark):
    """Against brute force on the whole table: at least 0.98 of the links, and none below the threshold."""
    import numpy as np

    rows = table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    links = 0
    for label in {r["label"] for r in rows}:
        x = np.array([r["embedding"] for r in rows if r["label"] == label], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links += int((x @ x.T >= 0.93).sum()) - len(x)
    got = sum(r["n_links"] for r in embedding_dedup.near_vectors(table(spark, "/root/testdata/sf0.01", "embeddings"), 0.93).collect())
    assert 0.98 * links <= got <= links


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", ("big", "mid", "small")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(600)] + [(1000, "one two", "en", None), (1001, None, "en", "empty")]
    docs = documents(spark, rows)
    got = mixing.mixture(docs).collect()
    by_source = {(r["target"], r["source_size"]): [x for x in got if (x["target"], x["source_size"]) == (r["target"], r["source_size"])] for r in got}
    for (target, _), members in by_source.items():
        assert target <= 3 * members[0]["source_size"]
        assert abs(sum(r["taken"] for r in members) - target) <= max(45, 0.02 * target)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(got) == sorted(mixing.mixture(docs).collect())
    out = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert {r["doc_id"]: r["taken"] for r in got if r["size"]} == {r["doc_id"]: out.count(r["doc_id"]) * r["size"] for r in got if r["size"]}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_join_against_all_pairs(spark, sf_dir, k, percent):
    docs = table(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = near_join.near_join(docs, k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == jaccard_classes(texts, k, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, k)) for i, t in texts.items()}


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
def test_near_join_at_the_threshold(spark, seed):
    import random

    rng, texts = random.Random(seed), {}
    for g in range(6):
        words = prose(seed + g, rng.choice([2, 3, 12, 40, 160, 400])).split()
        for _ in range(rng.randint(2, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                own[rng.randrange(len(own))] = prose(rng.random(), 1)
            texts[len(texts)] = " ".join(own)
    for k, percent in ((3, 90), (5, 80)):
        got = near_join.near_join(documents(spark, [*texts.items()]), k, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == jaccard_classes(texts, k, percent)


def test_words_that_a_polynomial_confuses_do_not_link(spark):
    """Thue-Morse words of 1,024 bytes have the same polynomial modulo 2**64 for every odd base."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    docs = documents(spark, [(i, " ".join([w] * 3 + [w + "c", w + "d"])) for i, w in enumerate((word, other))])
    assert {r["doc_id"]: r["component_id"] for r in near_join.near_join(docs, 3, 90).collect()} == {0: 0, 1: 1}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {i: c for i, c in reached({x for e in edges for x in e}, edges).items() if i in ends}
