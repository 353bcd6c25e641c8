"""The stages of the pipeline, each on its own input, against brute force."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import WORD, documents, jaccard_classes, prose


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    extra = [(10_001, None, "en", "web"), (10_002, "12 34 !!", "en", "web"), (10_003, rows[0]["text"], "en", "web")]
    before = docs.union(documents(spark, extra).select(docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, sf_dir), "stage")
        had, has = before.collect(), after.collect()
        if name != "bpe":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = Counter(r["doc_id"] for r in has)
        if name == "language_id":
            assert {10_001, 10_002} & set(ids) == set() and len(has) >= len(had) - 2 - 0.02 * len(had)
        elif name == "ngram_join":
            classes = jaccard_classes({r["doc_id"]: r["text"] for r in had}, 5, 80)
            assert set(ids) == set(classes.values()) and set(ids.values()) == {1}
        elif name == "substring_dedup":
            assert set(ids) == {r["doc_id"] for r in had}
            seen = Counter()
            for r in has:
                words = WORD.findall(r["text"] or "")
                assert r["n_chars"] == len(r["text"] or "")
                seen.update({tuple(words[i : i + 60]) for i in range(len(words) - 59)})
            assert not [w for w, n in seen.items() if n > 1]
        elif name == "mixing":
            assert set(ids) <= {r["doc_id"] for r in had} and max(ids.values()) <= 3
        else:
            model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(r["token_ids"] == model.encode(r["text"] or "", add_special_tokens=False).ids for r in has) and len(has) == len(had)
        before = after


def test_planted_copies_go_and_others_stay(spark):
    base = prose(50, 300).split()
    near = [*base[:150], "changed", *base[151:]]
    docs = documents(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), *((i, prose(i, 300)) for i in range(4, 10))])
    kept = {r["doc_id"] for r in corpus_pipeline.join_near(spark, docs, "").collect()}
    assert kept == {1, *range(4, 10)}
