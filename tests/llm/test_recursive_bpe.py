"""BPE by recursive queries against the library, on all rows of a table and on random and awkward texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from helpers import DOCS, awkward, documents, prose
from siltstone.llm import recursive_bpe, registry

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op11_recursive_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest() == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def strange_texts():
    rng = random.Random(4)
    some = ["", " ", "\n\n  x", "x" * 3000, "ab" * 700 + "a", "=" * 999, " " * 500 + "end", "\U0001f600" * 40, "的魔ゼウス" * 60, "'ll 'LL don't", "<|endoftext|>", "\x00\x01\x02é́"]
    some += ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    some += ["".join(chr(rng.choice([rng.randint(1, 255), rng.randint(0x4E00, 0x4F00), rng.randint(0x1F600, 0x1F640), 32])) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return some


def test_strange_texts(library):
    bpe = recursive_bpe.vocabulary(RANKS, PATTERN)
    texts = strange_texts()
    got = [np.frombuffer(bpe.encoded(pieces), "<u4") for pieces in bpe.cut(texts)]
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in bpe.decoded(got)] == texts


def test_tokens_that_merging_does_not_reach(tmp_path):
    """A vocabulary whose ranks are in no order: the new token may meet one of lower rank, and whole pieces are taken as they are."""
    import tiktoken

    rng = random.Random(6)
    extra = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)})
    for seed in range(4):
        random.Random(seed).shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(extra)}
        path = tmp_path / f"ranks{seed}"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        bpe, own = recursive_bpe.RankedBpe(str(path), PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60))) for _ in range(150)]
        assert [np.frombuffer(bpe.encoded(p), "<u4").tolist() for p in bpe.cut(texts)] == [own.encode_ordinary(t) for t in texts]


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    rows = recursive_bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    back = recursive_bpe.decoded(recursive_bpe.encoded(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    for r in back.collect():
        assert r["token_ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")


def test_empty_and_null(spark):
    assert recursive_bpe.round_trip(spark.createDataFrame([], DOCS), RANKS, PATTERN).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert [bytes(r["decoded"]) for r in recursive_bpe.decoded(nulls, RANKS, PATTERN).collect()] == [b"", b""]
    many = documents(spark, [(i, prose(i, 50)) for i in range(50)])
    assert recursive_bpe.encoded(many.repartition(7), RANKS, PATTERN).count() == 50
