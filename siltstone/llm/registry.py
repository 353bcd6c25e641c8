"""The queries of this subpackage: one for each operator, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from siltstone.llm import bpe, collocations, embedding_dedup, fill_in_middle, fingerprints, language_id, mixing, near_join, recursive_bpe, substring_dedup, suffixes, token_counts, warc
from siltstone.llm.shared import new_folder


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    """A cache that starts empty, so every run does the same work."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_folder(spark, "token-cache"))


def op2_fingerprints(spark, sf_dir):
    """Fingerprints of every text and of its edited text; null texts count as empty, rows that repeat an id stay."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    """Every page written to archives and read back; null html is an empty payload."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark, sf_dir):
    """One row for each passage of 50 words or more that an earlier place has as well; null texts and null ids have none."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    """A language for every document; ``und`` for texts that are null or have no letter."""
    return language_id.language_ids(_table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    """Token ids of every text and what they decode to; null texts count as empty."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors; vectors without a label, a length or finite components link with nothing."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op8_mixing(spark, sf_dir):
    """How many words of each document the mix takes; a null source is a source of its own, the last."""
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    """As op4, by suffix arrays."""
    return suffixes.suffix_repeats(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    """Components of documents by sets of three-word shingles at 0.9; texts without words link with nothing."""
    return near_join.near_join(_table(spark, sf_dir, "documents"), 3, 90)


def op11_recursive_bpe(spark, sf_dir):
    """Ids of every text by ranks and what they decode to; null texts count as empty."""
    return recursive_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_collocations(spark, sf_dir):
    """The best 2000 phrases of each language; null texts count as empty, a null language as ``und``."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    """Every text with its middle moved to the end, and the text that this gives back; null texts count as empty."""
    return fill_in_middle.round_trip(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_fingerprints, op3_warc, op4_substring_dedup, op5_language_id, op6_bpe, op7_embedding_dedup, op8_mixing, op9_suffix_dedup, op10_ngram_join,
        op11_recursive_bpe, op12_collocations, op13_fill_in_middle,
    )
}

_REACHED = """, r AS (SELECT id, id AS reached FROM n UNION SELECT r.id, e.v FROM r JOIN e ON r.reached = e.u)
"""

OP7 = f"""
WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT vec_id AS id FROM embeddings){_REACHED},
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT c.id AS vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN k ON c.id = k.u
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
z AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.u, p.v FROM p JOIN z a ON p.u = a.doc_id JOIN z b ON p.v = b.doc_id WHERE 100 * p.shared >= 90 * (a.size + b.size - p.shared)),
n AS (SELECT doc_id AS id FROM documents){_REACHED},
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT c.id AS doc_id, coalesce(z.size, 0)::BIGINT AS n_shingles, c.component_id FROM c LEFT JOIN z ON c.id = z.doc_id
"""

ORACLES = {"op3_warc": warc.ORACLE, "op7_embedding_dedup": OP7, "op8_mixing": mixing.ORACLE, "op10_ngram_join": OP10, "op12_collocations": collocations.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
