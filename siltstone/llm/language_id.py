"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A window of 256 bytes is embedded byte by byte, convolved with filters of 2, 3 and 4 bytes, rectified and max-pooled over the window; a linear layer and softmax give
a probability for each language. A text is cut into windows over its whole length (the last one is filled up with zeros). Its score for a
language is the mean over windows of the log probability, by the bytes that the window holds; the highest wins.

Training reads a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language, chosen by a hash of the id, and ``PER_DOCUMENT`` windows of
each, spread evenly over its text. Everything else covers all rows. Text that is null or has no letter is ``und`` with score 0.
Without labelled documents, everything is ``und``. Only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import buffers, slices, small_batches

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 10
PER_LANGUAGE, PER_DOCUMENT, EPOCHS, BATCH = 600, 4, 12, 64
MINI = 32  # windows that go through the network at once: few enough for the cache


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.weights["shift"] = np.zeros(len(languages), np.float32)

    def forward(self, windows: np.ndarray, keep: bool = False):
        """Log probabilities of the languages for rows of bytes; with ``keep`` also what the backward pass needs."""
        x = self.weights["embed"][windows]
        n, flat, pooled, kept = len(windows), x.reshape(len(windows), -1), [], []
        for w in WIDTHS:
            steps = WINDOW - w + 1
            view = np.lib.stride_tricks.as_strided(flat, (n, steps, w * EMBED), (flat.strides[0], EMBED * flat.strides[1], flat.strides[1]))
            raw = np.ascontiguousarray(view).reshape(n * steps, -1) @ self.weights[f"filter{w}"]
            raw = raw.reshape(n, steps, FILTERS)
            top = raw.max(1) + self.weights[f"bias{w}"]
            pooled.append(np.maximum(top, 0))
            if keep:
                at = raw.argmax(1)
                kept.append((at, np.take_along_axis(view, at[:, :, None], 1), top > 0))
        hidden = np.concatenate(pooled, 1)
        raw = hidden @ self.weights["out"] + self.weights["shift"]
        raw -= raw.max(1, keepdims=True)
        logs = raw - np.log(np.exp(raw).sum(1, keepdims=True))
        return (logs, hidden, kept) if keep else logs

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        logs, hidden, kept = self.forward(windows, True)
        n = len(labels)
        error = np.exp(logs)
        error[np.arange(n), labels] -= 1
        error /= n
        grads = {"out": hidden.T @ error, "shift": error.sum(0), "embed": np.zeros_like(self.weights["embed"])}
        back = error @ self.weights["out"].T
        for i, (w, (at, patch, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * on  # n, FILTERS; only the winning step of a filter learns
            grads[f"bias{w}"] = g.sum(0)
            grads[f"filter{w}"] = np.einsum("nf,nfk->kf", g, patch)
            to_embed = (g[:, :, None] * self.weights[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            seen = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(grads["embed"], seen, to_embed)
        return grads

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam with a falling rate; classes count alike whatever their share."""
        rng = np.random.default_rng(seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2)), None, 0
        first, second = first
        groups = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        rounds = epochs * max(1, len(labels) // BATCH)
        for step in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
            rate = 0.01 * (1 - step / (rounds + 1))
            for k, g in self.gradients(windows[pick], labels[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all of each text, the text of each window, and the bytes that it holds."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][owner] + place * WINDOW
    held = np.minimum(offsets[1:][owner] - begin, WINDOW)
    at = begin[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < held[:, None], np.concatenate([data, [np.uint8(0)]])[np.minimum(at, len(data))], 0)
    return windows, owner, held


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            windows, owner, held = cut(*buffers(texts.slice(a, b - a)))
            chosen = []
            for d in range(b - a):
                own = np.flatnonzero(owner == d)
                own = own[(held[own] >= 64) | (len(own) == 1)]
                chosen.append(own[np.unique(np.linspace(0, len(own) - 1, PER_DOCUMENT).astype(int))] if len(own) else own)
            at = np.concatenate(chosen)
            rows = [bytes(x) for x in windows[at].astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(owner[at] + a)), pa.array(rows, pa.binary())], ["lang", "window"])


def trained(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network from rows (doc_id, text, lang) with a lang; None if there are none. Reruns give the same one."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = labelled.where(place < F.element_at(shares, F.col("lang"))).select("lang", "text").mapInArrow(_sampled, "lang string, window binary").collect()
    rows = sorted((r["lang"], bytes(r["window"])) for r in rows)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    network = Network(languages)
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    network.train(windows, np.array([languages.index(lang) for lang, _ in rows]))
    return network


def _predicted(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(network.languages, object)
        for batch in batches:
            ids, letters, texts = batch.column(0), batch.column(1), batch.column(2)
            for a, b in slices(texts, 1 << 19):
                windows, owner, held = cut(*buffers(texts.slice(a, b - a)))
                total = np.zeros((b - a, len(names)))
                for i in range(0, len(windows), MINI):
                    logs = network.forward(windows[i : i + MINI])
                    np.add.at(total, owner[i : i + MINI], logs * held[i : i + MINI, None])
                total /= np.maximum(np.bincount(owner, held, minlength=b - a), 1)[:, None]
                total = np.exp(total - total.max(1, keepdims=True))
                total /= total.sum(1, keepdims=True)
                has = letters.slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                best = total.argmax(1)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.where(has, names[best], "und"), pa.string()), pa.array(np.where(has, total[np.arange(b - a), best], 0.0))], ["key", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, network: Network | None, key: list[str]) -> DataFrame:
    """``docs`` to (the columns in ``key``, lang_pred, score), one row for each row."""
    small_batches(docs.sparkSession)
    if network is None:
        return docs.select(*key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    own = F.struct(*(docs[c].alias(f"_{i}") for i, c in enumerate(key)))
    rows = docs.select(own.alias("key"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(_predicted(network), f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*(F.col(f"key._{i}").alias(c) for i, c in enumerate(key)), "lang_pred", "score")


def held_out():
    """Documents that are never learned from: crc32(doc_id as text) mod 5 is 0. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 == 0


def language_ids(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) to (doc_id, held_out, lang_pred, score)."""
    network = trained(docs.where(~held_out()))
    return predicted(docs, network, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without the rows that have no letter or whose language is less likely than ``least``; columns stay."""
    network = trained(docs.where(~held_out()))
    return predicted(docs, network, docs.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)
