"""The network by plain loops and by finite differences, and which documents are held out."""

import zlib

import numpy as np

from helpers import documents
from siltstone.llm import language_id
from siltstone.llm.language_id import EMBED, FILTERS, WIDTHS, WINDOW, Network


def plain_forward(network, row):
    x = network.weights["embed"][row].astype(np.float64)
    pooled = []
    for w in WIDTHS:
        best = np.full(FILTERS, -np.inf)
        for i in range(WINDOW - w + 1):
            best = np.maximum(best, x[i : i + w].reshape(w * EMBED) @ network.weights[f"filter{w}"].astype(np.float64))
        pooled.append(np.maximum(best + network.weights[f"bias{w}"], 0))
    raw = np.concatenate(pooled) @ network.weights["out"].astype(np.float64) + network.weights["shift"]
    return raw - np.log(np.exp(raw - raw.max()).sum()) - raw.max()


def network_and_windows():
    rng = np.random.default_rng(3)
    network = Network(["de", "en", "fr"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    for w in WIDTHS:
        network.weights[f"bias{w}"] += rng.normal(0, 0.2, FILTERS)
    return network, rng.integers(0, 256, (4, WINDOW)), np.array([0, 1, 2, 1])


def test_forward_is_the_plain_loop():
    network, windows, _ = network_and_windows()
    np.testing.assert_allclose(network.forward(windows), [plain_forward(network, row) for row in windows], rtol=1e-9, atol=1e-9)


def test_gradients_are_differences():
    network, windows, labels = network_and_windows()
    loss = lambda: -network.forward(windows)[np.arange(len(labels)), labels].mean()
    grads, rng, step = network.gradients(windows, labels), np.random.default_rng(5), 1e-6
    for name, weight in network.weights.items():
        flat, grad = weight.reshape(-1), np.asarray(grads[name], np.float64).reshape(-1)
        seen = np.flatnonzero(grad) if name == "embed" else np.arange(len(flat))
        for i in rng.choice(seen, min(12, len(seen)), replace=False):
            was = flat[i]
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-5, (name, i)


def test_held_out_documents(spark):
    rows = [(i, f"some text of number {i} in a language") for i in [*range(40), -7, 10**15]]
    got = {r["doc_id"]: r["held_out"] for r in language_id.language_ids(documents(spark, rows)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows} and {*got.values()} == {True, False}
