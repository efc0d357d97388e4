"""The network's gradients, its scoring of chunks, and held-out accuracy."""

import zlib

import numpy as np
import pytest
import samples
from conftest import SF_DIR

from pipekit.llm import quality_model as qm
from pipekit.llm.queries import QUERIES


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_chunks_cover_texts():
    texts = [b"", b"a", bytes(range(256)) * 5, b"z" * 256, b"y" * 257, b"x" * 448, b"w" * 449]
    parts, of = qm.chunks(*joined(texts))
    for i, text in enumerate(texts):
        own = parts[of == i]
        step = qm.CHUNK - qm.OVERLAP
        padded = text + bytes(qm.CHUNK)
        assert [bytes(c) for c in own] == [padded[j * step : j * step + qm.CHUNK].ljust(qm.CHUNK, b"\0")[: qm.CHUNK] for j in range(len(own))]
        assert (len(own) - 1) * step + qm.CHUNK >= len(text)


def plain_score(network, text):
    step, pooled = qm.CHUNK - qm.OVERLAP, []
    for start in range(0, max(1, len(text) - qm.OVERLAP), step):
        chunk = text[start : start + qm.CHUNK].ljust(qm.CHUNK, b"\0")
        vectors = network.vectors[list(chunk)]
        places = [vectors[i : i + qm.TAPS].ravel() @ network.filters + network.shift for i in range(0, qm.CHUNK - qm.TAPS + 1, qm.STRIDE)]
        pooled.append(np.maximum(np.max(places, axis=0), 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(features @ network.weights + network.bias[0])))


def test_scores():
    texts = [(t or "").encode() for t in samples.documents(n=10)]
    network = qm.Network.random()
    want = [plain_score(network, t) for t in texts]
    assert network.scores(*joined(texts)) == pytest.approx(want, abs=1e-4)


def test_gradients():
    texts, labels = [b"hello there " * 40, b"x#y" * 7, b"lorem"], np.array([1, 0, 1], np.float32)
    network = qm.Network.random()
    for name in ("vectors", "filters", "shift", "weights", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    parts, of = qm.chunks(*joined(texts))

    def loss():
        p = network.scores(*joined(texts))
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    found = network.gradients(parts, of, labels)
    rng = np.random.default_rng(0)
    for parameter, gradient in zip((network.vectors, network.filters, network.shift, network.weights, network.bias), found):
        largest = np.argsort(-np.abs(gradient.ravel()))[:5]
        for i in [*largest, *rng.integers(0, parameter.size, 3)]:
            at = np.unravel_index(i, parameter.shape)
            before = parameter[at]
            parameter[at] = before + 1e-6
            up = loss()
            parameter[at] = before - 1e-6
            down = loss()
            parameter[at] = before
            assert gradient[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in QUERIES["op6_quality_model"](spark, SF_DIR.replace("0.001", "0.01")).collect()}
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.values())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    held = [(found[r.doc_id].predicted, r.quality) for r in labels if found[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert min(a for a, b in held if b == 1) == 1


def test_odd_rows(spark):
    df = samples.frame(spark, [None, "", "good " * 30, "b#d " * 30])
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in qm.score(df, qm.train(df, labels, "doc_id", "text", "quality")).collect()}
    assert len(scores) == 5 and scores[0] == scores[1]
    assert qm.train(df, labels.limit(0), "doc_id", "text", "quality") is None
    assert {r.score for r in qm.score(df, None).collect()} == {0.5}
    assert qm.score(df.limit(0), qm.Network.random()).count() == 0
