import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import quality, queries
from parlance.llm.quality import FEATURES, PASSAGE, Attention, assess, features, train

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return Attention.new(rng.random((50, FEATURES)), 0.7)


def plain(model, text):
    """The score of a text, from the formulas, all passages at once."""
    rows = np.concatenate([features([text[i : i + PASSAGE]], [len(text)]) for i in range(0, max(1, len(text)), PASSAGE)])
    p = model.parts
    h = np.tanh(model.scaled(rows) @ p["encode"] + p["encode0"])
    e = (np.tanh(h @ p["tanh"] + p["tanh0"]) / (1 + np.exp(-(h @ p["gate"] + p["gate0"])))) @ p["weigh"]
    a = np.exp(e) / np.exp(e).sum()
    return float(1 / (1 + np.exp(-((a @ h) @ p["score"] + p["score0"][0])))), len(rows), int(a.argmax()), float(a.max())


def test_features_count_bytes_pairs_and_words():
    rows = features([b"", b"Ab ab ab 1!", b"x" * PASSAGE], [0, 11, PASSAGE + 2])
    assert rows.shape == (3, FEATURES) and not rows[0, :-1].any()
    assert np.isclose(rows[1, ord("b")] ** 2, 3 / 11) and np.isclose(rows[1, 32] ** 2, 3 / 11) and rows[1, 10] == 0
    assert np.allclose(rows[1, -6:], [4 / 11, 8 / 4, 2 / 4, 2 / 4, 11 / PASSAGE, np.log1p(11)])
    assert np.isclose((rows[1, 256 : FEATURES - 6] ** 2).sum(), 10 / 11)


def test_slopes_are_the_derivatives(model):
    rng = np.random.default_rng(8)
    x, starts, label, weight = rng.normal(size=(17, FEATURES)), np.array([0, 1, 6, 9]), np.array([1, 0, 0.5, 1.0]), np.array([1, 2, 1, 0.5])
    _, slope = model.slopes(x, starts, label, weight)
    for name, part in model.parts.items():
        for k in rng.integers(0, part.size, 5):
            was = part.flat[k]
            part.flat[k] = was + 1e-6
            up = model.slopes(x, starts, label, weight)[0]
            part.flat[k] = was - 1e-6
            down = model.slopes(x, starts, label, weight)[0]
            part.flat[k] = was
            assert np.isclose((up - down) / 2e-6, slope[name].flat[k], rtol=1e-3, atol=1e-7)


def test_scores_from_piece_to_piece(model, monkeypatch):
    texts = [b"", b"one two, three", b"The The " * 900, "Größe é | ".encode() * 3000, b"z" * 100_000]
    for passages in (2048, 3):
        monkeypatch.setattr(quality, "AT_A_TIME", passages)
        for got, text in zip(zip(*model.scores(texts), strict=True), texts, strict=True):
            assert np.allclose(got, plain(model, text), rtol=1e-9)


def test_held_out_accuracy(spark):
    """Above what the commoner label alone gives, for both labels, on documents it has not learned from."""
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op12_attention_quality(spark, sf_dir).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(found) == sorted(docs)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    told = [(r.quality, found[r.doc_id].predicted) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in found and found[r.doc_id].held_out]
    for label in (0, 1):
        own = [p == q for q, p in told if q == label]
        assert sum(own) >= 0.9 * len(own)


def test_held_out_labels_teach_nothing(spark):
    rows = [(k, "good words in a row " * (1 + k % 9) if k % 2 else "BAD!! BAD!! " * (1 + k % 7)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    right = spark.createDataFrame([(k, k % 2, 0) for k in range(120)], LABELS)
    turned = spark.createDataFrame([(k, (k + held(k)) % 2, 0) for k in range(120)], LABELS)
    scores = [{r.doc_id: r.score for r in assess(docs, labels).collect()} for labels in (right, turned)]
    assert scores[0] == scores[1]
    assert all((s >= 0.5) == bool(k % 2) for k, s in scores[0].items())


def test_odd_tables(spark):
    """Nulls, repeats, several labels, one label only, no label, no rows, an extra column of each name, a very long text."""
    two, four = [k for k in range(20, 40) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    rows = [(None, None), (None, "some text"), (1, ""), (two, "a b"), (two, "a b"), (3, "x" * 5_000_000), (four, "plain words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs
    for name in ("score", "label", "good", "rows", "_0", "_text", "held_out", "predicted", "passages", "weight", "quality"):
        wide = wide.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(two, 1, 0), (two, 0, 0), (two, 1, None), (four, 1, 0), (None, 1, 0), (1, None, 0), (77, 0, 0)], LABELS)
    found = assess(wide, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == two}) == 1
    assert len({r.score for r in found if r.doc_id in (None, 1)}) == 2  # the null text scores as the empty one
    none = assess(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all((r.score, r.predicted) == (0.5, 1) for r in none)
    assert assess(docs.limit(0), labels).count() == 0
    assert train(docs, labels.where("quality = 1")) is not None
