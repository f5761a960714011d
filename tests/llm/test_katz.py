import math
import zlib
from collections import Counter, defaultdict

import pytest

from parlance.llm import katz
from parlance.llm.katz import good_turing, katz_scores
from parlance.llm.queries import op9_katz_backoff

ASCII = {c: c + 32 for c in range(65, 91)}


class Plain:
    """Katz backoff from dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            seq = ["<s>", *self.split(t)]
            self.words.update(seq[1:])
            self.pairs.update(zip(seq, seq[1:]))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1, self.d2 = (good_turing(Counter(c.values())) for c in (self.words, self.pairs))
        freed = sum(c - self.cut(c, self.d1) for c in self.words.values())
        self.scale, self.unseen = (1 / self.n, freed / self.n) if freed > 0 else (1 / (self.n + 1), 1 / (self.n + 1))
        self.after = defaultdict(dict)
        for (a, b), c in self.pairs.items():
            self.after[a][b] = self.cut(c, self.d2)

    @staticmethod
    def split(t):
        return [w.decode() for w in (t or "").translate(ASCII).encode().split()] + ["</s>"]

    @staticmethod
    def cut(c, d):
        return c * d[c - 1] if c <= 5 else c

    def own(self, w):
        return self.cut(self.words[w], self.d1) * self.scale if w in self.words else self.unseen

    def p(self, a, w):
        kept = self.after.get(a)
        if not kept:
            return self.own(w)
        total, mass = self.words["</s>" if a == "<s>" else a], sum(kept.values())
        total = total if mass < total - 1e-6 else total + 1
        if w in kept:
            return kept[w] / total
        return self.own(w) * (1 - mass / total) / (1 - sum(self.own(x) for x in kept))

    def score(self, t):
        seq = ["<s>", *self.split(t)]
        return sum(math.log10(self.p(a, b)) for a, b in zip(seq, seq[1:]))


@pytest.mark.parametrize("block", [12 << 20, 2_000])
def test_against_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    held = {i for i in text if zlib.crc32(str(i).encode()) % 7 == 2}
    model = Plain([t for i, t in text.items() if i not in held])
    rows = op9_katz_backoff(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        tokens = Plain.split(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(tokens), model.n)
        assert r.n_known == sum(w in model.words for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((model.words[w] + 1) / (model.n + model.v + 1)) for w in tokens))
        assert r.score == pytest.approx(model.score(text[r.doc_id]), rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    for a in ["<s>", "the", "of", next(iter(model.words))]:
        assert sum(model.p(a, w) for w in model.words) + model.p(a, "\0unseen") == pytest.approx(1)


def test_defined_results(spark):
    rows = [(1, "a b a b A B", True), (1, "a b a b A B", True), (2, None, True), (3, "", False), (None, "a zzz", False), (4, "é é x" * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").selectExpr("*", "1 as block", "2 as k1", "3 as score")
    model = Plain([t for _, t, x in rows if x])
    got = katz_scores(docs).collect()
    want = sorted((str(i), bool(x), len(Plain.split(t)), round(model.score(t), 6)) for i, t, x in rows)
    assert sorted((str(r.doc_id), r.train, r.n_tokens, round(r.score, 6)) for r in got) == want
    assert {r.score for r in katz_scores(docs.selectExpr("doc_id", "text", "false as train")).collect()} == {0.0}
    assert katz_scores(docs.limit(0)).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = [(1, "a b  c a b " * 30, True), (2, "b" * 500 + " a \n\n" + " " * 300 + "c b a", True), (3, " " * 400, False), (4, "c a b " * 50, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    model = Plain([t for _, t, x in rows if x])
    monkeypatch.setattr(katz, "PIECE_BYTES", 64)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 150)
    got = {r.doc_id: r for r in katz_scores(docs).collect()}
    assert len(got) == 4
    for i, t, _ in rows:
        assert got[i].n_tokens == len(Plain.split(t))
        assert got[i].score == pytest.approx(model.score(t))


def test_dealt_contexts(spark, monkeypatch):
    """Contexts that are dealt over partitions score as others do."""
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "of", *map(str, range(60))]) for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    model = Plain([t for i, t in enumerate(texts) if i % 5])
    plain = katz._answer_words
    monkeypatch.setattr(katz, "_answer_words", lambda often: plain(50))
    got = {r.doc_id: r for r in katz_scores(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(model.score(t))


def test_pack():
    import numpy as np

    arrays = [np.array([0, 255, 256, 1 << 63], np.uint64), np.zeros(0, np.uint64), np.array([7])]
    assert [x.tolist() for x in katz.unpack(katz.pack(*arrays))] == [x.tolist() for x in arrays]


def test_good_turing():
    assert good_turing({}) == [1.0] * 5
    d = good_turing({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 30})
    assert all(0 < x < 1 for x in d)
    assert good_turing({1: 3, 7: 2}) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
