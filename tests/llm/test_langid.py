import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import langid
from parlance.llm.langid import ByteModel, drop_unidentified, has_letter, identify, train


class Plain:
    """The same model, context by context."""

    def __init__(self, texts, order, least):
        self.order, self.tree, self.least = order, defaultdict(Counter), least
        for t in texts:
            s = [-1] * order + list(t)
            for i in range(order, len(s)):
                for o in range(order + 1):
                    self.tree[tuple(s[i - o : i])][s[i]] += 1

    def bits(self, text, totals):
        s, out = [-1] * self.order + list(text), 0.0
        for i in range(self.order, len(s)):
            for o in range(self.order, -1, -1):
                ctx = tuple(s[i - o : i])
                if o == self.order and totals[ctx] < self.least:
                    continue
                seen = self.tree.get(ctx)
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    out += math.log2((n + q) / seen[s[i]])
                    break
                out += math.log2((n + q) / q)
            else:
                out += 8
        return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_against_plain_trees(order, monkeypatch):
    monkeypatch.setattr(langid, "PORTION", 7)
    samples = {"xx": [b"abracadabra abra", b"bar", b""], "yy": [b"the cat sat on the mat"], "aa": ["ünï ünd".encode()]}
    model = ByteModel(samples, order)
    plain = {k: Plain(v, order, langid.LEAST_CONTEXT) for k, v in samples.items()}
    totals = Counter()
    for p in plain.values():
        for ctx, seen in p.tree.items():
            totals[ctx] += sum(seen.values())
    texts = [b"abra cat", "zzz ü\x00 the the".encode(), b"a", b"bar bar sat on"]
    want = [[plain[k].bits(t, totals) for k in sorted(samples)] for t in texts]
    assert np.allclose(model.bits(texts), want, rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 250 < len(held) < 420
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_defined_results(spark, docs_of):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (6, "漢字", None), (None, "the dog", None), (7, "the dog", None), (7, "the dog", None)]
    docs = docs_of([*rows, *[(10 + i, "the cat and the dog sat", "en") for i in range(9)], *[(30 + i, "der Hund und die Katze", "de") for i in range(9)]]).selectExpr("*", "1 as score", "2 as h", "3 as place")
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(docs).collect()]
    by = dict((d, (p, s)) for d, p, s in got)
    assert by[3] == by[4] == by[5] == ("und", 0.0) and by[6][0] in ("de", "en") and by[7] == by[None] and by[7][0] == "en"
    assert [d for d, _, _ in got].count(7) == 2
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = drop_unidentified(docs.drop("score", "h", "place"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {3, 4, 5} & {r.doc_id for r in kept.collect()} == set() and kept.count() == len(rows) + 18 - 3


def test_letters_and_bounds(spark, docs_of):
    assert has_letter("1é".encode()) and has_letter(b"1a") and not has_letter("12 ²!".encode())
    docs = docs_of([(i, "word " * 50, "en") for i in range(50)])
    assert langid.training_sample(docs, docs=5).count() == 5
    assert train(docs, docs=5, size=600).languages == ["en"]
