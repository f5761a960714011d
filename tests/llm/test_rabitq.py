import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import rabitq
from parlance.llm.queries import op4_rabitq_search
from parlance.llm.rabitq import nearest, rotation


def brute(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v in ok], float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, (i, _) in enumerate(ok):
        if i is not None and i % every == 0:
            s = (m[a] * m).sum(axis=1)
            order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[b], ok[b][0] is None, ok[b][0]))[:k]
            out.setdefault(i, []).append([(ok[b][0], s[b]) for b in order])
    return out


@pytest.mark.parametrize("rows", [2048, 7])
def test_recall_and_scores(spark, monkeypatch, rows):
    monkeypatch.setattr(rabitq, "QUERY_ROWS", rows)
    monkeypatch.setattr(rabitq, "CODE_ROWS", 128)
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, got = brute(data), {}
    for r in op4_rabitq_search(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    vectors = {i: np.array(v, float) for i, v in data}
    hit = 0
    for q, ranked in got.items():
        ranked = [ranked[k] for k in range(1, 6)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in ranked]
        for i, s in ranked:
            assert s == pytest.approx(vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i]), abs=1e-12)
        hit += len({i for i, _ in ranked} & {i for i, _ in want[q][0]})
    assert hit >= 0.98 * 5 * len(want)


def test_defined_results(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 2.0, 0.0]), (3, [1.0, 0.1, 0.0]), (2, [2.0, 0.2, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (100, [1.0]), (None, [0.0, 1.0, 0.0]), (50, [0.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as code", "2 as rid")
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = brute([r for r in rows if r[0] != 100])
    assert sorted(got) == [0, 50]
    for q, lists in want.items():
        flat = sorted((k + 1, i, round(s, 9)) for found in lists for k, (i, s) in enumerate(found))
        assert sorted(got[q], key=str) == sorted(flat, key=str)
    assert [i for _, i, _ in sorted(got[0])][:2] == [2, 3]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_rotation_is_orthogonal():
    r = rotation(17)
    assert np.allclose(r @ r.T, np.eye(17))
