import zlib

import pytest

from parlance.llm.sharding import shard_documents


def read(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_near_equal_bytes_and_gapless_slots(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = read(shard_documents(docs, shards=shards))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in text.items()}
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        mine = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= 3 * longest


def test_target_bytes(spark, docs_of):
    rows = read(shard_documents(docs_of([(i, "x" * 99) for i in range(64)]), shards=None, target_bytes=1600))
    assert {k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)} == dict.fromkeys(range(4), 1600)


def test_ties_copies_nulls_and_clashes(spark, docs_of):
    same = [(7, "same text") for _ in range(400)]
    docs = docs_of([*same, (None, None), (1, ""), (2, "é" * 5000)]).selectExpr("*", "1 as rid", "2 as size", "3 as shard", "4 as node", "5 as w")
    rows = read(shard_documents(docs, shards=8))
    assert len(rows) == 403
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] != 7} == {(None, 1, 0), (1, 1, 0), (2, 10001, zlib.crc32(("é" * 5000).encode()))}
    copies = [sum(1 for r in rows if r["shard"] == k and r["doc_id"] == 7) for k in range(8)]
    assert max(copies) < 150  # copies spread over the shards that the one huge text doesn't fill
    assert shard_documents(docs.limit(0)).count() == 0


def brute_shards(rows, shards):
    """Bytes by shard of a k-d tree that splits exactly at weighted medians of (value, tie)."""
    import math

    dims = [[(r[k] - min(x[k] for x in rows)) / ((max(x[k] for x in rows) - min(x[k] for x in rows)) or 1) for r in rows] for k in range(1, 5)]

    def split(mine, n):
        if n == 1:
            return [sum(rows[i][0] for i in mine)]
        wide = max(range(4), key=lambda k: max(dims[k][i] for i in mine) - min(dims[k][i] for i in mine))
        order = sorted(mine, key=lambda i: (dims[wide][i], i))
        want, so_far, cut = sum(rows[i][0] for i in mine) * (n // 2) / n, 0, 0
        for cut, i in enumerate(order, 1):
            so_far += rows[i][0]
            if so_far >= want:
                cut -= so_far - want > rows[i][0] / 2
                break
        return split(order[:cut], n // 2) + split(order[cut:], n - n // 2)

    return split(list(range(len(rows))), shards)


def test_against_exact_medians(spark, docs_of):
    """Rows whose dimensions have no ties: each shard has the bytes of a tree cut at exact medians, but for a median's own row."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), "x" * int(n)) for i, n in zip(rng.permutation(600) ** 2, rng.integers(50, 150, 600))]
    got = read(shard_documents(docs_of(rows), shards=8))
    of = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    want = brute_shards([(len(t) + 1, i, math.log(len(t) + 1), 0, 0) for i, t in rows], 8)
    assert all(abs(a - b) <= 2 * 151 for a, b in zip(of, want))
