from collections import Counter

import numpy as np
import pytest

from parlance.llm import decontam
from parlance.llm.decontam import RADIUS, ItemIndex, contaminated, drop_contaminated

ITEMS = "item_id long, text string"
ASCII = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return (text or "").translate(ASCII).encode().split()


def grams(words, n):
    n = min(n, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(docs, items, similarity=0.8):
    out = {}
    for doc_id, text in docs:
        w = words_of(text)
        for item_id, item in items:
            q = words_of(item)
            n = min(len(q), 5)
            if not q or len(w) < n:
                continue
            want, best = grams(q, n), (0, 0)
            for s in range(max(1, len(w) - len(q) + 1)):
                have = grams(w[s : s + len(q)], n)
                alike = sum((have & want).values()) / sum((have | want).values())
                if alike > best[0]:
                    best = (alike, s)
            if best[0] >= similarity:
                out[doc_id, item_id] = (best[1], round(best[0], 9))
    return out


def rand_words(rng, n, vocabulary=3000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_against_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rand_words(rng, int(n)))) for i, n in enumerate(rng.integers(3, 60, 25))]
    items += [(100, None), (101, " "), (102, items[3][1]), (103, "to be or not to be to be or not to be " * 2), (None, items[4][1])]
    docs = []
    for i in range(150):
        w = rand_words(rng, int(rng.integers(1, 200)))
        if i % 3 == 0:
            q = words_of(items[int(rng.integers(0, 25))][1])
            q = [x.decode().upper() if i % 2 else x.decode() for x in q]
            for _ in range(int(rng.integers(0, 3))):  # some are altered, so near the threshold on either side
                q[int(rng.integers(0, len(q)))] = "other"
            at = int(rng.integers(0, len(w)))
            w[at:at] = q[: len(q) - int(rng.integers(0, 4))]
        docs.append((i, " \n".join(w)))
    docs += [(200, None), (201, ""), (202, items[5][1]), (203, " ".join(words_of(items[6][1])[0].decode() for _ in range(300))), (204, "x " + items[103 - 101 + 25][1] if items[27][1] else "x")]
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in contaminated(docs_of(docs), spark.createDataFrame(items, ITEMS), 0.8).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in drop_contaminated(docs_of(docs), spark.createDataFrame(items, ITEMS)).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(6)
    index = ItemIndex([(i, " ".join(rand_words(rng, 30)).encode()) for i in range(300)], 0.8, 5)
    for _ in range(200):
        f = index.prints[rng.integers(0, 300)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)))
        assert index.within(f).tolist() == [k for k, p in enumerate(index.prints.tolist()) if (p ^ int(f)).bit_count() <= RADIUS]


def test_given_tables_and_edges(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts, probes = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    verbatim = {(d, i) for d, t in texts for i, q in probes if q in t}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert verbatim and verbatim <= got
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == len(texts)
    odd = docs_of([(1, "a b c d e f g h")] * 2).selectExpr("*", "1 as item_id", "2 as similarity")
    found = contaminated(odd, spark.createDataFrame([(9, "B C D E F G")] * 2, ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.start, r.words, r.similarity) for r in found] == [(1, 9, 1, 6, 1.0)] * 4


def test_long_texts_in_pieces(spark, docs_of, monkeypatch):
    import random

    from parlance.llm import decontam

    draw = random.Random(1)
    words = lambda n: " ".join(draw.choice("abcdefghijklmnop") + str(draw.randint(0, 400)) for _ in range(n))
    items = [(k, words(n)) for k, n in enumerate((12, 30, 7, 50))]
    rows = [(i, " ".join([words(draw.randint(0, 90)), items[i % 4][1], words(draw.randint(0, 90)), items[(i + 1) % 4][1]])) for i in range(20)] + [(20, items[2][1]), (21, words(3))]
    docs, bench = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "PIECE_WORDS", 16)
    assert sorted(tuple(r) for r in contaminated(docs, bench).collect()) == want and len(want) >= 41
