import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import divergence
from parlance.llm.divergence import differences, source_divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    """rows: (lang, source, text)."""
    docs = [(a or "", s or "", TERM.findall((t or "").translate(LOWER))) for a, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holds = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in holds.items() if n >= least)
        sources = {d[1] for d in own}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if holds[w] >= least) for s in sources}
        counts[None] = sum((counts[s] for s in sources), Counter())
        total = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (counts[s][w] + 5) // (total[s] + 5 * len(kept)) for w in kept} for s in counts}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            told = [(p[s][w] - p[None][w], w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", told, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(items[:most])]
    return sorted(out)


def got(docs, least):
    return sorted(tuple(r) for r in source_divergence(docs, least).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture
def mixed():
    rng, rows = np.random.default_rng(5), []
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeéß" for c in "klmn"]
    for k in range(400):
        n = int(rng.integers(0, 60))
        weights = rng.random(len(words)) ** (2 + k % 3)
        text = ", ".join(rng.choice(words, n, p=weights / weights.sum())) + " The ÉCOLE 1a2"
        rows.append((["en", "fr", None][k % 3], f"s{int(rng.integers(0, 7))}" if k % 11 else None, text if k % 13 else None))
    return rows + [("few", "x", "a b"), ("few", "y", "c"), ("one", None, "")]


@pytest.mark.parametrize("tile", [2, 128])
def test_against_brute_force(spark, mixed, tile, monkeypatch):
    """In tiles of two groups or one, and in blocks of 4 terms, common ones of 2, or as in production."""
    if tile == 2:
        plain, blocks = divergence.pair_values, divergence.blocks_of
        monkeypatch.setattr(divergence, "COMMON", 60)
        monkeypatch.setattr(divergence, "blocks_of", lambda kept: blocks(kept, 2, 1))
        monkeypatch.setattr(divergence, "pair_values", lambda kept, groups: plain(kept, groups, 2))
    docs = spark.createDataFrame(mixed, "lang string, source string, text string").repartition(5)
    assert got(docs, 10) == brute(mixed, 10)


def test_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs, 30) == brute([(r.lang, r.source, r.text) for r in docs.collect()], 30)


def test_products_in_tiles_of_rows(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 9, (5, 40)), rng.integers(0, 10**12, (3, 40))
    price = lambda rows, k: [{c: (c * 7919 + k) % 10**9 for c in np.unique(r).tolist()} for r in rows]
    p, q = price(left, 3), price(right, 5)
    want = [[sum(abs(p[i][int(a)] - q[j][int(b)]) for a, b in zip(left[i], right[j], strict=True)) for j in range(3)] for i in range(5)]
    for rows in (1, 20, 10_000):
        monkeypatch.setattr(divergence, "TILE_ROWS", rows)
        assert differences(left, right, p, q).tolist() == want


def test_long_texts_and_flushes(spark, monkeypatch):
    text = ("Wörter und ZAHLEN 12 " * 200_000) + "x" * 3_000_000 + " end"
    assert Counter(w for part in terms(text.encode()) for w in part) == Counter(w.encode() for w in TERM.findall(text.translate(LOWER)))
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 3)
    rows = [("de", f"s{k % 2}", "eins zwei drei " * k) for k in range(40)] + [("de", "s1", text)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(docs, 2) == brute(rows, 2)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None)] * 3 + [("", "", "a")] * 2, "lang string, source string, text string")
    assert got(docs.limit(0), 1) == [] and got(docs, 1) == []
    rows = [("a", "s", "x y"), ("a", "t", "x x")] * 2
    wide = spark.createDataFrame(rows, "lang string, source string, text string")
    for name in ("term", "n", "docs", "total", "kept", "counts", "item", "value", "rank", "number", "left", "i"):
        wide = wide.withColumn(name, F.lit(1))
    assert got(wide, 2) == brute(rows, 2)
