import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import packing
from parlance.llm.packing import nnls, pack, plan_packing, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def plain(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbB'sS \t\n\x0b\x1c\x85\xa0é́ßİΣ<|endoftext|>1².,#漢‍"), max_size=40), max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    got = list(token_ids(TOK, {}, [t.encode() for t in texts], 1))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    known, texts = {}, ["one two three four five", "two six one", "<|endoftext|> One"]
    for t in texts:
        assert np.frombuffer(next(token_ids(TOK, known, [t.encode()], 1)), "<u4").tolist() == plain(t)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50)), st.sampled_from([64, 70]))
def test_plan_places_every_piece_once(histogram, capacity):
    plan = plan_packing(histogram, capacity, classes=16)
    numbers, bins = {}, {}
    for length, first, count, sequence, offset in plan.runs:
        numbers.setdefault(length, []).extend(range(first, first + count))
        for s in range(sequence, sequence + count):
            bins.setdefault(s, []).append((offset, length))
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == plan.sequences
    total = sum(k * v for k, v in histogram.items())
    assert plan.sequences <= max(1, 2 * -(-total // capacity)) + 1


def test_nnls_finds_exact_counts():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (12, 30)).astype(float)
    x = np.where(rng.random(30) < 0.2, rng.integers(1, 9, 30), 0)
    fit = nnls(a, a @ x)
    assert (fit >= 0).all() and np.abs(a @ fit - a @ x).max() < 1e-6


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(lengths)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        seen = set()
        for i, b in enumerate(bins):
            if b + rest[0] <= capacity and b not in seen:
                seen.add(b)
                put(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]])
        put(rest[1:], [*bins, rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_near_the_fewest_sequences(lengths):
    assert plan_packing(Counter(lengths), 20, classes=20).sequences <= fewest(lengths, 20) + 1


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.5, 0.9, 20_000).astype(int), 1, 4096)
    plan = plan_packing(Counter(lengths.tolist()), 4096)
    assert plan.sequences <= 1.01 * lengths.sum() / 4096 + 1


@pytest.mark.parametrize("capacity,broadcast", [(16, 32 << 20), (4096, 32 << 20), (16, 0)])
def test_pack_reads_back(spark, docs_of, monkeypatch, capacity, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", broadcast)
    random.seed(0)
    rows = [(i, " ".join(random.choices(["The", "quick", "zebra's", "Ünïcode", "12", "don't"], k=random.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (201, ""), (None, "null id"), (202, "long " * 5000)]
    docs = docs_of(rows).selectExpr("*", "1 as part", "2 as length", "3 as ids").repartition(3)
    got = [r.asDict() for r in pack(docs, PATH, capacity).collect()]
    texts = Counter((d, tuple(plain(t))) for d, t in rows)
    back, open_ = Counter(), {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= capacity and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == r["piece"] * capacity
        open_.setdefault(r["doc_id"], []).append((r["piece"], ids))
    for d, parts in open_.items():
        if len({p for p, _ in parts}) == len(parts):
            back[d, tuple(x for _, ids in sorted(parts) for x in ids)] += 1
        else:
            for _, ids in parts:
                back[d, tuple(ids)] += 1
    assert back == texts
    for s in {r["sequence_id"] for r in got}:
        end = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    assert pack(docs.limit(0), PATH, capacity).count() == 0
