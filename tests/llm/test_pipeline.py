from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_on_the_given_tables(spark):
    """Each stage against what brute force says of its own input."""
    sf_dir, docs, rows = "/root/testdata/sf0.01", None, None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows or [r.asDict() for r in docs.collect()]
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == COLUMNS
        rows = [r.asDict() for r in docs.collect()]
        kept, was = {r["doc_id"]: r for r in rows}, {r["doc_id"]: r for r in before}
        assert len(kept) == len(rows) and set(kept) <= set(was)
        if name == "language":
            assert set(kept) == {i for i, r in was.items() if any(map(str.isalpha, r["text"] or ""))}
        elif name == "near_dedup":
            sets = {i: shingles(r["text"]) for i, r in was.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
            holders = {}
            for i, s in sets.items():
                for g in s:
                    holders.setdefault(g, []).append(i)
            pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
            near = {p: alike(*p) for p in pairs}
            for a, b in (p for p, s in near.items() if s >= 0.8):
                assert not (a in kept and b in kept)
            linked = {i for p, s in near.items() if s >= 0.8 for i in p}
            assert set(was) - set(kept) <= linked
        elif name == "substring_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != was[r["doc_id"]]["text"])
            long = Counter()
            for r in rows:
                w = r["text"].split()
                long.update({tuple(w[i : i + 60]) for i in range(len(w) - 59)})
            assert sum(n > 1 for n in long.values()) <= 0.02 * max(1, sum(len(r["text"].split()) >= 60 for r in rows))
            grams = Counter(g for r in before for g in {tuple(r["text"].split()[i : i + 12]) for i in range(max(0, len(r["text"].split()) - 11))})
            for r in rows:
                if r["text"] != was[r["doc_id"]]["text"]:
                    w = was[r["doc_id"]]["text"].split()
                    assert any(grams[tuple(w[i : i + 12])] > 1 for i in range(len(w) - 11))
        else:
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(was) - set(kept) >= {i for i, r in was.items() if any(q in r["text"] for q in items)}
            probes = set().union(*map(shingles, items))
            assert all(shingles(was[i]["text"]) & probes for i in set(was) - set(kept))
    packed = [r.asDict() for r in corpus_pipeline.packing(spark, docs, sf_dir).collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [1] for r in rows}
    got = {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * sum(map(len, want.values())) / 4096 + 1


def test_every_stage_takes_odd_and_empty_tables(spark, docs_of):
    sf_dir = "/root/testdata/sf0.001"
    docs = docs_of([(1, None), (2, ""), (3, "12"), (None, "the one text of all"), (4, "the one text of all"), (4, "the one text of all"), (5, "der andere Text", "de")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == COLUMNS and stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
    assert sorted(r.text for r in docs.collect()) == ["der andere Text", "the one text of all"]
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() == 2


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
