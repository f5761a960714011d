import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import dense, lexical, rank
from parlance.operators.index import Index
from parlance.plans.search import build_indexes, index_delta, search


def fts_scores(docs, terms, op):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(raw, stemmed, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, raw, stemmed) VALUES (?, ?, ?)", docs)
    match = f" {op} ".join(f'"{t}"' for t in terms)
    return {i: -s for i, s in con.execute("SELECT rowid, bm25(f, 2.0, 1.0) FROM f WHERE f MATCH ?", (match,))}


def test_bm25_equals_fts5(spark):
    random.seed(2)
    words = ["open", "opening", "opened", "bank", "banks", "café", "42", "привет", "счета", "rare"]
    texts = {i: " ".join(random.choices(words, weights=[9, 5, 5, 3, 3, 2, 2, 2, 2, 1], k=random.randint(0, 30))) for i in range(1, 80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stemmed = {r.doc_id: " ".join(r.s) for r in df.select("doc_id", tx.stems(tx.tokens(F.col("text"))).alias("s")).collect()}
    docs = [(i, t, stemmed[i]) for i, t in texts.items()]
    for query in ("open rare", "opening banks", "cafe", "счетов привет", "missing"):
        terms = [x for t in tx.query_terms(query) for x in t.split("_")]
        got = {r.doc_id: (r.score, r.hits) for r in lexical.bm25(lexical.two_columns(df, "doc_id", "text"), terms, "doc_id").collect()}
        want = fts_scores(docs, terms, "OR")
        assert set(got) == set(want) and all(got[i][0] == pytest.approx(want[i]) for i in want)
        assert {i for i, (_, h) in got.items() if h == len(terms)} == set(fts_scores(docs, terms, "AND"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index in three segments: some documents replaced, some removed."""
    random.seed(2)
    words = ["open", "opening", "opened", "bank", "banks", "café", "Čapek", "42", "привет", "счета", "foo_bar", "foo", "bar", "rare", "ёлка"]
    texts = {i: " ".join(random.choices(words, k=random.randint(0, 30))) for i in range(1, 80)}
    index = Index(spark, str(tmp_path_factory.mktemp("index") / "docs"))
    df = lambda keep: spark.createDataFrame([(i, t) for i, t in texts.items() if keep(i)], "doc long, text string")
    index.add(df(lambda i: i <= 60).withColumn("text", F.when(F.col("doc") % 5 == 0, "old words").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "open gone")], "doc long, text string")))
    index.add(df(lambda i: i > 60))
    index.add(df(lambda i: i <= 60 and i % 5 == 0), spark.createDataFrame([(99,)], "doc long"))
    return index, texts


def test_stored_index_equals_fts5(spark, stored):
    index, texts = stored
    docs = [(i, t, " ".join(tx.stem_token(w) for w in tx.token_list(t))) for i, t in texts.items()]
    for query in ("open rare", "opening banks", "capek", "cafe", "счетов привет", "foo_bar", "foo_bar opened", "елка", "missing"):
        wanted = lexical.phrases(query)
        terms = [" ".join(p) for p in wanted]
        got = {r.doc: (r.score, r.hits) for r in index.scores(query).collect()}
        want = fts_scores(docs, terms, "OR")
        assert set(got) == set(want) and all(got[i][0] == pytest.approx(want[i]) for i in want), query
        both = fts_scores(docs, terms, "AND")
        assert {i for i, (_, h) in got.items() if h == len(terms)} == set(both)
        ranked = [r.doc for r in index.search(query, 10).orderBy("place").collect()]
        assert ranked == sorted(want, key=lambda i: (i not in both, -round(want[i], 12), i))[:10]
    assert index.search("?!", 5).count() == 0


def test_index_reads_only_its_terms(stored):
    plan = stored[0].postings(["open"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,open)" in plan


def test_index_is_repaired_and_compacted(spark, stored):
    index, texts = stored
    now = spark.createDataFrame([(i, t) for i, t in texts.items() if i != 3] + [(200, "rare news")], "doc long, text string")
    before = index.scores("rare").count()
    assert index.repair(now) and not index.repair(now)
    assert {r.doc for r in index.docs().collect()} == {i for i in texts if i != 3} | {200}
    n, mean = index.stats()
    index.compact()
    assert len(index.segments()) == 1 and index.stats() == (n, pytest.approx(mean)) and index.scores("rare").count() == before + 1 - ("rare" in texts[3].split())


def test_fusion_keeps_first_seen_on_ties(spark):
    lists = [[5, 3, 9], [3, 7], [7]]
    dfs = [spark.createDataFrame([(k, i) for i, k in enumerate(x, 1)], "unit_id long, place int") for x in lists]
    got = rank.rrf(dfs, "unit_id").orderBy(F.desc("score"), "first_list", "first_place").collect()
    want = {}
    for x in lists:
        for i, k in enumerate(x, 1):
            want[k] = want.get(k, 0) + 1 / (60 + i)
    assert [r.unit_id for r in got] == sorted(want, key=lambda k: -want[k]) and all(r.score == pytest.approx(want[r.unit_id]) for r in got)


def greedy(cands, threshold):
    kept = []
    for c in cands:
        if not any(k[1] == c[1] and c[2] and len(set(c[2]) & set(k[2])) / len(set(c[2])) >= threshold for k in kept):
            kept.append(c)
    return [c[0] for c in kept]


def test_overlap_is_greedy(spark):
    random.seed(3)
    cands = [(i, random.choice([1, 2]), random.sample(range(12), random.randint(0, 5))) for i in range(40)]
    df = spark.createDataFrame([(i, c, m, i + 1) for i, c, m in cands], "unit_id long, chat_id long, msg_ids array<long>, place int")
    for threshold in (0.5, 1.0, 1.1):
        assert sorted(r.unit_id for r in rank.dedup(df, threshold).collect()) == greedy(cands, threshold)


def test_snippets():
    lines = ["a" * 10, "b" * 10, "c" * 10, "d" * 10]
    assert rank.snippet_lines(lines, 1, 32) == [lines[1], lines[0], lines[2]]
    assert rank.snippet_lines(lines, 1, 21) == lines[1:3] and rank.snippet_lines(lines, 3, 32) == [lines[3], lines[1], lines[2]]
    assert rank.snippet_lines(["x", "y" * 50, "z"], 2, 10) == ["z"] and rank.snippet_lines(["y" * 10, "z"], 0, 10) == ["y" * 10]
    assert rank.snippet_lines(["y" * 50], 0, 10) == ["y" * 9 + "…"] and rank.snippet_lines([], 0) == []
    assert rank.best_line(["no", "open bank", "bank opened"], "opening banks") == 1 and rank.best_line(["a", "b"], None) == 0


def test_nearest(spark):
    rows = [(i, i % 3, i, [float(i % 5), 1.0, float(i % 2)]) for i in range(30)] + [(99, 0, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "unit_id long, chat_id long, date_start long, embedding array<float>")
    q = [1.0, 1.0, 0.0]

    def brute(keep):
        d = lambda v: 1 - sum(a * b for a, b in zip(v, q)) / (sum(a * a for a in v) ** 0.5 * 2**0.5)
        return [i for _, i in sorted((round(d(v), 6), i) for i, c, t, v in rows if any(v) and keep(c, t))]

    ids = lambda **k: [r.unit_id for r in dense.knn(df, q, 7, **k).withColumn("distance", F.round("distance", 6)).orderBy("distance", "unit_id").collect()]
    assert ids() == brute(lambda c, t: True)[:7]
    assert ids(chats=[1], since=5, until=20) == brute(lambda c, t: c == 1 and 5 <= t <= 20)[:7]
    assert ids(chats=[]) == [] and dense.knn(df, [0.0] * 3, 5).count() == 0
    far = dense.knn(df, q, 2, chats=list(range(2, 12)), lossy=True)
    assert set(r.unit_id for r in far.collect()) <= set(brute(lambda c, t: True)[:8])


def test_hashed_vectors_and_space():
    v = dense.hashed_vector("the residence permit 42 a")
    assert sum(x * x for x in v) == pytest.approx(1) and dense.hashed_vector("внж") == dense.hashed_vector("residence") and not any(dense.hashed_vector("7 b"))
    dense.check_space({}, "hashed")
    dense.check_space({"embed_model": "hashed", "embed_dim": "256"}, "hashed")
    with pytest.raises(ValueError):
        dense.check_space({"embed_model": "other", "embed_dim": "256"}, "hashed")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = {1: "[x] ann: opening a bank account", 2: "[x] bob: residence permit papers", 3: "[x] eve: weather", 4: "[x] ann: opening a bank account\n[x] bob: thanks"}
    units = spark.createDataFrame([(i, 1 if i < 4 else 2, None, "window", i * 10, i * 10, [i * 10], i * 100, i * 100, t, i) for i, t in texts.items()], "unit_id long, chat_id long, topic_id long, kind string, msg_id_start long, msg_id_end long, msg_ids array<long>, date_start long, date_end long, text string, reactions long")
    messages = units.select("chat_id", F.col("msg_id_start").alias("msg_id"), "topic_id", F.col("date_start").alias("date"), "text", F.lit(None).cast("string").alias("extracted"))
    return units, messages, units.select("unit_id", "chat_id", "date_start", dense.embed(F.col("text")).alias("embedding")), build_indexes(units, messages, str(tmp_path_factory.mktemp("indexes")))


def test_search(spark, corpus, monkeypatch):
    units, messages, vectors, indexes = corpus
    find = lambda *a, **k: search(units, messages, vectors, *a, indexes=indexes, **k)
    ids = lambda *a, **k: [r.unit_id for r in find(*a, **k)[0].orderBy("place").collect()]
    assert set(ids("opening banks")) == {1, 4} and ids("opening banks", chats=[2]) == [4] and ids("opening", until=150) == [1]
    assert ids("внж") == [2] and ids("внж", mode="lexical") == [] and ids("внж", mode="dense") == [2]
    assert ids("opening", chats=[]) == [] and ids("opening", k=1, chats=[1]) == [1]
    assert ids("opening", reach=spark.createDataFrame([(2,)], "chat_id long")) == [4]
    found, notes = search(units, messages, None, "opening", indexes=indexes)
    assert notes and found.count() == 2 and find("??")[1] and find("opening", reach=spark.createDataFrame([], "chat_id long"))[1]
    with pytest.raises(ValueError):
        find("x", mode="other")
    with pytest.raises(ValueError):
        find("opening", space={"embed_model": "other", "embed_dim": "9"})

    def down(*_):
        raise rank.RerankerUnavailable("no model")

    monkeypatch.setitem(rank.RERANKERS, "down", down)
    found, notes = find("opening", reranker="down")
    assert set(r.unit_id for r in found.collect()) == {1, 4} and any("reranker" in n for n in notes)


def test_anchors(spark, tmp_path):
    """A unit that only its own list found shows its message with the best of the words, else its first."""
    text = {10: "weather", 11: "opening", 12: "opening opening bank", 13: "other"}
    units = spark.createDataFrame([(1, 1, None, "thread", 10, 13, [13, 10, 11, 12], 0, 9, "\n".join(text[i] for i in (13, 10, 11, 12)), 0)], "unit_id long, chat_id long, topic_id long, kind string, msg_id_start long, msg_id_end long, msg_ids array<long>, date_start long, date_end long, text string, reactions long")
    messages = spark.createDataFrame([(1, i, None, i, t, None) for i, t in text.items()], "chat_id long, msg_id long, topic_id long, date long, text string, extracted string")
    found, _ = search(units, messages, None, "banks opening", indexes=build_indexes(units, messages, str(tmp_path)))
    assert [r.anchor for r in found.collect()] == [12]


def test_indexes_follow_units(spark, tmp_path):
    units = spark.createDataFrame([(1, "open"), (2, "bank")], "unit_id long, text string")
    messages = spark.createDataFrame([(1, 1, "open", None), (1, 2, "bank", None)], "chat_id long, msg_id long, text string, extracted string")
    indexes = build_indexes(units, messages, str(tmp_path))
    edited = spark.createDataFrame([(1, 1, "", None), (1, 3, "news", None)], messages.schema)
    index_delta(indexes, units.where("unit_id = 1"), spark.createDataFrame([(3, "open news")], "unit_id long, text string"), edited, messages.where("msg_id = 2"))
    found = lambda k, q: indexes[k].scores(q).count()
    assert [r.doc for r in indexes[0].scores("open").collect()] == [3] and found(0, "bank") == 1
    assert [found(1, q) for q in ("open", "bank", "news")] == [0, 0, 1] and indexes[1].stats()[0] == 1
