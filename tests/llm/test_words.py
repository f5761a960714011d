"""Words that a polynomial hash confuses, and long texts and clashing columns, through every operator on words."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parlance.llm import common
from parlance.llm.chunkdedup import repeated_passages
from parlance.llm.common import distinct_words, hash_words
from parlance.llm.decontam import contaminated
from parlance.llm.katz import Table, katz_scores
from parlance.llm.packing import token_ids, tokenised
from parlance.llm.simhash import near_duplicates, simhash_components


def thue_morse(bits):
    """The Thue-Morse word of 2**bits letters, and that with the letters swapped."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


TWINS = [w for bits in (8, 10, 11, 12) for w in thue_morse(bits)]


def test_hashes_tell_words_apart():
    rng = np.random.default_rng(2)
    made = {bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(1, 200, 30_000).tolist()} | {w.encode() for w in TWINS} | {b"ab", b"ba", b"a" * 65, b"a" * 66}
    words = sorted(made)
    hashes, starts, ends = hash_words(b" ".join(words))
    assert len(set(hashes.tolist())) == len(words) == len(hashes)
    assert [b" ".join(words)[a:b] for a, b in zip(starts, ends, strict=True)] == words
    for at in (0, 70, 40_000):  # a hash depends on nothing but the word
        assert hash_words(b" " * at + words[7].upper() + b"\n")[0][0] == hash_words(words[7])[0][0]


def test_words_of_one_hash_are_compared(monkeypatch):
    line = b"one two six one ten  two"
    monkeypatch.setattr(common, "hash_words", lambda text: (np.array([5, 5, 5, 5, 5, 5], np.uint64), *hash_words(text)[1:]))
    words, of, _ = distinct_words(line)
    assert [words[k] for k in of] == line.split()
    monkeypatch.undo()
    words, of, _ = distinct_words(line)
    assert [words[k] for k in of] == line.split() and len(words) == 4


def test_tokens_of_such_words(spark, docs_of):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {w: np.array([*tok.encode(w, add_special_tokens=False).ids, 1], "<u4").tobytes() for w in TWINS}
    assert list(token_ids(tok, {}, [w.encode() for w in TWINS], 1)) == list(want.values())
    rows = tokenised(docs_of(list(enumerate(TWINS))), public_tokenizers.path("word_bpe_49k.json")).where("piece = 0").collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(want[w][: 4 * 4096]) for i, w in enumerate(TWINS)}


def test_counts_of_such_words(spark):
    rows = [(2 * i + k, w, k == 0) for i in range(4) for k, w in enumerate(TWINS[2 * i : 2 * i + 2])]
    found = katz_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()
    assert {r.doc_id: r.n_known for r in found} == {i: 2 - i % 2 for i, _, _ in rows}  # the end is known, and one twin of each two
    with pytest.raises(ValueError, match="no 64-bit key"):
        Table(1 << 32, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def test_matches_of_such_words(spark, docs_of):
    items = spark.createDataFrame([(i, " ".join([w] * 3 + ["one", "two", "three"] * 2)) for i, w in enumerate(TWINS[2:4])], "item_id long, text string")
    docs = docs_of([(i, r.text) for i, r in enumerate(items.orderBy("item_id").collect())])
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(0, 0), (1, 1)]
    apart = docs_of([(i, " ".join([w] * 9)) for i, w in enumerate(TWINS)]).select(F.col("doc_id").alias("rid"), "text")
    assert near_duplicates(apart, 0.8, 5).count() == 0


LONG = " ".join(f"w{k % 9973:x}{k % 31}" for k in range(700_000))  # some 4 MB


def test_very_long_texts(spark, docs_of):
    """Texts of megabytes, one of them a single word, are taken whole by each operator on words."""
    docs = docs_of([(1, LONG), (2, LONG + " end"), (3, "z" * 3_000_000), (4, "short")])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = tokenised(docs.where("doc_id <> 3"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = sum(len(tok.encode(w, add_special_tokens=False).ids) for w in LONG.split())
    assert {r.doc_id: r.n for r in pieces} == {1: n + 1, 2: n + 2, 4: 2}
    assert {r.doc_id for r in repeated_passages(docs).select("doc_id").collect()} == {2}
    assert sorted(map(tuple, near_duplicates(docs.select(F.col("doc_id").alias("rid"), "text"), 0.8, 5).collect())) == [(1, 1), (2, 1)]
    parts = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    assert parts[2] == 1 and parts[3] == 3


NAMES = ["rid", "score", "lang_pred", "bits_per_byte", "_text", "_0", "_1", "block", "size", "data", "digest", "fp", "sketch", "minima", "key", "label", "side", "kept_rid", "p", "answer", "kind", "item_id", "part", "place", "piece", "start", "length", "ids", "grams", "src", "dst", "first", "copies", "component", "h", "n", "train", "words"]


def test_every_stage_takes_columns_of_its_own_names(spark, docs_of):
    """Columns named as internal ones stay, and change no result."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs
    for name in NAMES:
        wide = wide.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
        assert more.columns == plain.columns + NAMES
        rows = more.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows[:50] for n in NAMES), name
        assert sorted((r.doc_id, r.text, r.lang) for r in rows) == sorted((r.doc_id, r.text, r.lang) for r in plain.collect())
    one, two = (sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.packing(spark, d, sf_dir).collect()) for d in (docs, wide))
    assert one == two
