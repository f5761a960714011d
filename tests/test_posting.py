"""Postings are made in bounded batches, and are what a plain walk over each document gives."""

import pyarrow as pa

from parlance.functions import text as tx
from parlance.operators import index
from parlance.operators.lexical import index_tokens


def plain(doc, text):
    raw, stems = index_tokens(text), [t for w in tx.token_list(text) for t in index_tokens(tx.stem_token(w))]
    places = {}
    for side, terms in enumerate((raw, stems)):
        for at, term in enumerate(terms):
            places.setdefault(term, ([], []))[side].append(at)
    return [(None, doc, len(raw) + len(stems), None, None)] + [(t, doc, len(raw) + len(stems), *p) for t, p in places.items()]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc", "text"])


def test_post_is_what_a_plain_walk_gives():
    rows = [(1, "Running runs over the hill_top the"), (2, ""), (3, None), (-4, "ünï Ünï ﬁne don't"), (5, "___"), (6, "бегущий бежит the")]
    got = [tuple(r.values()) for b in index.post(iter([batch(rows[:2]), batch([]), batch(rows[2:])])) for r in b.to_pylist()]
    want = [p for r in rows for p in plain(*r)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_post_hands_over_no_more_than_some_rows_of_a_large_batch():
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(500))) for i in range(400)]
    made = list(index.post(iter([batch(rows)])))
    assert sum(b.num_rows for b in made) == 400 * 501  # a word is its own stem here
    assert max(b.num_rows for b in made) <= 10_000 and max(b.nbytes for b in made) < 4 << 20
