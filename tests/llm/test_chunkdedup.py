import numpy as np
import pytest

from parlance.llm import blocks, chunkdedup
from parlance.llm.chunkdedup import LEAST_CHUNK, cut_points, drop_repeats, gear, repeated_passages

RNG = np.random.default_rng(5)


def prose(n):
    return " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(2, 9))) for _ in range(n))


def test_gear_is_the_shifted_sum():
    raw = RNG.integers(0, 256, 60, dtype=np.uint8)
    for i, h in enumerate(gear(raw).tolist()):
        assert h == sum(int(chunkdedup._GEAR[raw[i - k]]) << k for k in range(min(16, i + 1))) % (1 << 32)


def test_cuts_cover_the_text_and_resist_shifts(monkeypatch):
    text = (prose(2000) + " " + "漢字" * 400 + " " + prose(50)).encode()
    cuts, words = cut_points(text)
    assert cuts[-1] == len(text) and (np.diff(cuts, prepend=0)[:-1] >= LEAST_CHUNK).all() and len(cuts) > 150
    assert text.decode() == "".join(text[a:b].decode() for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
    moved, _ = cut_points(b"inserted words here " + text)
    assert len({len(text) - c for c in cuts} & {len(text) + 20 - c for c in moved}) > 0.98 * len(cuts)
    monkeypatch.setattr(chunkdedup, "PIECE_BYTES", 100)
    again, count = cut_points(text)
    assert (again == cuts).all() and (count == words).all()


@pytest.mark.parametrize("block", [12 << 20, 3_000])
def test_planted_passages(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    passages = [prose(n) for n in (55, 60, 80, 120, 300)]
    rows, holds = [], {}
    for i in range(120):
        parts = [prose(int(RNG.integers(20, 150)))]
        if i % 3 == 0:
            p = passages[i // 3 % 5]
            holds[i] = p
            parts += [p, prose(int(RNG.integers(5, 60)))]
        rows.append((i, " ".join(parts)))
    docs = docs_of(rows).selectExpr("*", "1 as block", "2 as p")
    found = {}
    for r in repeated_passages(docs).collect():
        text = rows[r.doc_id][1]
        assert text[r.start : r.end].strip() in holds[r.doc_id] and holds[r.kept_doc_id] == holds[r.doc_id] and r.kept_doc_id < r.doc_id
        assert len(text[r.start : r.end].split()) == r.words
        found.setdefault(r.doc_id, []).append(r)
    firsts = {min(i for i in holds if holds[i] == p) for p in passages}
    assert set(found) <= set(holds) - firsts and len(found) >= 0.95 * (len(holds) - len(firsts))
    left = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert list(left[0].asDict()) == docs.columns and set(left) == set(range(120))
    for i, text in rows:
        gone = sum(r.end - r.start for r in found.get(i, []))
        assert len(left[i].text) == left[i].n_chars and (left[i].text == text) == (gone == 0)


def test_defined_results(spark, docs_of):
    text = prose(100)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "  "), (5, (prose(30) + "\n") * 5)]
    docs = docs_of(rows).coalesce(1)
    got = sorted((str(r.doc_id), r.start, r.end, r.kept_doc_id) for r in repeated_passages(docs).collect())
    assert got == [("1", 0, len(text), 1), ("None", 0, len(text), 1)]
    kept = drop_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", text), ("2", None), ("3", ""), ("4", "  "), ("5", rows[-1][1])], key=lambda x: x[0])
    assert repeated_passages(docs.limit(0)).count() == drop_repeats(docs.limit(0)).count() == 0


def brute_passages(rows):
    """(doc_id, start, end, words, keeper) from chunks and dictionaries, document by document in order of doc_id."""
    first, out = {}, []
    for i, text in sorted(rows):
        data = (text or "").encode()
        cuts, words = (x.tolist() for x in cut_points(data))
        starts = [0, *cuts[:-1]]
        chunks = [data[a:b].strip() for a, b in zip(starts, cuts)]
        windows = set()
        for a in range(len(chunks)):
            b = next((b for b in range(a + 1, len(chunks) + 1) if sum(words[a:b]) >= chunkdedup.LEAST_WORDS), None)
            if b:
                windows.add((a, b))
            c = next((c for c in range(a, -1, -1) if sum(words[c : a + 1]) >= chunkdedup.LEAST_WORDS), None)
            if c is not None:
                windows.add((c, a + 1))
        runs = []
        for a, b in sorted(windows):
            key = tuple(chunks[a:b])
            if first.setdefault(key, i) != i:
                if runs and a < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b, first[key]])
        for a, b, keeper in runs:
            out.append((i, len(data[: starts[a]].decode()), len(data[: cuts[b - 1]].decode()), sum(words[a:b]), keeper))
    return sorted(out)


@pytest.mark.parametrize("block", [12 << 20, 20_000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + k, "la " * 200 + prose(20) + " x" * k) for k in range(4)] + [(2000, rows[3][1]), (-5, rows[5][1])]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in repeated_passages(docs).select("doc_id", "start", "end", "words", "kept_doc_id").collect())
    assert got == brute_passages(rows) and len(got) > 10


def test_common_phrases_are_no_passage(spark, docs_of):
    text, rows = prose(100), []
    cuts = cut_points(text.encode())[0].tolist()
    for i, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):  # each chunk in another document
        other = prose(40)
        rows.append((i, other[: cut_points(other.encode())[0][2]] + " " * (a == 0) + text[a:b] + " " + prose(40)))
    rows.append((len(rows), text))
    docs = docs_of(rows).coalesce(1)
    assert repeated_passages(docs).count() == 0
    assert {r.doc_id: r.text for r in drop_repeats(docs).collect()} == dict(rows)
