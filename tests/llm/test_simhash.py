import numpy as np
import pytest
import xxhash

from parlance.llm import simhash
from parlance.llm.simhash import Forest, drop_near_duplicates, links, near_duplicates, simhash_components


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    group = {}
    for i in range(len(ids)):
        group.setdefault(root(i), []).append(ids[i])
    return {i: min(x for x in group[root(i)]) for i in range(len(ids))}


def test_components_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([d for d, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {d: (f - (f >> 63 << 64), want[i]) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))}


@pytest.mark.parametrize("shard_rows", [20_000, 5])
def test_links_lose_nothing(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                f ^= 1 << b
            fps.add(f)
    fps = sorted(f - (f >> 63 << 64) for f in fps)
    want = brute_components(fps, lambda i, j: ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3)
    edges = [(r.src, r.dst) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    linked = {frozenset(e) for e in edges}
    assert brute_components(fps, lambda i, j: frozenset((fps[i], fps[j])) in linked) == want


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(2)
    fp, shard = rng.integers(0, 1 << 12, 300, dtype=np.uint64), np.sort(rng.integers(0, 5, 300))
    keep = np.unique(np.stack([shard.astype(np.uint64), fp]), axis=1)
    shard, fp = keep[0].astype(np.int64), keep[1]
    got = {(i, j) for a, b, _ in Forest(fp, shard).neighbours(3) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(i) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}


def test_edges_of_the_contract(spark, docs_of):
    docs = docs_of([(5, None), (3, ""), (7, " \t"), (8, "One"), (2, "ONE"), (9, "a b"), (None, "a b"), (9, "a b")])
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert {(d, c) for d, f, c in got if f == 0} == {(5, 3), (3, 3), (7, 3)}
    assert {(d, c) for d, f, c in got if d in (8, 2)} == {(8, 2), (2, 2)}
    assert [c for d, f, c in got if d in (9, None)] == [9, 9, 9]
    assert simhash_components(docs.limit(0)).count() == 0


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 as fp", "2 as component", "3 as key", "4 as u")
    assert {r.component_id for r in simhash_components(docs).collect()} == {1}
    assert drop_near_duplicates(docs).columns == docs.columns


def jaccard(a, b, n=5):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("route_rows", [4_000, 3])
def test_near_duplicates_against_brute_force(spark, docs_of, monkeypatch, route_rows):
    monkeypatch.setattr(simhash, "ROUTE_ROWS", route_rows)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 300))]
        rows.append(" ".join(words))
        for _ in range(rng.integers(0, 4)):
            w = list(words)
            w[rng.integers(0, len(w))] = "changed"
            rows.append(" ".join(w))
        w = [x if rng.random() > 0.25 else "other" for x in words]
        rows.append(" ".join(w))
    rows += ["", None, "  "]
    docs = docs_of(list(enumerate(rows)))
    want = brute_components(list(range(len(rows))), lambda i, j: jaccard(rows[i], rows[j]) >= 0.8)
    kept = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    assert kept == {want[i] for i in range(len(rows))}
    assert near_duplicates(docs.limit(0).selectExpr("doc_id as rid", "text")).count() == 0


def test_repeated_lines_weigh_nothing(spark, docs_of):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(10):
        page = " ".join(f"w{x}" for x in rng.integers(0, 5000, 100))
        line = " ".join(f"l{x}" for x in rng.integers(0, 5000, 7))
        rows += [f"{page} {line}", " ".join([page, *[line] * 50])]
    assert all(jaccard(*rows[i : i + 2]) >= 0.9 for i in range(0, 20, 2))
    assert {r.doc_id for r in drop_near_duplicates(docs_of(list(enumerate(rows)))).collect()} == set(range(0, 20, 2))


def test_row_numbers_outlive_other_splits(spark, docs_of, tmp_path):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(40)]
    docs_of([(i, texts[i % 40]) for i in range(60)]).repartition(8).write.parquet(str(tmp_path / "docs"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    left = drop_near_duplicates(spark.read.parquet(str(tmp_path / "docs")))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert sorted(r.text for r in left.collect()) == sorted(texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def altered(words, similarity, step=1):
    """The words with as many changed, from the front or the back, as leave just that similarity of shingles."""
    n, w = len(words) - 4, list(words)
    for k, i in enumerate(range(5, len(words) - 5, 5), 1):
        if n - 5 * k < similarity * (n + 5 * k):
            break
        w[step * i] = f"z{similarity}{w[step * i]}"
    return w


def test_doubt_is_decided_before_pruning(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "_estimate", lambda a, b: np.full(len(a), 0.8))  # says nothing: the texts must decide
    monkeypatch.setattr(simhash, "LIKELY", 1, raising=False)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 50000, 300)]
        far = [altered(words, s) for s in (0.72, 0.74, 0.76)]
        group = [words, *far, *[altered(w, 0.82, -1) for w in far]]
        rows += [" ".join(group[i]) for i in rng.permutation(len(group))]
    want = brute_components(list(range(len(rows))), lambda i, j: jaccard(rows[i], rows[j]) >= 0.8)
    assert {r.doc_id for r in drop_near_duplicates(docs_of(list(enumerate(rows)))).collect()} == set(want.values())
    assert 12 * 3 < len(set(want.values())) < len(rows)


def test_large_shards_lose_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "ROUTE_ROWS", 3)
    rng = np.random.default_rng(8)
    template = [f"t{x}" for x in range(200)]
    rows = []
    for k in range(120):  # pairs at 0.80 to 0.87 that share a template with all others
        words = template + [f"w{x}" for x in rng.integers(0, 50000, 150)]
        rows += [" ".join(words), " ".join(altered(words, 0.80 + 0.0004 * k, -1))]
    assert all(0.8 <= jaccard(*rows[i : i + 2]) < 0.87 for i in range(0, 240, 2))
    want = brute_components(list(range(len(rows))), lambda i, j: jaccard(rows[i], rows[j]) >= 0.8)
    assert len(set(want.values())) == 120
    assert {r.doc_id for r in drop_near_duplicates(docs_of(list(enumerate(rows)))).collect()} == set(want.values())


def test_large_groups_are_dealt_to_bounded_tasks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "ROUTE_ROWS", 40)
    rng, sizes, links_of = np.random.default_rng(9), [], simhash.near_links

    def spied(shards, *rest):
        sizes.extend(r["count"] for r in shards.groupBy("key").count().collect())
        return links_of(shards, *rest)

    monkeypatch.setattr(simhash, "near_links", spied)
    words = [f"w{x}" for x in range(300)]
    rows = [" ".join([*words[:i], f"z{i}", *words[i + 1 :]]) for i in range(300)]
    rows += [" ".join(rng.permutation(words)) for _ in range(5)]
    assert {r.doc_id for r in drop_near_duplicates(docs_of(list(enumerate(rows)))).collect()} == {0, *range(300, 305)}
    assert sum(sizes) < 2 * 6 * len(rows) and max(sizes, default=0) <= 80


def test_long_texts_in_pieces(monkeypatch):
    texts = [b"one two  three four " * 40, b"ab " * 5 + b" " * 200 + b"cd ef", b"w" * 300 + b" x y", b"a b", b" " * 500, b"a" + b" " * 300 + b"b", "é \u00a0x ".encode() * 60]
    whole = [simhash._majority(np.array(h, np.uint64), np.array([len(h)]))[0] for h in map(simhash.shingle_xxh64, texts)]
    monkeypatch.setattr(simhash, "PIECE_BYTES", 64)
    assert [int(simhash.long_fingerprint(t)) for t in texts] == [int(x) for x in whole]


def test_shards_are_split_to_the_last_bit(spark, monkeypatch):
    """With shards of two rows every level is used, and no link is lost."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 2)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))) for s in seeds for _ in range(30)}
    fps = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {tuple(sorted((r.src, r.dst))) for r in simhash.links(df).collect()}
    label = {int(x): int(x) for x in fps.view(np.int64)}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        label[top(a)] = top(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    for i, j in zip(*np.nonzero(near)):
        assert top(int(fps.view(np.int64)[i])) == top(int(fps.view(np.int64)[j]))
