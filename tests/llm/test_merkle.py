import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import queries
from parlance.llm.merkle import audit, leaf

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    said = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, at):
    """The siblings of a leaf and whether each stands left."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else "", at & 1))
        at >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]])
    top = tree_of([trees[g][-1][0] for g in order])
    found = []
    for i, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            path = path_of(trees[g], k) + path_of(top, i)
            tampered = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf_of(r, int(tampered))
            for s, left in path:
                h = sha(s, h) if left else sha(h, s)
            found.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], sha(*[s for s, _ in path]), h, h == top[-1][0]))
    return sorted(found, key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def audited(docs, bits):
    longer = leaf(*[docs[c] + 1 if c == "n_chars" else docs[c] for c in COLUMNS])
    tampered = F.when((F.crc32(docs["doc_id"].cast("string")) % 7 == 0) & docs["n_chars"].isNotNull(), longer)
    return audit(docs, COLUMNS, altered=tampered, bits=bits).withColumnRenamed("key", "doc_id")


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_against_brute_force(spark, bits):
    """Trees of 1 to 37 leaves, so that blocks are full, broken and alone, over up to six tiers."""
    rows, k = [], 0
    for lang, n in [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("é", 16), ("f", 17), (None, 37)]:
        for _ in range(n):
            k += 1
            rows.append({"doc_id": k * 7919 % 1009, "text": f"tëxt {k}" * (k % 4) or None, "lang": lang, "source": "s" if k % 5 else None, "n_chars": k if k % 6 else None})
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(audited(docs, bits)) == brute(rows)


def test_the_given_tables(spark):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = got(queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001"))
    assert found == brute(rows)
    assert {r[6] for r in found} == {True, False}


def test_odd_rows(spark):
    """Nulls everywhere, repeated ids and rows, an empty and a very long text, names that clash, no rows."""
    rows = [{"doc_id": i, "text": t, "lang": g, "source": s, "n_chars": n} for i, t, g, s, n in [
        (None, None, None, None, None), (None, "x", None, None, 1), (1, "", "", "", 0), (1, "", "", "", 0), (1, "y", "", "", 1), (2, "z" * 3_000_000, "en", "s", 2**62), (3, None, "en", None, None)
    ]]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs
    for name in ("tree", "place", "digest", "kept", "rid", "root", "siblings", "above", "block", "nodes", "leaf", "key"):
        wide = wide.withColumn(name, F.lit(name))
    assert got(audited(docs, 2)) == got(audited(wide, 2)) == brute(rows)
    assert audited(docs.limit(0), 2).count() == 0


def test_a_changed_text_is_found(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(20)])
    changed = F.when(docs["doc_id"] == 13, leaf(*[F.lit("other") if c == "text" else docs[c] for c in COLUMNS]))
    assert [r.key for r in audit(docs, COLUMNS, altered=changed, bits=2).where("not verified").collect()] == [13]
