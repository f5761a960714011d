"""SimHash near-duplicates: Burkhard-Keller trees over fingerprints, in shards that no link can escape.

A fingerprint of 64 bits sums up a text's word shingles. Fingerprints within ``radius`` bits of one another are
links. Two fingerprints at 3 or fewer differing bits agree in at least one of four blocks of 16 bits, so a shard
for each block and value holds every link; a shard that grows large is split again by the same argument over its
other bits. In each shard a Burkhard-Keller tree keys the children by their integer distance to the parent, and a
search follows only edges within the radius of the distance at hand. Shards go to tasks by a shuffle rather than
by broadcast, because the trees grow with the documents. A task gives a spanning set of links, not all pairs.

Defined results: a null or blank text has no shingle and fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; equal rows are one group; rows with a null doc_id keep their own row and take
part; a long text is hashed in pieces of ``PIECE_BYTES``, whose bits are counted on; an empty table gives an empty
table. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import runs_of
from parlance.llm.common import PIECE_BYTES, components, encoded, hash_grams, hash_words, materialise, mix64, only, popcount, slices

#: A shard with more fingerprints than this is split by a further block of bits.
SHARD_ROWS = 20_000
#: Bits that may be left in a shard of the last level: it has 2 ** 15 fingerprints at most.
LAST_BITS = 15
#: Pairs of query and tree node that a search holds at a time.
FRONTIER = 1 << 21

_U = np.uint64


# ---------------------------------------------------------------- fingerprints


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the 64-bit integer whose bits are set in over half of them (0 for none)."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        most = (2 * ones > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(most, axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def shingle_xxh64(text: bytes | None, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``words`` words (A-Z lower-cased, joined by one space), repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)]
    line = b" ".join(parts)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[:-words].tolist(), (starts[words:] - 1).tolist(), strict=True)]


#: A longer text is hashed in pieces.
PIECE_BYTES = 1 << 20
_GAP = re.compile(rb"[\t-\r ]")


def long_fingerprint(text: bytes, words: int = 3, seed: int = 42) -> np.uint64:
    """The fingerprint of a long text; a piece begins with the words that its first shingles share with the last."""
    ones, count, at, kept = np.zeros(64, np.int64), 0, 0, b""
    while at < len(text):
        gap = _GAP.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        piece = kept + b" " + text[at:end]
        at = end
        parts = piece.split()
        if len(parts) < words and at < len(text):  # no whole shingle yet
            kept = b" ".join(parts)
            continue
        if count and len(parts) < words:
            break
        hashes = np.array(shingle_xxh64(piece, words, seed), dtype="<u8")
        for a in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
        kept = b" ".join(parts[max(0, len(parts) - words + 1) :])
    return np.packbits(2 * ones > count, bitorder="little").view("<u8")[0] if count else _U(0)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text as a long; one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            long = [i for i, t in enumerate(texts) if t and len(t) > PIECE_BYTES]
            hashes = [[] if t and len(t) > PIECE_BYTES else shingle_xxh64(t, words, seed) for t in texts]
            counts = np.array([len(h) for h in hashes], dtype=np.int64)
            flat = np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(counts.sum()))
            fp = _majority(flat, counts)
            for i in long:
                fp[i] = long_fingerprint(texts[i], words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------ Burkhard-Keller forests


class Forest:
    """One Burkhard-Keller tree for each shard, all of them in flat arrays. Fingerprints are distinct in a shard."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """shard: ascending numbers. The first fingerprint of a shard is its root."""
        n = len(fp)
        self.fp, self.shard = fp, shard
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(first, n))
        self.root = np.repeat(first, self.size)
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        rest = np.flatnonzero(np.arange(n) != self.root)
        at = self.root[rest]
        while len(rest):  # all nodes descend one level; the first at each free edge stays there
            d = popcount(fp[rest] ^ fp[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            child = rest[order][head][np.cumsum(head) - 1]
            stays = order[head]
            parent[rest[stays]], edge[rest[stays]] = at[stays], d[stays]
            goes = order[~head]
            at, rest = child[~head], rest[goes]
        self.child = np.lexsort((edge, parent))[np.count_nonzero(parent < 0) :]
        self.edge = edge[self.child]
        self.offset = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.bincount(parent[parent >= 0], minlength=n), out=self.offset[1:])

    def neighbours(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (i, j, distance), i > j, of nodes of one tree within the radius, in bounded portions."""
        n = len(self.fp)
        sizes = np.cumsum(np.repeat(self.size, self.size))
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + FRONTIER, side="right")))
            query = np.arange(start, stop)
            node = self.root[query]
            while len(query):
                d = popcount(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = (d <= radius) & (node < query)
                if near.any():
                    yield query[near], node[near], d[near]
                many = self.offset[node + 1] - self.offset[node]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                pos = np.repeat(self.offset[node], many) + inner
                follow = np.abs(self.edge[pos] - np.repeat(d, many)) <= radius
                query, node = np.repeat(query, many)[follow], self.child[pos[follow]]
            start = stop


class Labels:
    """The least member of each set, as sets are joined pair by pair."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.of[a] != self.of[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            on = x != y
            if not on.any():
                return
            a, b, x, y = a[on], b[on], x[on], y[on]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


# ------------------------------------------------------------------- exact links


def _block(bits: str, count: int, width: int, tag: int) -> F.Column:
    """``count`` shard keys of ``bits``: a hash of the block's place and value and of the shard above."""
    return F.array(*[F.struct(F.xxhash64(F.col("key"), F.lit(tag), F.lit(i), F.shiftrightunsigned(F.col(bits), i * width).bitwiseAND((1 << width) - 1)).alias("key"), F.lit(i).alias("block")) for i in range(count)])


def _sharded(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint in every shard that one of its partners at 3 or fewer bits may be in.

    A shard of the first level fixes 16 bits; partners differ in at most 3 of the other 48, so that four blocks of
    12 of those split a large shard without losing a link; and so on with what is left, until so few bits are left
    that a shard of distinct fingerprints is small whatever they are.
    """
    rows = fps.withColumn("key", F.lit(0)).withColumn("rest", F.col("fp"))
    done, left, level = None, 64, 0
    while True:
        width = -(-left // 4)
        rows = rows.withColumn("e", F.explode(_block("rest", 4, width, level)))
        low = F.col("e.block") * F.lit(width)
        above = F.when(low + width >= left, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(rest, cast(e.block * {width} + {width} as int)), cast(e.block * {width} as int))"))
        below = F.expr(f"rest & (shiftleft(1L, cast(e.block * {width} as int)) - 1)")
        rows = rows.select("fp", F.col("e.key").alias("key"), above.bitwiseOR(below).alias("rest"))
        left, level = 3 * width, level + 1  # the last block may be the narrowest: no more bits than these are left
        if left <= LAST_BITS:
            return rows.select("key", "fp") if done is None else done.unionByName(rows.select("key", "fp"))
        hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select("key"), "hot")
        if hot.isEmpty():
            return rows.select("key", "fp") if done is None else done.unionByName(rows.select("key", "fp"))
        cool = rows.join(hot, "key", "left_anti").select("key", "fp")
        done = cool if done is None else done.unionByName(cool)
        rows = rows.join(hot, "key", "left_semi")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst): for distinct longs ``fp``, links within the radius (3 at most) that connect what all of them connect."""
    if radius > 3:
        raise ValueError("the shards hold all links up to a radius of 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        key, fp = (table.column(c).to_numpy() for c in ("key", "fp"))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        forest, sets = Forest(fp, key), Labels(len(fp))
        for a, b, _ in forest.neighbours(radius):
            sets.join(a, b)
        linked = np.flatnonzero(sets.of != np.arange(len(fp)))
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[sets.of[linked]])], ["src", "dst"])

    return _sharded(fps).repartition("key").mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest doc_id that links lead to."""
    prints = materialise(fingerprints(docs, words, seed), "fp")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    cc = components(links(each.select("fp"), radius))
    labelled = each.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    place = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(place, "fp").select("doc_id", "fp", "component_id")


# ----------------------------------------------------- near-duplicate documents

#: Shards by single min-wise hashes: a pair of similarity s shares none of them with probability (1 - s) ** ROUTES.
ROUTES = 6
#: Bins of the one-permutation sketch, one byte each; its estimate of 0.8 has a standard error of 0.018.
BINS = 512
#: Estimates within this of the threshold are decided by the texts themselves.
DOUBT = 0.06
#: Pairs in doubt that a text gives in the first round; each further round gives eight times as many.
LIKELY = 4
#: Documents in doubt whose row numbers may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bits in which fingerprints of texts with a similarity of 0.8 may differ: the mean of 9.7 and over 3.5 deviations.
NEAR_RADIUS = 20
#: Texts of a large shard that all its others are compared with first.
REPRESENTATIVES = 4
#: A route's shard with more texts than this is compared in pairs of blocks of about half as many.
ROUTE_ROWS = 4_000

_ROUTE_MULTIPLIERS = mix64(np.arange(1, ROUTES + 2, dtype=np.uint64)) | _U(1)


def _sketch(grams: np.ndarray) -> bytes:
    """One byte for each bin of a one-permutation min-hash; 0 marks an empty bin."""
    out = np.zeros(BINS, dtype=np.uint8)
    if len(grams):
        h = np.sort(mix64(grams * _ROUTE_MULTIPLIERS[-1]))
        bins = (h >> _U(64 - 9)).astype(np.int64)
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        low = mix64(h[first])
        out[bins[first]] = (low % _U(255)).astype(np.uint8) + 1
    return out.tobytes()


def _words_digest(text: bytes) -> bytes:
    """A digest of the words of a text, lower-cased, whatever stands between them; long texts go piece by piece."""
    made, at = xxhash.xxh3_128(), 0
    while at < len(text):
        end = at + PIECE_BYTES
        gap = _GAP.search(text, end)
        end = gap.start() if gap else len(text)
        words = text[at:end].lower().split()
        if words:
            made.update(b" ".join(words) + b" ")
        at = end
    return made.digest()


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(rid, digest, fp, sketch, minima) of each row: rid as in ``docs``; texts of equal words have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            grams = [np.unique(hash_grams(hash_words(t or b"")[0], words)) for t in texts]  # sets: repeats weigh nothing
            counts = np.array([len(g) for g in grams], dtype=np.int64)
            fp = _majority(np.concatenate(grams) if grams else np.zeros(0, np.uint64), counts)
            digest = [_words_digest(t or b"") for t in texts]
            minima = [[int(mix64(g * m).min().view(np.int64)) for m in _ROUTE_MULTIPLIERS[:-1]] if len(g) else [0] * ROUTES for g in grams]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(fp.view(np.int64)), pa.array([_sketch(g) for g in grams], pa.binary()), pa.array(minima, pa.list_(pa.int64()))], ["rid", "digest", "fp", "sketch", "minima"])

    return docs.mapInArrow(run, "rid long, digest binary, fp long, sketch binary, minima array<long>")


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from sketches; bins that are empty on both sides say nothing, equal bytes of others 1/255."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    raw = same / np.maximum(some, 1)
    return np.where(some == 0, 1.0, (raw - 1 / 255) / (1 - 1 / 255))


def _likeliest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, many: int) -> np.ndarray:
    """Which pairs are among the ``many`` of greatest weight of either end."""
    keep = np.zeros(len(a), dtype=bool)
    for end in (a, b):
        order = np.lexsort((-weight, end))
        starts = np.flatnonzero(np.concatenate(([True], end[order][1:] != end[order][:-1])))
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        keep[order[place < many]] = True
    return keep


def near_links(shards: DataFrame, similarity: float, likely: int) -> DataFrame:
    """(src, dst, kind) over the rids of ``shards``, which are (key, label, side, rid, fp, sketch) rows.

    All rows of side -1 meet within their key, and those of side 2; rows of side 0 meet those of side 1. Rows of one label are joined already. The pairs that are sure (kind 0) connect what all sure pairs connect. Of the
    pairs in doubt between sets otherwise apart (kind 1) a task gives each text's ``likely`` likeliest; kind 2 has in
    ``src`` the key of a shard with further ones, to be asked again when those given are decided.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        key, label, side, fp, rid = (table.column(c).to_numpy() for c in ("key", "label", "side", "fp", "rid"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        order = np.lexsort((rid, fp, key, side >= 0))
        key, label, side, fp, rid, sketch = key[order], label[order], side[order], fp[order].view(np.uint64), rid[order], sketch[order]
        whole = int(np.count_nonzero(side < 0))  # rows of whole shards come first, those of blocks after
        new = np.concatenate((np.full(min(whole, 1), True), (key[1:whole] != key[: max(0, whole - 1)]) | (fp[1:whole] != fp[: max(0, whole - 1)])))
        heads = np.flatnonzero(new)
        width = np.diff(np.append(heads, whole))
        sets = Labels(len(fp))
        order = np.lexsort((label, key))
        first = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (label[order][1:] != label[order][:-1])))
        sets.join(order, order[np.flatnonzero(first)[np.cumsum(first) - 1]])
        was = sets.of.copy()

        doubts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        more: list[np.ndarray] = []

        def give() -> None:
            a, b, alike = map(np.concatenate, zip(*doubts, strict=True))
            on = sets.apart(a, b)
            a, b, alike = a[on], b[on], alike[on]
            keep = _likeliest(a, b, alike, likely)
            more.append(np.unique(key[a[~keep]]))
            doubts[:] = [(a[keep], b[keep], alike[keep])]

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                on = sets.apart(x, y)
                x, y = x[on], y[on]
                alike = _estimate(sketch[x], sketch[y])
                on = alike >= similarity + DOUBT
                sets.join(x[on], y[on])
                on = ~on & (alike >= similarity - DOUBT)
                doubts.append((x[on], y[on], alike[on]))
            if sum(len(d[0]) for d in doubts[1:]) > 1 << 21:
                give()

        many = np.flatnonzero(width > 1)
        for k in many.tolist():  # different texts of one fingerprint, against each in turn
            mine = np.arange(heads[k], heads[k] + width[k])
            for i in range(1, len(mine)):
                if sets.of[mine[i]] == mine[i]:
                    compare(mine[:i], np.full(i, mine[i]))
        for i, j, _ in Forest(fp[heads], key[heads]).neighbours(NEAR_RADIUS):
            wi, wj = width[i], width[j]
            pairs = wi * wj
            for at in _portions(pairs, 1 << 18):
                n = pairs[at]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(wj[at], n)
                compare(np.repeat(heads[i[at]], n) + inner // w, np.repeat(heads[j[at]], n) + inner % w)
        for _, start, end in runs_of(key[whole:]):
            x, y, inside = (np.flatnonzero(side[whole + start : whole + end] == k) + whole + start for k in (0, 1, 2))
            for x, y in ((x, y), (inside, inside)):
                for at in range(0, len(x), 256):
                    q = x[at : at + 256]
                    near = (popcount(fp[q][:, None] ^ fp[y]) <= NEAR_RADIUS) & sets.apart(q[:, None], y)
                    i, j = np.nonzero(near & (q[:, None] > y) if y is inside else near)
                    compare(q[i], y[j])
        linked = np.flatnonzero((was == np.arange(len(fp))) & (sets.of != was))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if doubts:
            give()
            a, b, _ = doubts[0]
        left = np.unique(np.concatenate([np.zeros(0, np.int64), *more]))
        src, dst = np.concatenate((rid[linked], np.minimum(rid[a], rid[b]), left)), np.concatenate((rid[sets.of[linked]], np.maximum(rid[a], rid[b]), left))
        kind = np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(linked), len(a), len(left)])
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(kind)], ["src", "dst", "kind"])

    return shards.repartition("key").mapInArrow(run, "src long, dst long, kind int")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The (src, dst) pairs whose texts' sets of word shingles have the Jaccard similarity, exactly."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            grams = [np.unique(hash_grams(hash_words(t or b"")[0], words)).tobytes() for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["rid", "grams"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    ids = materialise(pairs.select(F.explode(F.array("src", "dst")).alias("rid")).distinct(), "doubt")
    few = ids.count() <= BROADCAST_IDS
    held = materialise(docs.select("rid", "text").join(F.broadcast(ids) if few else ids, "rid", "left_semi").mapInArrow(sets, "rid long, grams binary"), "grams")
    one = held.select(F.col("rid").alias("src"), F.col("grams").alias("a"))
    two = held.select(F.col("rid").alias("dst"), F.col("grams").alias("b"))
    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "a", "b").mapInArrow(alike, "src long, dst long")


def _portions(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")))
        yield slice(start, stop)
        start = stop


def _routed(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, rid, fp, sketch): each text in a shard for each of its min-wise hashes; and of large shards, written, if any."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("minima")[i]) for i in range(ROUTES)])
    hot = materialise(texts.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ROUTE_ROWS).select("key"), "hot")
    rows = texts.select(F.explode(keys).alias("key"), "rid", "fp", "sketch")
    if hot.isEmpty():
        return rows, None
    return rows.join(hot, "key", "left_anti"), materialise(rows.join(hot, "key", "left_semi"), "hot-rows")


def _to_representatives(hot: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, sure): texts of large shards, and those of a few representatives of their shard that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("sketch", "other"))
            alike = _estimate(a, b)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike >= similarity + DOUBT)], ["src", "dst", "sure"])
            yield found.filter(pa.array(alike >= similarity - DOUBT))

    some = hot.groupBy("key").agg(*[F.min_by("rid", F.xxhash64("rid", F.lit(k))).alias(f"r{k}") for k in range(REPRESENTATIVES)])
    some = some.select("key", F.explode(F.array_distinct(F.array(*[f"r{k}" for k in range(REPRESENTATIVES)]))).alias("rid"))
    some = materialise(hot.join(some, ["key", "rid"]).select("key", F.col("rid").alias("dst"), F.col("sketch").alias("other")), "some")
    pairs = hot.join(some, "key").where("rid <> dst").select(F.col("rid").alias("src"), "dst", "sketch", "other")
    return pairs.mapInArrow(run, "src long, dst long, sure boolean").distinct()


def _blocks(hot: DataFrame) -> DataFrame:
    """(key, label, side, rid, fp, sketch): large shards as pairs of blocks, so that all pairs of different labels meet.

    The rows of a shard's largest label meet only the others, side 0 and 1 of a key; the others meet one another
    likewise, and within a block (side 2). Where all rows have one label nothing is left to compare.
    """
    size = hot.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n"), F.sum("n").alias("all"))
    count = lambda c: F.ceil(c / max(1, ROUTE_ROWS // 2)).cast("int")
    size = materialise(size.select("key", "top", count(F.col("n")).alias("tops"), count(F.col("all") - F.col("n")).alias("others")), "sizes")
    rows = hot.join(size, "key").withColumn("is_top", F.col("label") == F.col("top"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rid"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    task = lambda kind, a, b, side: F.struct(F.xxhash64("key", F.lit(kind), a, b).alias("key"), side.alias("side"))
    top = F.transform(upto(F.col("others")), lambda j: task(0, F.col("i"), j, F.lit(0)))
    across = F.transform(upto(F.col("tops")), lambda j: task(0, j, F.col("i"), F.lit(1)))
    among = F.transform(upto(F.col("others")), lambda j: task(1, F.least("i", j), F.greatest("i", j), F.when(j == F.col("i"), 2).when(j > F.col("i"), 0).otherwise(1)))
    rows = rows.withColumn("e", F.explode(F.when(F.col("is_top"), top).otherwise(F.concat(across, among))))
    return rows.select("e.key", "label", "e.side", "rid", "fp", "sketch")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the label that the edges give each rid."""
    cc = components(edges).select(F.col("node").alias("rid"), "component")
    return rows.drop("label").join(cc, "rid", "left").withColumn("label", F.coalesce("component", "rid")).drop("component")


def _near_edges(texts: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(src, dst): what is sure or verified; shards with pairs in doubt are asked again until none between sets apart is left."""
    cool, hot = _routed(texts)
    shards = cool.withColumn("label", F.col("rid")).withColumn("side", F.lit(-1))
    edges = tried = None
    if hot is not None:
        near = materialise(_to_representatives(hot, similarity), "representatives")
        sure = near.where("sure").select("src", "dst")
        doubt = materialise(near.where("not sure").select("src", "dst").join(sure.select("src"), "src", "left_anti").distinct(), "pairs")
        edges = sure.unionByName(materialise(verified(doubt, docs, similarity, words), "verified"))
        tried = doubt
        shards = shards.unionByName(_blocks(materialise(_labelled(hot, edges), "labelled")))
    part, likely = shards, LIKELY
    while True:
        found = materialise(near_links(part, similarity, likely), "near")
        sure, doubt = (found.where(F.col("kind") == k).select("src", "dst") for k in (0, 1))
        doubt = doubt.distinct()
        doubt = materialise(doubt if tried is None else doubt.join(tried, ["src", "dst"], "left_anti"), "pairs")
        new = sure.unionByName(materialise(verified(doubt, docs, similarity, words), "verified"))
        edges = new if edges is None else edges.unionByName(new)
        left = materialise(found.where(F.col("kind") == 2).select(F.col("src").alias("key")).distinct(), "left")
        if left.isEmpty():
            return edges
        tried = doubt if tried is None else tried.unionByName(doubt)
        likely *= 8
        part = _labelled(shards.join(left, "key", "left_semi"), edges)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(rid, kept_rid): every row that has a near-duplicate, with its group's smallest rid.

    ``docs`` has a unique long ``rid`` and ``text``. Two texts are near-duplicates when the Jaccard similarity of
    their sets of word shingles reaches ``similarity``; groups are connected. A sketch of 512 bins decides what is clearly
    so, and the texts what is in doubt. Blank and null texts have equal (empty) sets and form one group.
    """
    own = only(docs, "rid", "text")
    rows = materialise(sketches(own, words), "sketch")
    texts = materialise(rows.groupBy("digest").agg(F.min("rid").alias("rid"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("minima").alias("minima")).drop("digest"), "texts")
    cc = components(_near_edges(texts, own, similarity, words))
    first = rows.groupBy("digest").agg(F.min("rid").alias("first"), F.count("*").alias("copies"))
    label = first.join(cc.select(F.col("node").alias("first"), "component"), "first", "left").select("digest", "copies", F.coalesce("component", "first").alias("kept_rid"), F.col("component").isNotNull().alias("linked"))
    return rows.select("rid", "digest").join(label.where("linked or copies > 1"), "digest").select("rid", "kept_rid")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (the first), its columns as they are."""
    names = docs.columns
    numbered = docs.select(*[docs[n].alias(f"_{i}") for i, n in enumerate(names)], F.monotonically_increasing_id().alias("rid"))
    rows = materialise(numbered, "numbered")  # once: splits may differ from job to job
    texts = rows.select("rid", F.col(f"_{names.index('text')}").alias("text"))
    gone = near_duplicates(texts, similarity, words).where("rid <> kept_rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
