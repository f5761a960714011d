"""Benchmark decontamination: SimHash windows of each item's size, found by multi-index Hamming blocks, then verified.

Texts and items are sequences of words (A-Z lower-cased), compared by their word shingles, weighted by how often each
occurs: the weighted Jaccard similarity sum(min) / sum(max). A window that reaches the threshold must hold a number of
shingles that occur in the benchmark at all; running counts of those leave few windows, and lose none. Each such window
of as many words as an item has is fingerprinted; the items' fingerprints are indexed by 8 blocks of 8 bits, and as two
fingerprints within ``RADIUS`` = 23 bits differ by at most 2 bits in some block, looking up each block's values within
2 bits finds all of them. Items of the window's size among these are compared exactly.

The benchmark is a stated query set: it is broadcast in blocks of at most ``BLOCK_BYTES`` of text (or one longer item),
against all documents each, in the tasks that read them. No document text is shuffled.

Defined results: texts and items that are null or without words match nothing; items of fewer words than a shingle are
one shingle; a text shorter than an item is one window; a long text is looked at in overlapping pieces of
``PIECE_WORDS`` words, which changes no result; of several windows for one item the most similar is reported, the
first of equals; each row of a repeated document or item is reported; an empty documents or benchmark table gives
no matches; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import runs_of
from parlance.llm.common import encoded, hash_grams, hash_words, popcount, slices

#: Bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Bits in which a window and an item may differ: at a similarity of 0.8 the mean is 9.7, the deviation 2.9.
RADIUS = 23
#: Words that windows are looked for in at a time, and as many more as the longest item has.
PIECE_WORDS = 1 << 20
_BITMAP = 1 << 24


def _fingerprint(grams: np.ndarray) -> np.uint64:
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(grams), bitorder="little").view("<u8")[0]


class ItemIndex:
    """A block of the benchmark: its shingles, sizes, and fingerprints by blocks of bits."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float, shingle: int):
        self.similarity, self.shingle = similarity, shingle
        self.ids, self.sizes, self.grams, self.counts, prints = [], [], [], [], []
        for item_id, text in items:
            words = hash_words(text)[0]
            if len(words):
                grams = hash_grams(words, shingle)
                distinct, n = np.unique(grams, return_counts=True)
                self.ids.append(item_id)
                self.sizes.append(len(words))
                self.grams.append(distinct)
                self.counts.append(n)
                prints.append(_fingerprint(grams))
        self.prints = np.array(prints, dtype=np.uint64)
        self.known = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))
        # the sizes of the items that each shingle occurs in, one after another: as many as there are shingles of items
        held = [np.searchsorted(self.known, g) for g in self.grams]
        pairs = np.unique(np.stack((np.concatenate([*held, np.zeros(0, np.int64)]), np.repeat(np.array(self.sizes, np.int64), [len(h) for h in held]))), axis=1) if held else np.zeros((2, 0), np.int64)
        self.held_sizes = pairs[1]
        self.held_from = np.searchsorted(pairs[0], np.arange(len(self.known) + 1))
        self.widths = {min(s, shingle) for s in self.sizes}
        values = np.arange(256, dtype=np.uint8)
        near = popcount(values[:, None] ^ values[None, :]) <= RADIUS // 8
        own = self.prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        self.blocks = [[np.flatnonzero(near[v][own[:, k]]) for v in range(256)] for k in range(8)]
        self._bitmap = None

    def __getstate__(self):
        return self.__dict__ | {"_bitmap": None}

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that occur in the benchmark, and their numbers among its shingles."""
        if self._bitmap is None:
            self._bitmap = np.zeros(_BITMAP, dtype=bool)
            self._bitmap[(self.known & np.uint64(_BITMAP - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(self._bitmap[(grams & np.uint64(_BITMAP - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        sure = self.known[place] == grams[maybe]
        return maybe[sure], place[sure]

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        """All items whose fingerprints are within the radius."""
        found = np.unique(np.concatenate([rows[v] for rows, v in zip(self.blocks, np.array([fingerprint], "<u8").view(np.uint8).tolist(), strict=True)]))
        return found[popcount(self.prints[found] ^ fingerprint) <= RADIUS]

    def alike(self, grams: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        distinct, n = np.unique(grams, return_counts=True)
        known, want = self.grams[item], self.counts[item]
        place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        both = np.minimum(n, want[place])[known[place] == distinct].sum()
        return float(both / (n.sum() + want.sum() - both))

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, start, words, similarity): for each item the best window that reaches the threshold."""
        best: dict[int, tuple[float, int, int]] = {}
        reach = PIECE_WORDS + max(self.sizes, default=0)
        for at in range(0, max(1, len(words) - reach + PIECE_WORDS), PIECE_WORDS):
            at = max(0, min(at, len(words) - reach))
            for item, s, n, alike in self._matches(words[at : at + reach]):
                if alike > best.get(item, (0.0,))[0]:
                    best[item] = (alike, at + s, n)
        return [(i, s, n, a) for i, (a, s, n) in sorted(best.items())]

    def _matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        rest = self.similarity / (1 + self.similarity)
        for width in self.widths:
            if len(words) < width:
                continue
            grams = hash_grams(words, width)
            at, which = self.hits(grams)
            # each hit once for each size of items that hold its shingle
            many = self.held_from[which + 1] - self.held_from[which]
            place = np.repeat(self.held_from[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            sizes, at = self.held_sizes[place], np.repeat(at, many)
            order = np.argsort(sizes, kind="stable")
            sizes, at = sizes[order], at[order]
            for size, a, b in runs_of(sizes):
                if min(size, self.shingle) == width:
                    yield from self._windows(grams, at[a:b], size, width, rest, len(words))

    def _windows(self, grams: np.ndarray, at: np.ndarray, size: int, width: int, rest: float, words: int) -> Iterator[tuple[int, int, int, float]]:
        own = size - width + 1
        count = min(own, len(grams))
        need = math.ceil(rest * (own + count) - 1e-9)  # so many shingles at least are in both
        if len(at) < need:
            return
        mark = np.zeros(len(grams) + 1, dtype=np.int64)
        mark[at + 1] = 1
        so_far = np.cumsum(mark)
        for s in np.flatnonzero(so_far[count:] - so_far[:-count] >= need).tolist():
            window = grams[s : s + count]
            for item in self.within(_fingerprint(window)).tolist():
                if self.sizes[item] == size:
                    alike = self.alike(window, item)
                    if alike >= self.similarity:
                        yield item, s, min(size, words), alike


def _item_blocks(benchmark: DataFrame, similarity: float, shingle: int) -> Iterator[ItemIndex]:
    """The benchmark in blocks that are known to be small enough to broadcast."""
    items = benchmark.select(benchmark["item_id"], benchmark["text"]).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = [(r.item_id, r.text.encode()) for r in mine.collect()]
        index = ItemIndex(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), similarity, shingle)
        if len(index.ids):
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, start, words, similarity): every item that a document holds, and where (in words)."""
    rows = docs.select(docs["doc_id"], docs["text"])
    out = None
    for index in _item_blocks(benchmark, similarity, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                    found += [(doc_id, index.ids[i], s, n, a) for i, s, n, a in index.matches(hash_words(text or b"")[0])]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "start", "words", "similarity"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, start long, words long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, words long, similarity double")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark."""
    place = docs.columns.index("text")
    for index in _item_blocks(benchmark, similarity, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = [not shared.value.matches(hash_words(t or b"")[0]) for t in encoded(batch.column(place))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
