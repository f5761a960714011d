"""Substring deduplication by content-defined chunking with a gear rolling hash.

The hash at a byte sums a random number for each of the last 16 bytes, shifted by their distance. A text is cut at
ends of words whose hash is in the lowest third, if the chunk has ``LEAST_CHUNK`` bytes; so cuts depend on the
content nearby, and an insertion shifts the chunks but soon leaves them equal again. A word of over 64 bytes is cut
inside likewise; a chunk that has grown to ``LARGEST_CHUNK`` bytes ends with its word. Windows are the shortest runs of chunks with ``LEAST_WORDS`` words that begin, or that end, at each
chunk. A window that one earlier document has as a whole is a repeat; repeats that overlap are one repeated passage.
The document with the smallest doc_id that has its first window keeps it, however the files are split.

Window digests meet in partitions by digest: each block of documents asks of its distinct digests which earlier
document has them first (see ``blocks``). A passage that every document shares is one entry for each block.

Defined results: documents come in the order of their doc_id, null last, which says what is earlier; rows of one
doc_id come as Spark reads them; a null or empty text has no chunk and stays as it is; equal rows repeat each other;
what repeats only within one document stays; a long text is looked at in pieces of a megabyte; a null doc_id is
reported as null; an empty table gives no rows; a clashing column name has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from parlance.llm.blocks import key_partitions, load_block, meet, runs_of, spread, store_blocks, with_answers
from parlance.llm.common import PIECE_BYTES, encoded, materialise, mix64, only

#: Bytes that a chunk has at least, and from which on it ends with any word; words that a repeated passage has at least
#: in whole chunks.
LEAST_CHUNK = 16
LARGEST_CHUNK = 64
LEAST_WORDS = 32

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_THIRD = np.uint32((1 << 32) // 3)


def gear(raw: np.ndarray) -> np.ndarray:
    """The hash of the 16 bytes that end at each byte, by doubling the span four times."""
    h = _GEAR[raw]
    for span in (1, 2, 4, 8):
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h = more
    return h


def cut_points(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, words): where chunks end, the text's end last, and how many words each has."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, inner = [], []
    for at in range(0, n, PIECE_BYTES):  # a long text piece by piece, each with the 16 bytes before
        lo, hi = max(0, at - 16), min(n, at + PIECE_BYTES)
        h = gear(raw[lo:hi])[at - lo :]
        space = _SPACE[raw[at : hi + 1]]
        if hi == n:
            space = np.append(space, True)
        ends = np.flatnonzero(space[1:] & ~space[:-1])
        found.append((ends + at + 1, h[ends] < _THIRD))
        inside = np.flatnonzero(h >> np.uint32(27) == 0) + at + 1
        inner.append(inside[inside < n])
    ends, good = (np.concatenate(x) for x in zip(*found, strict=True))
    inner = np.concatenate(inner)
    if len(inner):  # ends of a kind within words that are long
        inner = inner[(raw[inner] & 0xC0) != 0x80]
        place = np.searchsorted(ends, inner)
        before = np.where(place > 0, ends[np.maximum(place - 1, 0)] if len(ends) else 0, 0)
        after = ends[np.minimum(place, max(0, len(ends) - 1))] if len(ends) else np.full(len(inner), n)
        inner = inner[(after - before > _LONG_WORD) & (inner < after)]
        if len(inner):
            all_ends = np.concatenate((ends, inner))
            order = np.argsort(all_ends, kind="stable")
            ends, good = all_ends[order], np.concatenate((good, np.ones(len(inner), bool)))[order]
    cuts, last = [], 0
    for e in ends[good].tolist():
        while e - last > LARGEST_CHUNK:  # as in a line of one word that never cuts
            k = int(np.searchsorted(ends, last + LARGEST_CHUNK))
            if ends[k] >= e:
                break
            last = int(ends[k])
            cuts.append(last)
        if e - last >= LEAST_CHUNK:
            cuts.append(e)
            last = e
    while n - last > LARGEST_CHUNK and (k := int(np.searchsorted(ends, last + LARGEST_CHUNK))) < len(ends) and ends[k] < n:
        last = int(ends[k])
        cuts.append(last)
    if last < n:
        cuts.append(n)
    cuts = np.array(cuts, dtype=np.int64)
    upto = np.searchsorted(ends, cuts, side="right")
    return cuts, np.diff(upto, prepend=0)


class Chunks:
    """The chunks of a block's texts, their windows, and the block's distinct window digests by partition."""

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, partitions: int):
        cuts, words, digests, counts = [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        for t in texts:
            c, w = cut_points(t or b"")
            cuts.append(c)
            words.append(w)
            ends = c.tolist()
            digests += [digest(t[a:b].strip()) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
            counts.append(len(ends))
        self.cuts, self.words = np.concatenate([*cuts, np.zeros(0, np.int64)]), np.concatenate([*words, np.zeros(0, np.int64)])
        self.count = np.array(counts, dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.start, self.end = self._windows()
        self.doc = np.repeat(np.arange(len(texts)), self.count)[self.start]  # of each window
        # a polynomial in the chunks' digests sums up a window
        up, down = np.ones((2, len(digests) + 1), dtype=np.uint64)
        np.cumprod(np.full(len(digests), _BASE, np.uint64), out=up[1:])
        np.cumprod(np.full(len(digests), pow(int(_BASE), -1, 1 << 64), np.uint64), out=down[1:])
        upto = np.zeros(len(digests) + 1, dtype=np.uint64)
        np.cumsum(mix64(np.array(digests, dtype=np.uint64)) * up[:-1], out=upto[1:])
        self.digest = mix64((upto[self.end] - upto[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        earliest = np.argsort(rank[self.doc], kind="stable")  # so that unique takes the earliest document's window
        keys, place, inverse = np.unique(self.digest[earliest], return_index=True, return_inverse=True)
        place, inverse = earliest[place], inverse[np.argsort(earliest)]
        at = spread(keys, partitions)
        order = np.argsort(at, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.keys, self.at, self.of = keys[order], at[order], back[inverse]
        self.holder = self.doc[place][order]  # the earliest document of the block with it
        self.several = np.zeros(len(keys), dtype=bool)
        self.several[self.of[self.doc != self.holder[self.of]]] = True

    def _windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the shortest runs of chunks with ``LEAST_WORDS`` words from and up to each chunk, ascending."""
        n, last = len(self.cuts), np.repeat(self.first + self.count, self.count)
        words = np.concatenate(([0], np.cumsum(self.words)))
        start, end = np.arange(n), np.searchsorted(words, words[:-1] + LEAST_WORDS)
        ok = end <= last
        start, end = start[ok], end[ok]
        back = np.searchsorted(words, words[1:] - LEAST_WORDS, side="right") - 1
        ok = back >= np.repeat(self.first, self.count)
        both = np.unique(np.concatenate((start * (n + 1) + end, back[ok] * (n + 1) + np.arange(1, n + 1)[ok])))
        return both // (n + 1), both % (n + 1)


_ASK = "p int, block long, keys binary, holders binary, several binary"
_TOLD = "block long, p int, answer binary"


def _asker(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = load_block(data.as_py())
                ids = _ids(table)
                chunks = Chunks(encoded(table.column("text").combine_chunks()), ids, partitions)
                ids = ids[chunks.holder] if len(chunks.holder) else np.zeros(0, np.int64)
                rows = [(p, block, chunks.keys[a:b].tobytes(), ids[a:b].tobytes(), chunks.several[a:b].tobytes()) for p, a, b in runs_of(chunks.at)]
                if rows:
                    p, b, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(b, pa.int64()), *[pa.array(x, pa.binary()) for x in rest]], ["p", "block", "keys", "holders", "several"])

    return run


_NO_ID = np.iinfo(np.int64).max  # comes last


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asking block: which of its digests are in several documents, and the earliest's block and doc_id."""

    def close(p: int, asked: list[dict]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in asked])
        holder = np.concatenate([np.frombuffer(r["holders"], "<i8") for r in asked])
        several = np.concatenate([np.frombuffer(r["several"], "?") for r in asked])
        size = np.array([len(r["keys"]) // 8 for r in asked])
        block = np.repeat(np.array([r["block"] for r in asked]), size)
        earliest = np.argsort(holder, kind="stable")  # blocks come in order
        _, place, inverse, n = np.unique(keys[earliest], return_index=True, return_inverse=True, return_counts=True)
        place, inverse = earliest[place], inverse[np.argsort(earliest)]
        n = n + (np.bincount(inverse, weights=several) > 0)
        some = n[inverse] > 1
        out, end = [], 0
        for r, k in zip(asked, size.tolist(), strict=True):
            mine = np.flatnonzero(some[end : end + k])
            at = place[inverse[end : end + k][mine]]
            end += k
            if len(mine):
                out.append((r["block"], p, mine.astype("<u4").tobytes() + block[at].astype("<i8").tobytes() + holder[at].tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "p", "answer"])

    now, asked = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["p"] != now and asked:
                yield close(now, asked)
                asked = []
            now = row["p"]
            asked.append(row)
    if asked:
        yield close(now, asked)


def _passages(block: int, table: pa.Table, answers: list[tuple[int, bytes]], partitions: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, start, end, words, keeper) of the repeated passages of a block, in bytes; keeper is the first window's."""
    c = Chunks(encoded(table.column("text").combine_chunks()), _ids(table), partitions)
    first = {p: a for p, a, _ in runs_of(c.at)}
    repeated, keeper, elsewhere = np.zeros(len(c.keys), bool), np.full(len(c.keys), _NO_ID), np.zeros(len(c.keys), bool)
    for p, data in answers:
        n = len(data) // 20
        at = np.frombuffer(data, "<u4", n).astype(np.int64) + first[p]
        repeated[at] = True
        elsewhere[at] = np.frombuffer(data, "<i8", n, 4 * n) != block
        keeper[at] = np.frombuffer(data, "<i8", n, 12 * n)
    # an occurrence is a repeat unless its own document is the first of all
    again = repeated[c.of] & (elsewhere[c.of] | (c.holder[c.of] != c.doc))
    text = np.repeat(np.arange(len(c.count)), c.count)
    held: list[int] = []

    def passage(a: int, b: int, k: int) -> tuple[int, int, int, int, int]:
        start = int(c.cuts[a - 1]) if a > c.first[text[a]] else 0
        return int(text[a]), start, int(c.cuts[b - 1]), int(c.words[a:b].sum()), int(keeper[c.of[k]])

    for k in np.flatnonzero(again).tolist():
        a, b = int(c.start[k]), int(c.end[k])
        if held and a < held[1]:
            held[1] = max(held[1], b)
        else:
            if held:
                yield passage(*held)
            held = [a, b, k]
    if held:
        yield passage(*held)


def _joined(docs: DataFrame) -> tuple[DataFrame, int]:
    blocks, size = store_blocks(docs)
    partitions = key_partitions(size)
    asks = blocks.select("block", "data").mapInArrow(_asker(partitions), _ASK)
    told = materialise(asks.repartition("p").sortWithinPartitions("p", "block").mapInArrow(_answer, _TOLD), "repeats")
    return meet(told, blocks), partitions


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_id): each repeated passage, in code points, and the document that keeps it."""
    joined, partitions = _joined(only(docs, "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, answers in with_answers(batches):
            ids, rows, texts = table.column("doc_id").to_pylist(), [], encoded(table.column("text").combine_chunks())
            for doc, a, b, words, keeper in _passages(block, table, answers, partitions):
                start = len(texts[doc][:a].decode())
                rows.append((ids[doc], start, start + len(texts[doc][a:b].decode()), words, None if keeper == _NO_ID else keeper))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "end", "words", "kept_doc_id"])

    return joined.mapInArrow(run, "doc_id long, start long, end long, words long, kept_doc_id long")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; n_chars follows. Documents of which nothing but white space is left go."""
    names = docs.columns
    joined, partitions = _joined(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, answers in with_answers(batches):
            column = table.column("text").combine_chunks()
            texts, cuts = encoded(column), {}
            for doc, a, b, _, _ in _passages(block, table, answers, partitions):
                cuts.setdefault(doc, []).append((a, b))
            new, keep = [None if t is None else t.decode() for t in texts], np.ones(len(texts), bool)
            for doc, spans in cuts.items():
                left, at = [], 0
                for a, b in spans:
                    left.append(texts[doc][at:a])
                    at = b
                new[doc] = b"".join([*left, texts[doc][at:]]).strip().decode()
                keep[doc] = bool(new[doc])
            table = table.set_column(names.index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in names:
                i = names.index("n_chars")
                was = table.column(i).to_pylist()
                table = table.set_column(i, "n_chars", pa.array([len(new[k]) if k in cuts else v for k, v in enumerate(was)], table.schema.field(i).type))
            yield from table.filter(pa.array(keep)).to_batches()

    return joined.mapInArrow(run, docs.schema)
