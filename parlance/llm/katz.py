"""Katz backoff: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

A bigram's probability is its discounted count over its context's, or else the context's backoff weight times the
word's own probability; a word's own is its discounted count over all, and what the discounts free is the share of
unseen words, which are one class: each unseen word has that whole share. Words and pairs are counted over all
training documents, and every pair that occurs has its discounted entry.

The texts are stored as blocks of some megabytes. Counting and looking up are one shuffle for words and one for
pairs, of what is distinct in a block and not of tokens: a block asks each partition of a table for the words (pairs)
it holds, with its own counts of them, and the partition answers with the totals in the order asked. Words are
answered first. That numbers them, so that a pair is two small numbers and not two hashes, and tells a block each
word's total, which it sends along with the pairs that end in the word. So the partition that holds a context's pairs
sums up what the context's backoff weight needs, and no table of pairs is written or joined. Contexts that are too
frequent for one partition are dealt over several by their second words; their sums are few and are broadcast.

Blocks and partitions grow with the root of the text's size (see ``blocks``), so that a question keeps its length
while questions are sent from every block to every partition; a task's memory then grows with that root.

Defined results: a null text is an empty document, which is one end token; a text begins after a start mark that is
no token; a long text is cut at white space to pieces of some ``PIECE_BYTES``, which changes no result; with no
training rows every word is unseen and has probability 1; a null doc_id is kept; equal rows are scored and counted
each; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import grown
from parlance.llm.common import encoded, hash_words, materialise, mix64, slices

#: Bytes of text in a block, and of all text for each partition of words and of pairs.
BLOCK_BYTES = 4 << 20
WORD_PARTITION_BYTES = 16 << 20
PAIR_PARTITION_BYTES = 4 << 20
#: A longer text is cut to pieces.
PIECE_BYTES = 1 << 20
#: Counts up to this one are discounted.
DISCOUNTED = 5

_U = np.uint64
END, START = _U(0x5BD1E995A3C59AC3), _U(0x27D4EB2F165667C5)

_BLOCKS = "block long, rows binary, doc_ids binary, flags binary, before binary, sizes binary, text binary"
_ASKS = "p int, block long, data binary"
_TOLD = "kind int, p int, block long, answer binary, k long, n array<long>, own double"
_ANSWER, _TOTALS, _FREQUENT = 0, 1, 2
#: Bits of a piece's flags.
_NULL_ID, _TRAIN, _LAST, _CUT = 1, 2, 4, 8
_GAP = re.compile(rb"[\t-\r ]")


# ---------------------------------------------------------------------- bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each in the fewest bytes that hold its largest, lowest bytes first."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        out.append(struct.pack("<IB", len(a), width) + a.view("u1").reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = struct.unpack_from("<IB", data, at)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += 5 + n * width
    return out


def _deltas(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def _groups(at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    heads = _heads(at)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
        yield int(at[a]), a, b


def _heads(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), arrow[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --------------------------------------------------------------------- blocks


def _pieces(text: bytes) -> Iterator[tuple[bytes, np.uint64, bool]]:
    """(piece, hash of the word before it, whether it is the last) of a text, cut at white space."""
    at, before = 0, START
    while len(text) - at > PIECE_BYTES:
        gap = _GAP.search(text, at + PIECE_BYTES)
        if not gap:
            break
        piece = text[at : gap.start()]
        yield piece, before, False
        words = hash_words(piece)[0]
        at, before = gap.start(), words[-1] if len(words) else before
    yield text[at:], before, True


def _as_blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        held: list[tuple] = []
        size, number, row = 0, 0, 0

        def block() -> pa.RecordBatch:
            rows, ids, flags, before, texts = zip(*held, strict=True)
            data = [np.array(rows, "<i8"), np.array([i or 0 for i in ids], "<i8"), np.array(flags, "u1"), np.array(before, "<u8"), np.array([len(t) for t in texts], "<i8")]
            return _batch(_BLOCKS, [((part << 32) + number, *[x.tobytes() for x in data], squeeze.compress(b"\n".join(texts)))])

        for batch in slices(batches):
            for doc, text, train in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for piece, before, last in _pieces(text or b""):
                    flags = _NULL_ID * (doc is None) + _TRAIN * train + _LAST * last + _CUT * (not last or before != START)
                    held.append(((part << 40) + row, doc, flags, before, piece))
                    size += len(piece)
                    if size >= limit:
                        yield block()
                        held, size, number = [], 0, number + 1
                row += 1
        if held:
            yield block()

    return run


class Tokens:
    """The tokens of a block, as places in its sorted distinct words, and the words before them."""

    def __init__(self, row: dict):
        size, self.flags = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["flags"], "u1")
        before = np.frombuffer(row["before"], "<u8")
        hashes, starts, _ = hash_words(zstandard.ZstdDecompressor().decompress(row["text"]))
        piece = (np.searchsorted(np.cumsum(size + 1) - size - 1, starts, side="right") - 1).astype(np.int32)
        last = (self.flags & _LAST > 0).astype(np.int64)
        count = np.bincount(piece, minlength=len(size)) + last
        word = np.full(count.sum(), END)
        word[np.arange(len(hashes)) + (np.cumsum(last) - last)[piece]] = hashes
        del hashes, starts
        self.piece = np.repeat(np.arange(len(size), dtype=np.int32), count)
        self.train = (self.flags & _TRAIN > 0)[self.piece]
        # hashes are uniform, so that partitions are their ranges, and sorted words are sorted by partition
        self.words, inverse = np.unique(np.concatenate((word, before[before != START])), return_inverse=True)
        self.word = inverse[: len(word)].astype(np.int32)
        ahead = np.full(len(size), len(self.words), np.int32)  # the start's place is after all words
        ahead[before != START] = inverse[len(word) :]
        self.before = np.concatenate((self.word[:1], self.word[:-1]))
        first = np.cumsum(count) - count
        self.before[first[count > 0]] = ahead[count > 0]


def _word_partition(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(partitions)) >> _U(32)).astype(np.int64)


class Pairs:
    """The distinct pairs of a block in the order in which they are asked for."""

    def __init__(self, t: Tokens, ids: np.ndarray, table: Table):
        width = len(t.words) + 1
        distinct, inverse = np.unique(t.before.astype(np.int64) * width + t.word, return_inverse=True)
        first, second = np.divmod(distinct, width)
        del distinct
        one, two = np.append(ids, _U(table.ids))[first], ids[second]
        at = (one.astype(np.float64) * (table.partitions / (table.ids + 1))).astype(np.int64)
        place = np.minimum(np.searchsorted(table.frequent, one), len(table.frequent) - 1)
        shares = np.where(table.frequent[place] == one, table.shares[place], 1).astype(np.uint64)
        at = (at + (mix64(two + _U(1)) % shares).astype(np.int64)) % table.partitions
        order = np.argsort(at, kind="stable")
        self.at, self.first, self.second, self.one, self.two = at[order], first[order], second[order], one[order], two[order]
        turned = np.empty(len(order), np.int32)
        turned[order] = np.arange(len(order), dtype=np.int32)
        self.of = turned[inverse]


class Table:
    """Where pairs are: how many words have a number, and the contexts (the start mark among them) that are dealt."""

    def __init__(self, ids: int, partitions: int, frequent: np.ndarray, shares: np.ndarray):
        if ids >= 1 << 32:
            raise ValueError(f"{ids} distinct words: a pair of them has no 64-bit key")
        self.ids, self.partitions, self.frequent, self.shares = ids, partitions, frequent, shares


# ---------------------------------------------------------------------- asking


def _ask_words(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block in memory at a time
                row = batch.slice(i, 1).to_pylist()[0]
                t = Tokens(row)
                seen = np.bincount(t.word, weights=t.train, minlength=len(t.words)).astype(np.uint64)
                other = np.bincount(t.word, weights=~t.train, minlength=len(t.words)).astype(np.uint64)
                groups = _groups(_word_partition(t.words, partitions))
                yield _batch(_ASKS, [(p, row["block"], pack(t.words[a:b], seen[a:b], other[a:b])) for p, a, b in groups])

    return run


def _answer_words(often: int):
    """Totals, numbers and words that at least ``often`` tokens are, for each partition of words."""

    def close(p: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(data) for _, data in asked]
        words, seen, other = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, inverse = np.unique(words, return_inverse=True)
        total = np.bincount(inverse, weights=seen).astype(np.int64)
        tokens = total + np.bincount(inverse, weights=other).astype(np.int64)
        yield _batch(_TOLD, [(_TOTALS, p, None, None, len(distinct), _tally(total), None)])
        yield _batch(_TOLD, [(_FREQUENT, p, None, None, i, [int(tokens[i])], None) for i in np.flatnonzero(tokens >= often).tolist()])
        ends = np.cumsum([len(x[0]) for x in parts]).tolist()
        yield _batch(_TOLD, [(_ANSWER, p, block, pack(_deltas(inverse[a:b]), total[inverse[a:b]]), None, None, None) for (block, _), a, b in zip(asked, [0, *ends[:-1]], ends, strict=True)])

    return _by_partition(close)


def _tally(total: np.ndarray) -> list[int]:
    """Kinds and tokens, and how many kinds were seen 1, 2 ... times."""
    return [np.count_nonzero(total), int(total.sum()), *np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()]


def _by_partition(close):
    """Runs ``close`` over each partition's questions in sorted (p, block, data) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for p, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now and asked:
                    yield from close(now, asked)
                    asked = []
                now = p
                asked.append((block, data))
        if asked:
            yield from close(now, asked)

    return run


class Answers:
    """What a block was told of its words (totals and numbers), and of its pairs (totals, and sums of their contexts)."""

    def __init__(self):
        self.words: list[tuple[int, bytes]] = []
        self.pairs: list[bytes] = []

    def of_words(self, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [(p, *unpack(data)) for p, data in self.words]
        ids = np.concatenate([_U(bases[p]) + np.cumsum(steps) for p, steps, _ in each])
        return ids, np.concatenate([total for *_, total in each]).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Answers]]:
    """Each block and what it was told, from rows sorted by block, kind (words, pairs, the block) and partition."""
    told = Answers()
    for batch in batches:
        for i, kind in enumerate(batch.column("kind").to_pylist()):
            row = batch.slice(i, 1).to_pylist()[0]
            if kind == 0:
                told.words.append((row["p"], row["text"]))
            elif kind == 1:
                told.pairs.append(row["text"])
            else:
                yield row, told
                told = Answers()


def _ask_pairs(bases, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, told in _met(batches):
            t = Tokens(row)
            ids, total = told.of_words(bases.value)
            pairs = Pairs(t, ids, table.value)
            counts = np.bincount(pairs.of, weights=t.train, minlength=len(pairs.at)).astype(np.uint64)
            total = total[pairs.second]
            asks = []
            for p, a, b in _groups(pairs.at):
                heads = _heads(pairs.one[a:b])
                steps = _deltas(pairs.two[a:b])
                steps[heads] = pairs.two[a:b][heads]
                asks.append((p, row["block"], pack(_deltas(pairs.one[a:b][heads]), np.diff(heads, append=b - a), steps, counts[a:b], total[a:b])))
            yield _batch(_ASKS, asks)

    return run


def _answer_pairs(d: Discounts, table):
    """Totals of pairs and what the backoff weights of their contexts are made of, for each partition of pairs."""

    def close(p: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        width, frequent = _U(table.value.ids + 1), table.value.frequent
        keys, counts, ends_in, contexts, runs = [], [], [], [], []
        for _, data in asked:
            heads, run, steps, count, total = unpack(data)
            heads, run = np.cumsum(heads), run.astype(np.int64)
            starts = np.cumsum(run) - run
            so_far = np.cumsum(steps)
            keys.append(np.repeat(heads * width - so_far[starts] + steps[starts], run) + so_far)
            counts.append(count)
            ends_in.append(total)
            contexts.append(heads)
            runs.append(run)
        sizes = [len(x) for x in keys]
        distinct, place, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        del keys
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        first = distinct // width
        del distinct
        own = np.where(total > 0, d.own(np.concatenate(ends_in)[place].astype(np.int64)), 0.0)
        heads = _heads(first)
        sums = [np.add.reduceat((total == r).astype(np.int64), heads) for r in range(1, DISCOUNTED + 1)]
        sums.append(np.add.reduceat(np.where(total > DISCOUNTED, total, 0), heads))
        own, first = np.add.reduceat(own, heads), first[heads]
        yield _batch(_TOLD, [(_TOTALS, p, None, None, None, _tally(total), None)])
        dealt = np.flatnonzero(np.isin(first, frequent)).tolist()
        yield _batch(_TOLD, [(_FREQUENT, p, None, None, int(first[i]), [int(s[i]) for s in sums], float(own[i])) for i in dealt])
        rows, at = [], 0
        for (block, _), size, context, run in zip(asked, sizes, contexts, runs, strict=True):
            reply = total[inverse[at : at + size]]
            at += size
            of = np.searchsorted(first, context)
            backs_off = np.minimum.reduceat(reply, np.cumsum(run) - run) == 0
            rows.append((_ANSWER, p, block, pack(reply, *[s[of] for s in sums], own[of[backs_off]].view(np.uint64)), None, None, None))
        yield _batch(_TOLD, rows)

    return _by_partition(close)


# ------------------------------------------------------------------- discounts


def good_turing(many: dict[int, int], k: int = DISCOUNTED) -> list[float]:
    """Discounts of the counts 1 to k from the numbers of n-grams seen 1 to k+1 times.

    Where these don't fall as Good and Turing's estimate needs, half a count is taken off instead.
    """
    if not many.get(1):
        return [1.0] * k
    top = (k + 1) * many.get(k + 1, 0) / many[1]
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * many.get(r + 1, 0) / (r * many[r]) - top) / (1 - top) if many.get(r) and top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after discounting; 0 stays 0."""
    by = np.array([0.0, *[r * x for r, x in enumerate(d, 1)]])
    return np.where(count <= DISCOUNTED, by[np.minimum(count, DISCOUNTED)], count)


class Discounts:
    """What all scoring needs to know of all words: a few numbers."""

    def __init__(self, tally: list[int]):
        self.types, self.tokens = tally[:2]
        words = dict(enumerate(tally[2:], 1))
        self.word = good_turing(words)
        freed = sum(words[r] * r * (1 - self.word[r - 1]) for r in range(1, DISCOUNTED + 1))
        self.scale = 1.0 / self.tokens if freed > 0 else 1.0 / (self.tokens + 1)
        self.unseen = freed / self.tokens if freed > 0 else 1.0 / (self.tokens + 1)

    def own(self, total: np.ndarray) -> np.ndarray:
        """The probability of a word with this total by itself."""
        return np.where(total > 0, discounted(total, self.word) * self.scale, self.unseen)


def _tallied(told: DataFrame) -> list[int]:
    each = [F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(DISCOUNTED + 3)]
    return list(told.where(F.col("kind") == _TOTALS).agg(*each).head())


# ---------------------------------------------------------------------- scores

_SCORES = "row long, cut boolean, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(d: Discounts, pair: list[float], bases, table, dealt):
    """``dealt``: the numbers of the dealt contexts, what their pairs were counted (a row for each) and own sums."""
    by = np.array([*[r * x for r, x in enumerate(pair, 1)], 1.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, told in _met(batches):
            t = Tokens(row)
            ids, total = told.of_words(bases.value)
            pairs = Pairs(t, ids, table.value)
            n, kept, own = [], [], []
            for data, (_, a, b) in zip(told.pairs, _groups(pairs.at), strict=True):
                reply, *sums, backed = unpack(data)
                heads = _heads(pairs.one[a:b])
                mass, share = by @ np.stack(sums).astype(np.float64), np.zeros(len(heads))
                share[np.minimum.reduceat(reply, heads) == 0] = backed.view(np.float64)
                known, at = dealt.value[0], pairs.one[a:b][heads]
                if len(known):
                    place = np.minimum(np.searchsorted(known, at), len(known) - 1)
                    here = known[place] == at
                    mass, share = np.where(here, dealt.value[1][place] @ by, mass), np.where(here, dealt.value[2][place], share)
                size = np.diff(heads, append=b - a)
                n.append(reply.astype(np.int64))
                kept.append(np.repeat(mass, size))
                own.append(np.repeat(share, size))
            n, kept, own = (np.concatenate(x) for x in (n, kept, own))
            ends = np.searchsorted(t.words, END)  # as many starts as ends
            ends = total[ends] if ends < len(total) and t.words[ends] == END else 0
            of = np.append(total, ends)[pairs.first]
            of = of + (kept >= of - 1e-6)  # some must be left
            backed = np.log10((1 - kept / of) / (1 - own)) + np.log10(d.own(total))[pairs.second]
            entry = np.log10(np.maximum(discounted(n, pair), 1e-300) / of)
            score = np.where(n > 0, entry, backed)[pairs.of]
            known = total[t.word]
            base = np.log10((known + 1) / (d.tokens + d.types + 1))
            add = lambda v: np.bincount(t.piece, weights=v, minlength=len(t.flags))
            flag = lambda bit: t.flags & bit > 0
            whole = lambda v: pa.array(add(v).astype(np.int64))
            columns = [pa.array(np.frombuffer(row["rows"], "<i8")), pa.array(flag(_CUT)), pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=flag(_NULL_ID)), pa.array(flag(_TRAIN))]
            columns += [whole(np.ones(len(t.word))), whole(known > 0), pa.array(add(base)), pa.array(add(score))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORES.split(", ")])

    return run


def katz_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for (doc_id, text, train) rows.

    ``train`` says whether to learn from a row. ``score`` is the log10 probability of the whole text and its end;
    ``base_score`` that under word counts with one added to each; ``n_known`` counts tokens seen in training.
    """
    rows = docs.select(docs["doc_id"], docs["text"], F.coalesce(docs["train"], F.lit(False)).alias("train"))
    text = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = materialise(rows.mapInArrow(_as_blocks(grown(BLOCK_BYTES, text)), _BLOCKS), "katz-blocks")
    share = blocks.sparkSession.sparkContext.broadcast

    def answered(asks: DataFrame, answer) -> DataFrame:
        return materialise(asks.repartition("p").sortWithinPartitions("p", "block").mapInArrow(answer, _TOLD), "katz-told", "kind")

    def meet(*told: DataFrame) -> DataFrame:
        """The blocks and their answers, in tasks of whole blocks."""
        all_of = blocks.withColumns({"kind": F.lit(2), "p": F.lit(0)})
        for kind, df in enumerate(told):
            all_of = all_of.unionByName(df.where(F.col("kind") == _ANSWER).select("block", F.lit(kind).alias("kind"), "p", F.col("answer").alias("text")), allowMissingColumns=True)
        return all_of.repartition("block").sortWithinPartitions("block", "kind", "p")

    # words: numbers, totals and discounts
    partitions = max(8, text // grown(PAIR_PARTITION_BYTES, text))
    word_partitions = max(8, text // grown(WORD_PARTITION_BYTES, text))
    often = max(1000, text // (8 * partitions))  # more tokens than a partition has, if words take 8 bytes
    words = answered(blocks.mapInArrow(_ask_words(word_partitions), _ASKS), _answer_words(often))
    d = Discounts(_tallied(words))
    bases = np.zeros(word_partitions + 1, np.int64)
    for r in words.where(F.col("kind") == _TOTALS).select("p", "k").collect():  # one row for each partition
        bases[r.p + 1] = r.k
    bases = np.cumsum(bases)
    frequent = words.where(F.col("kind") == _FREQUENT).select("p", "k", F.col("n")[0].alias("n")).collect()  # few: each has a partition's worth of tokens
    dealt = sorted([(int(bases[r.p]) + r.k, min(partitions, 1 + 2 * r.n // often)) for r in frequent] + [(int(bases[-1]), partitions)])
    table = Table(int(bases[-1]), partitions, *(np.array(x, np.uint64) for x in zip(*dealt, strict=True)))
    bases, table = share(bases), share(table)

    # pairs: totals, and sums of their contexts
    pairs = answered(meet(words).mapInArrow(_ask_pairs(bases, table), _ASKS), _answer_pairs(d, table))
    pair = good_turing(dict(enumerate(_tallied(pairs)[2:], 1)))
    each = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 1)]
    sums = pairs.where(F.col("kind") == _FREQUENT).groupBy("k").agg(*each, F.sum("own").alias("own")).orderBy("k").collect()
    known = [np.array([r.k for r in sums], np.uint64), np.array([r[1:-1] for r in sums], np.float64).reshape(-1, DISCOUNTED + 1), np.array([r.own for r in sums])]

    scored = materialise(meet(words, pairs).mapInArrow(_score(d, pair, bases, table, share(known)), _SCORES), "katz-scores")
    joined = scored.where("cut").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    found = scored.where("not cut").drop("cut").unionByName(joined)
    return found.select("doc_id", "train", "n_tokens", "n_known", F.lit(d.tokens).cast("long").alias("train_tokens"), "base_score", "score")
