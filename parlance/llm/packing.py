"""Pattern packing: few-document length patterns fitted to the histogram by non-negative least squares.

Documents are tokenised once, in tasks. Only the histogram of piece lengths (at most one row for each length up to
the capacity) comes to the driver. There, patterns of up to three length classes that fill a sequence are enumerated,
their repeat counts fitted to the histogram by non-negative least squares and rounded down, and what remains is
packed best-fit, longest first, into the room the patterns left and into new sequences. The plan is a list of runs
"the pieces of length L numbered k to k+n go to the sequences s to s+n at offset o"; its size depends on the number
of lengths and not on the documents. Pieces of a length are numbered without gaps by a distributed running count.

Defined results: a null text is an empty document, whose one token is the end token; a document longer than the
capacity is cut into pieces of exactly the capacity and a rest; equal rows are packed one by one; ties between
pieces of a length fall to row order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from parlance.llm.common import distinct_words, encoded, materialise, only, slices

#: Length classes that patterns are made of. Patterns have at most three documents.
CLASSES = 256
#: Words whose token ids a task remembers.
REMEMBERED = 450_000
#: Bytes of starting numbers that may be broadcast; more go to the pieces by a shuffle.
BROADCAST_BYTES = 32 << 20

PIECES = "part long, place long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"


# ---------------------------------------------------------------------- tokens

_tokenizers: dict[int, tuple[Tokenizer, dict[bytes, bytes]]] = {}


#: Parts of a word of ASCII characters that never share a token: runs of letters, digits, runs of all else.
_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


def _learn(tok: Tokenizer, known: dict[bytes, bytes], missing: list[bytes]) -> None:
    """Token ids of words that are new, put together from those of their parts.

    The parts that are new go to the tokenizer: runs of letters one by one to its model, all others in one line,
    where white space keeps them apart.
    """
    made: dict[bytes, list[bytes]] = {}
    others: dict[bytes, None] = {}
    encode = tok.model.tokenize
    for w in missing:
        if w.isalpha():  # ASCII letters alone
            if w not in known:
                known[w] = array("I", [t.id for t in encode(w.decode())]).tobytes()
            continue
        parts = _PARTS.findall(w) if w.isascii() and b"'" not in w else [w]
        if len(parts) > 1:
            made[w] = parts
        for p in parts:
            if p not in known:
                if p.isalpha():
                    known[p] = array("I", [t.id for t in encode(p.decode())]).tobytes()
                else:
                    others[p] = None
    words = [p.decode() for p in others]
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    enc = tok.encode(" ".join(words), add_special_tokens=False)
    ids = np.array(enc.ids, dtype="<u4")
    cut = np.searchsorted(np.array([o[0] for o in enc.offsets], dtype=np.int64), starts)
    for p, a, b in zip(others, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        known[p] = ids[a:b].tobytes()
    for w, parts in made.items():
        known[w] = b"".join(map(known.__getitem__, parts))


def token_ids(tok: Tokenizer, known: dict[bytes, bytes], texts: list[bytes], end: int) -> Iterator[bytes]:
    """The ids of each text and the end id, as little-endian unsigned 32-bit integers.

    The distinct words of all the texts are looked up once each and their ids dealt out to where they stand.
    """
    tail = int(end).to_bytes(4, "little")
    marked = [i for i, t in enumerate(texts) if b"<|" in t]  # these may name special tokens, for which case matters
    if marked:
        apart = {i: np.array(tok.encode(texts[i].decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for i in marked}
        texts = [b"" if i in apart else t for i, t in enumerate(texts)]
    line = b"\n".join(texts).lower()
    words, of, starts = distinct_words(line)
    missing = [w for w in words if w not in known]
    if len(missing) + len(known) > REMEMBERED:  # what is in use stays, and so do most frequent words
        used = {w: known[w] for w in words if w in known}
        known.clear()
        known.update(used)
    for at in range(0, len(missing), 20_000):
        _learn(tok, known, missing[at : at + 20_000])
    ids_of = list(map(known.__getitem__, words))
    pool = np.frombuffer(b"".join(ids_of), "<u4")
    n = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
    begin, each = (np.cumsum(n) - n)[of], n[of]
    upto = np.cumsum(each)
    ids = pool[np.repeat(begin - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)]
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate(([0], upto))[np.searchsorted(starts, doc_ends)].tolist()
    at = 0
    for i, cut in enumerate(cuts):
        yield (apart[i] if marked and i in apart else ids[at:cut].tobytes()) + tail
        at = cut


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, written: (part, place, doc_id, piece, start, length, ids, ids_crc32).

    ``ids`` is there only with ``keep_ids``. ``place`` numbers the pieces of one length within a part (a task's share of the rows). The tokenizer must
    split at white space and drop it, and between ASCII letters and other ASCII characters than the apostrophe, so
    that a text's ids are those of its words' parts in order.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # on the driver; the file is a parameter of fixed size
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = {n: arrow[t] for n, t in (f.split() for f in PIECES.split(", ")) if keep_ids or n != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value[:1000].encode()) ^ len(shared.value)
        if key not in _tokenizers:
            _tokenizers[key] = (Tokenizer.from_str(shared.value), {})
        tok, known = _tokenizers[key]
        part, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text", 4 << 20):
            doc_ids = batch.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in kinds}
            for doc_id, ids in zip(doc_ids, token_ids(tok, known, [t or b"" for t in encoded(batch.column(1))], end), strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    length = len(cut) // 4
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    for k, v in (("part", part), ("place", place), ("doc_id", doc_id), ("piece", piece), ("start", at // 4), ("length", length), ("ids", cut), ("ids_crc32", zlib.crc32(cut))):
                        if k in kinds:
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return materialise(only(docs, "doc_id", "text").mapInArrow(run, ", ".join(f for f in PIECES.split(", ") if f.split()[0] in kinds)), "pieces")


# ------------------------------------------------------------------------ plan


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least ||a x - b||, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), []
    gain = a.T @ b
    floor = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    for _ in range(rounds):
        free = gain.copy()
        free[active] = -np.inf
        best = int(np.argmax(free)) if len(free) else -1
        if best < 0 or free[best] <= floor:
            break
        active.append(best)
        while True:
            cols = a[:, active]
            z = np.linalg.solve(cols.T @ cols + 1e-9 * np.eye(len(active)), cols.T @ b)
            if z.min(initial=1) > 0:
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            down = z <= 0
            step = np.min(now[down] / np.maximum(now[down] - z[down], 1e-300))
            now = now + step * (z - now)
            x[active] = now
            active = [k for k, v in zip(active, now, strict=True) if v > 1e-12]
            x[[k for k in range(len(x)) if k not in set(active)]] = 0
            if not active:
                break
        gain = a.T @ (b - a @ x)
    return x


def patterns(classes: np.ndarray, units: int, documents: int = 3) -> list[tuple[int, ...]]:
    """Sets of up to ``documents`` of the given classes (in units, ascending) that fill ``units`` but for two at most."""
    have, found = set(classes.tolist()), []
    for n in range(1, documents + 1):
        for head in combinations_with_replacement(classes.tolist(), n - 1):
            for slack in (0, 1, 2):
                rest = units - slack - sum(head)
                if rest in have and (not head or rest >= head[-1]):
                    found.append((*head, rest))
                    break
    return found


class Plan:
    """Runs (length, first, count, sequence, offset) that place all pieces of a histogram."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, dtype=bool)

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.room[room].append((sequence, count))
            self.some[room] = True

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def best_fit(self, length: int, count: int) -> None:
        """Place pieces of one length, each where the least room is left."""
        while count:
            fits = int(np.argmax(self.some[length:])) + length
            if self.some[fits]:
                sequence, n = self.room[fits].pop()
                self.some[fits] = bool(self.room[fits])
                take = min(n, count)
                self.leave(fits, sequence + take, n - take)
                self.place(length, take, sequence, self.capacity - fits)
                self.leave(fits - length, sequence, take)
                count -= take
            else:
                each = self.capacity // length
                full, rest = divmod(count, each)
                for n, times in ((full, each), (1, rest)):
                    if n and times:
                        sequence = self.new(n)
                        for k in range(times):
                            self.place(length, n, sequence, k * length)
                        self.leave(self.capacity - times * length, sequence, n)
                count = 0


def plan_packing(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """A plan for ``histogram`` (length: number of pieces)."""
    plan, left = Plan(capacity), {n: c for n, c in histogram.items() if c}
    width = -(-capacity // classes)
    units = capacity // width
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        if n < capacity and -(-n // width) <= units:
            by_class.setdefault(-(-n // width), []).append(n)
    ids = np.array(sorted(by_class), dtype=np.int64)
    choice = patterns(ids, units)
    if choice:
        matrix = np.zeros((len(ids), len(choice)))
        row = {c: i for i, c in enumerate(ids.tolist())}
        for k, p in enumerate(choice):
            for c in p:
                matrix[row[c], k] += 1
        want = np.array([sum(left[n] for n in by_class[c]) for c in ids.tolist()], dtype=float)
        for k in np.argsort(-(fit := nnls(matrix, want)), kind="stable").tolist():
            times = int(fit[k])
            while times > 0:
                took: list[tuple[int, int]] = []
                for c in set(choice[k]):  # the longest of a class first
                    need = choice[k].count(c)
                    while need and by_class[c]:
                        n = by_class[c][-1]
                        if left[n] == 0:
                            by_class[c].pop()
                            continue
                        each = min(need, left[n])
                        took.append((n, each))
                        need -= each
                        if each == left[n] and need:
                            by_class[c].pop()  # the same length is not looked at twice for one pattern
                    if need:
                        took = []
                        break
                if not took:
                    break
                run = min([times, *(left[n] // each for n, each in took)])
                sequence, offset = plan.new(run), 0
                for n, each in took:
                    for _ in range(each):
                        plan.place(n, run, sequence, offset)
                        offset += n
                    left[n] -= run * each
                    if left[n] and n not in by_class[-(-n // width)]:
                        by_class[-(-n // width)].append(n)
                plan.leave(capacity - offset, sequence, run)
                times -= run
    for n in sorted(left, reverse=True):
        if left[n]:
            plan.best_fit(n, left[n])
    return plan


# ------------------------------------------------------------------------ pack


def assign(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (written; part, place, length and any columns) plus sequence_id and offset.

    A part's starting numbers, one for each length that it has, are broadcast while those of all parts together are
    under ``BROADCAST_BYTES``; beyond, they are sent to where the part's pieces are.
    """
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(runs)  # its size follows the number of lengths
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    listed = F.array_sort(F.collect_list(F.struct("length", "start")))
    starts = materialise(starts.groupBy("part").agg(listed.alias("s")).select("part", F.col("s.length").alias("_lengths"), F.col("s.start").alias("_starts")), "starts")
    few = 16 * (starts.agg(F.sum(F.size("_lengths"))).head()[0] or 0) <= BROADCAST_BYTES
    columns = pieces.columns
    key = (runs[:, 0] << 44) + runs[:, 1]

    def places(number: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces that have these numbers among all of their length."""
        runs = shared.value
        at = np.searchsorted(key, (length << 44) + number, side="right") - 1
        return runs[at, 3] + number - runs[at, 1], runs[at, 4]

    def numbers(part: np.ndarray, place: np.ndarray, length: np.ndarray, of: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        number = place.copy()
        for p in np.unique(part).tolist():
            mine = part == p
            lengths, begin = of[p]
            number[mine] += begin[np.searchsorted(lengths, length[mine])]
        return number

    if few:
        known = spark.sparkContext.broadcast({p: (np.array(n), np.array(at)) for p, n, at in (r for r in starts.collect())})

        @F.pandas_udf("sequence_id long, offset long")  # of three numbers: the ids stay where they are
        def placed(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for part, place, length in parts:
                size = length.to_numpy()
                sequence, offset = places(numbers(part.to_numpy(), place.to_numpy(), size, known.value), size)
                yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

        return pieces.withColumn("_at", placed("part", "place", "length")).select(*columns, "_at.sequence_id", "_at.offset")
    rows = pieces.withColumn("_kind", F.lit(1)).unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition("part").sortWithinPartitions("part", "_kind").drop("_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            heads = batch.filter(batch.column("_lengths").is_valid())
            of |= {p: (np.array(n), np.array(at)) for p, n, at in zip(*(heads.column(c).to_pylist() for c in ("part", "_lengths", "_starts")), strict=True)}
            batch = batch.filter(batch.column("_lengths").is_null())
            part, place, length = (batch.column(c).to_numpy() for c in ("part", "place", "length"))
            sequence, offset = places(numbers(part, place, length, of), length)
            if len(part):
                of = {int(part[-1]): of[int(part[-1])]} | {p: v for p, v in of.items() if p not in set(part.tolist())}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """All pieces of ``docs`` with their ids, sequence_id and offset; a sequence is its pieces in order of offset."""
    return assign(tokenised(docs, tokenizer_path, capacity, end), capacity).drop("part", "place")
