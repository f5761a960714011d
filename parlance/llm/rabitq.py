"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is reranked.

A unit vector o is turned by a random rotation and coded by the signs of its coordinates, one bit each, packed in
words of 64. With x the corner of the sphere that the signs point to, <x, o> is kept as the correction scalar. A
query is turned likewise and its coordinates rounded to ``LEVELS`` levels, so that <x, q> is a sum of counts of bits
that the code shares with the query's bit planes. The inner product with o is estimated as <x, q> / <x, o>; its error
is that of a random direction orthogonal to o, and of rounding: it exceeds ``epsilon`` * sqrt((1 - <x, o>**2) / (D - 1)
+ step**2 / 12) / <x, o> with the chance that a normal deviate exceeds epsilon. Only a vector whose estimate plus this
bound reaches the k-th best exact score so far is compared exactly, in double precision.

Every row is coded; nothing is fitted to the data. The queries are a stated set, broadcast in blocks of ``QUERY_ROWS``
against all codes; a task keeps k results for each query, and these partial results are ranked once more. Codes and
vectors stand side by side: one vector in some ten reaches a query's bound, so that a block's queries need all.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those of another than the
commonest length, take no part, neither as queries nor as candidates; equal rows are rows of their own, and a query's
own row alone is left out; ties go to the smaller vec_id, null last; fewer candidates give fewer results; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import materialise, popcount

#: Queries that are broadcast at a time; queries and codes that a task looks at together.
QUERY_ROWS = 16384
SLICE_ROWS = 256
CODE_ROWS = 2048
#: Standard errors by which an estimate may be too low.
EPSILON = 2.5
#: Levels of a query's coordinates: bit planes by the power of two.
PLANES = 4
LEVELS = 1 << PLANES

_INDEX = "rid long, vec_id long, code binary, correction double, vector binary"
_FOUND = "query_rid long, query_id long, vec_id long, score double"


def rotation(size: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def build_index(vectors: DataFrame, seed: int = 42) -> tuple[DataFrame, int]:
    """(rid, vec_id, code, correction, vector) of every usable row of (vec_id, embedding), written; and the length."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = usable.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 1
    turn = rotation(size, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(n, size)
            scaled = v / np.abs(v).max(axis=1, keepdims=True)
            turned = scaled / np.linalg.norm(scaled, axis=1, keepdims=True) @ turn
            bits = packed(turned > 0)
            correction = np.abs(turned).sum(axis=1) / np.sqrt(size)
            rid = (part << 33) + number + np.arange(n)
            number += n
            yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(correction), pa.array([x.tobytes() for x in v], pa.binary())], ["rid", "vec_id", "code", "correction", "vector"])

    return materialise(usable.where(F.size("embedding") == size).mapInArrow(code, _INDEX), "codes"), size


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, size = bits.shape
    padded = np.zeros((n, -(-size // 64) * 64), dtype=np.uint8)
    padded[:, :size] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Rounded:
    """Turned queries on equal levels, as bit planes; gives estimates from counts of shared bits."""

    def __init__(self, turned: np.ndarray):
        self.size = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-12) / (LEVELS - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [packed(level >> j & 1) for j in range(PLANES)]
        self.all = level.sum(axis=1, dtype=np.int64)

    def estimates(self, some: slice, codes: np.ndarray, ones: np.ndarray, correction: np.ndarray) -> np.ndarray:
        shared = np.zeros((len(self.low[some]), len(codes)), dtype=np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                shared += popcount(plane[some, w, None] & codes[None, :, w]).astype(np.int32) << j
        low, step, all_ = (x[some, None] for x in (self.low, self.step, self.all))
        inner = 2 * low * ones + 2 * step * shared - low * self.size - step * all_
        return inner / (np.sqrt(self.size) * correction)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Best:
    """The k best candidates of each query so far, by exact score and vec_id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < self.k
        query, score, vec_id, first = query[top], score[top], vec_id[top], first[top]
        own = np.unique(query)
        place = np.arange(len(query)) - np.searchsorted(query, query)
        new_score, new_id = np.full((len(own), self.k), -np.inf), np.full((len(own), self.k), np.iinfo(np.int64).max)
        at = np.searchsorted(own, query)
        new_score[at, place], new_id[at, place] = score, vec_id
        both_score, both_id = np.hstack((self.score[own], new_score)), np.hstack((self.id[own], new_id))
        order = np.lexsort((both_id, -both_score), axis=1)[:, : self.k]
        self.score[own], self.id[own] = np.take_along_axis(both_score, order, 1), np.take_along_axis(both_id, order, 1)


_NO_ID = np.iinfo(np.int64).max - 1


def _search(index: DataFrame, size: int, queries: list, k: int, epsilon: float, seed: int) -> DataFrame:
    q = np.frombuffer(b"".join(r.vector for r in queries), dtype=float).reshape(-1, size)
    shared = index.sparkSession.sparkContext.broadcast((np.array([r.rid for r in queries]), [r.vec_id for r in queries], q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, ids, q = shared.value
        unit = _unit(q)
        rounded = Rounded(unit @ rotation(size, seed))
        order = np.argsort(rids)
        best = Best(len(q), k)
        for whole in batches:
            for at in range(0, whole.num_rows, CODE_ROWS):
                batch = whole.slice(at, CODE_ROWS)
                rid, correction = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                vec_id = batch.column(1).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(len(rid), -1)
                units = _unit(np.frombuffer(b"".join(batch.column(4).to_pylist()), float).reshape(len(rid), size))
                ones = popcount(codes).sum(axis=1, dtype=np.int64)
                spread = (1 - correction**2).clip(0) / max(1, size - 1)
                place = order[np.minimum(np.searchsorted(rids, rid, sorter=order), len(rids) - 1)]
                own_code = np.flatnonzero(rids[place] == rid)  # queries among these rows
                own_query = place[own_code]
                for a in range(0, len(q), SLICE_ROWS):
                    some = slice(a, a + SLICE_ROWS)
                    bound = epsilon * np.sqrt(spread + rounded.step[some, None] ** 2 / 12) / correction
                    upper = rounded.estimates(some, codes, ones, correction) + bound
                    mine = (own_query >= a) & (own_query < a + SLICE_ROWS)
                    upper[own_query[mine] - a, own_code[mine]] = -np.inf
                    if not np.isfinite(best.score[some, -1]).all():  # at first, the best estimates give a score to reach
                        top = min(k, len(rid))
                        first = np.argpartition(-upper, top - 1, axis=1)[:, :top]
                        rows, cols = np.repeat(np.arange(len(upper)), top), first.ravel()
                        free = upper[rows, cols] > -np.inf
                        _rerank(best, unit, units, a + rows[free], cols[free], vec_id)
                        upper[rows, cols] = -np.inf
                    rows, cols = np.nonzero((upper >= best.score[some, -1:]) & (upper > -np.inf))
                    for b in range(0, len(rows), 1 << 17):
                        _rerank(best, unit, units, a + rows[b : b + (1 << 17)], cols[b : b + (1 << 17)], vec_id)
        got = np.isfinite(best.score)
        rows = np.nonzero(got)[0]
        found = best.id[got]
        yield pa.RecordBatch.from_arrays([pa.array(rids[rows]), pa.array([ids[i] for i in rows.tolist()], pa.int64()), pa.array(found, mask=found == _NO_ID), pa.array(best.score[got])], ["query_rid", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, _FOUND)


def _rerank(best: Best, unit: np.ndarray, units: np.ndarray, rows: np.ndarray, cols: np.ndarray, vec_id: np.ndarray) -> None:
    if len(rows):
        best.add(rows, (unit[rows] * units[cols]).sum(axis=1), vec_id[cols])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, epsilon: float = EPSILON, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of each row for which ``is_query`` holds.

    ``is_query`` is a condition on the column vec_id.
    """
    index, size = build_index(vectors, seed)
    asked = index.where(is_query).select("rid", "vec_id", "vector")
    parts = -(-asked.count() // QUERY_ROWS)
    out = None
    for p in range(parts):
        block = asked.where(F.pmod(F.xxhash64("rid"), F.lit(parts)) == p).collect()
        if block:
            found = _search(index, size, block, k, epsilon, seed)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
