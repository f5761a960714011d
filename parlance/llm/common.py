"""Helpers that several training-data operators share.

Everything here is either a DataFrame expression or a small numpy routine that
runs inside a task on one bounded slice of text.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass looks at; a longer text is walked in such pieces.
PIECE_BYTES = 1 << 20
#: Rows that go to and from Python together while a table is written; rows with texts are some kilobytes each.
ARROW_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


# ----------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, an own one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "parlance-shared")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/parlance/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and lost executors cost nothing.

    ``by`` names a column of few values whose rows go to folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._parlance_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no unfinished plan reads any more."""
    for df in tables:
        path = getattr(df, "_parlance_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that ``materialise`` wrote for this application; for its end, when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that further columns of any name can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


# ------------------------------------------------------------- components


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component), component = the smallest node.

    Alternates the large-star and small-star steps until the edge list stands still. Each step is an
    aggregate with map-side combine and one equi-join, which AQE can split at a hub. Every round is
    written to the shared folder, so the lineage stays short. An empty edge list gives no rows.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    cur = materialise(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _fingerprint(cur)
    while state[0]:
        # large star: neighbours above u hang on to the least of u's neighbourhood
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its lower neighbours hang on to the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        now = _fingerprint(nxt)
        discard(cur)
        cur, done, state = nxt, now == state, now
        if done:
            break
    heads = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0))).head()
    return row[0], row[1]


# ------------------------------------------------------------------ words

# A-Z to a-z; a word is a run of bytes other than these six, so it is also a run of code points.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


# A word's hash sums a value for each byte at its place: mixed values of both, so that no two words share a hash by
# any rule, but two given ones once in 2**64. Values of the first places are kept.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_PLACES = 64


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix64(mix64(place.astype(np.uint64) * _U(_BASE)) + _BYTE[byte])


_VALUES = _value(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES))


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of a text, A-Z lower-cased. Long texts go piece by piece."""
    found, at = [], 0
    while at < len(text):
        end = min(at + PIECE_BYTES, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        raw = _LOWER[np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)]
        space = np.concatenate(([True], _SPACE[raw], [True]))
        turn = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = turn[::2], turn[1::2]
        size = ends - starts
        first = np.cumsum(size) - size
        raw = raw[~space[1:-1]]
        place = np.arange(len(raw)) - np.repeat(first, size)
        values = _VALUES[np.minimum(place, _PLACES - 1) * 256 + raw]
        far = np.flatnonzero(place >= _PLACES)
        values[far] = _value(place[far], raw[far])
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        found.append((mix64(total[first + size] - total[first]), starts + at, ends + at))
        at = end
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def distinct_words(line: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a lower-cased text, which of them each word is, and where the words start.

    Words of one hash are compared, byte by byte; should two differ, all are told apart by their bytes.
    """
    hashes, starts, ends = hash_words(line)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    raw, size = np.frombuffer(line, dtype=np.uint8), ends - starts
    same = np.array_equal(size, size[first][of])
    again = np.flatnonzero(starts != starts[first][of]) if same else starts[:0]  # all but the first of each
    for lo in range(0, len(again), 1 << 17):
        at = again[lo : lo + (1 << 17)]
        n = size[at]
        own = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        same = same and np.array_equal(raw[own], raw[own + np.repeat(starts[first][of[at]] - starts[at], n)])
    if not same:
        places: dict[bytes, int] = {}
        of = np.array([places.setdefault(line[a:b], len(places)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
        return list(places), of, starts
    return [line[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], of, starts


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words in order; of the whole sequence if it is shorter; none for no words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h = mix64(h + words[k : k + count]) * _U(0xE7037ED1A0B428DB)
    return h


def encoded(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text at most (one longer text stands alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if size and size + s > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += s
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker lives on, and other tasks share its machine


#: Counts the ones of 64-bit integers.
popcount = np.bitwise_count


# --------------------------------------------------------------- numbering

#: Rows that share one running number block at most, so no group is numbered by a single task.
BLOCK_BITS = 13


def gapless(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``rows`` with a number ``name`` from 0 without gaps in each group.

    ``rows`` is a written table whose ``rid`` came from monotonically_increasing_id. Runs of 8192 row ids are
    counted first; a running sum over those counts gives each run its start, and only runs are sorted.
    """
    block = F.shiftright("rid", BLOCK_BITS)
    counts = rows.groupBy(F.col(group).alias("_g"), block.alias("_b")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("rid")).cast("long") - 1
    numbered = rows.withColumn("_g", F.col(group)).withColumn("_b", block).withColumn("_i", place)
    return numbered.join(starts, ["_g", "_b"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_g", "_b", "_i", "_start")
