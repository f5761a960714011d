"""A stored inverted index: what a search reads are its terms' postings, not the documents.

Postings are (term, doc, size, raw, stemmed): where a document holds a term in its text and in the stems of its words,
and how many terms it has in all. They lie in folders by a hash of the term and sorted by term within each file, so that
a query reads few row groups; the sizes of all documents are a table of their own. A task posts its documents, sorts
what it made and writes it to all folders: postings, which take some times the disk of the text, are never shuffled, and
no term is one task's. Documents come in numbered segments. A segment replaces the documents it holds, or that
it says are gone, in all segments before it; it counts once its statistics are written, last, so that writing one
again after a failure changes nothing. ``compact`` makes one segment of all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.lexical import WEIGHTS, and_then_or, index_tokens, phrases, scored
from parlance.storage import spread, swept

#: Folders that postings are spread over by term, and the one beside them for rows without a term while a segment is written.
BUCKETS, TERMLESS = 32, -1
POSTINGS = "term string, doc long, size long, raw array<int>, stemmed array<int>"
_COLUMNS = [f.split()[0] for f in POSTINGS.split(", ")]
#: Tokens of documents that are posted together, and rows that a task hands over together.
TOKENS, ROWS = 200_000, 10_000


def _grouped(docs: list[int], sizes: list[int], tokens: list[str], counts: list[int]) -> pa.RecordBatch:
    """Postings of some documents, whose tokens follow each other: of each document those of its text, then its stems'."""
    code, terms = pd.factorize(np.array(tokens, dtype=object))
    counts = np.array(counts, dtype=np.int64)  # two for each document
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    side = np.repeat(np.tile([0, 1], len(docs)), counts)
    key = np.repeat(np.repeat(np.arange(len(docs)), 2), counts) * len(terms) + code
    order = np.argsort(key, kind="stable")  # of a document and term: places in the text, then in the stems
    key, at, side = key[order], at[order], side[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    lists = []
    for k in (0, 1):
        held = np.add.reduceat(side == k, first, dtype=np.int64) if len(first) else first
        lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(at[side == k], pa.int32())))
    own, term = np.divmod(key[first], max(len(terms), 1))
    one = lambda values: pa.array(np.array(values, dtype=np.int64)[own], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(term)), one(docs), one(sizes), *lists], _COLUMNS)


def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of postings of batches of (doc, text), and a row without a term for each document, whether it has one or not.

    Documents are taken together up to ``TOKENS`` tokens, so that a task's memory follows neither the rows of a batch
    nor their length; only one document is held as a whole.
    """
    known: dict[str, list[str]] = {}

    def stemmed(token: str) -> list[str]:
        found = known.get(token)
        if found is None:
            if len(known) > 100_000:
                known.clear()
            found = known[token] = index_tokens(tx.stem_token(token))
        return found

    docs, sizes, tokens, counts = [], [], [], []

    def told() -> Iterator[pa.RecordBatch]:
        none = [pa.nulls(len(docs), t) for t in (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), *none[1:]], _COLUMNS)
        if tokens:
            made = _grouped(docs, sizes, tokens, counts)
            for a in range(0, made.num_rows, ROWS):
                yield made.slice(a, ROWS)
        for held in (docs, sizes, tokens, counts):
            held.clear()

    for batch in batches:
        for a in range(0, batch.num_rows, 100):
            for doc, text in zip(*(c.to_pylist() for c in batch.slice(a, 100).columns), strict=True):
                raw = index_tokens(text)
                stems = [t for w in tx.token_list(text) for t in stemmed(w)]
                docs.append(doc)
                sizes.append(len(raw) + len(stems))
                counts += [len(raw), len(stems)]
                tokens += raw
                tokens += stems
                if len(tokens) >= TOKENS or len(docs) >= ROWS:
                    yield from told()
    if docs:
        yield from told()


def posted(docs: DataFrame) -> DataFrame:
    """Postings of (doc, text) rows; a document is complete in its row, so nothing is shuffled to count."""
    return docs.select("doc", "text").mapInArrow(post, POSTINGS)


def _less(k: int):
    return lambda x: (x - k).cast("int")


def bucket(term: Column) -> Column:
    return F.crc32(term) % BUCKETS


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ------------------------------------------------------------- segments

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def segments(self) -> list[int]:
        """The numbers of the segments that count, from the last compaction on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/stats")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        whole = [n for n in numbers if self._exists(f"{self.folder}/whole/{n}")]
        return [n for n in numbers if n >= max(whole, default=0)]

    def add(self, docs: DataFrame, gone: DataFrame | None = None, number: int | None = None) -> int:
        """Write (doc, text) rows as a segment that replaces these documents and removes those in ``gone`` (doc)."""
        before = self.segments()
        number = number if number is not None else max(before, default=0) + 1
        before = [n for n in before if n < number]
        self._write(posted(spread(docs.select("doc", "text"))), docs, gone, before, number)
        return number

    def _write(self, postings: DataFrame, docs: DataFrame, gone: DataFrame | None, before: list[int], number: int) -> None:
        """``postings`` with a row without a term for each document. They are made once and written where they are made."""
        spark, made = self.spark, f"{self.folder}/postings/{number}"
        placed = postings.withColumn("bucket", F.coalesce(bucket(F.col("term")), F.lit(TERMLESS)).cast("int")).sortWithinPartitions("bucket", "term", "doc")
        placed.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(made)
        rows = spark.read.schema(f"{POSTINGS}, bucket int").parquet(made).where(F.col("bucket") == TERMLESS)
        rows.select("doc", "size").write.mode("overwrite").parquet(f"{self.folder}/docs/{number}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{made}/bucket={TERMLESS}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        dead = docs.select("doc") if gone is None else docs.select("doc").unionByName(gone.select("doc"))
        dead.distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/{number}")
        live = self.docs([*before, number])
        live.agg(F.count("*").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).write.mode("overwrite").parquet(f"{self.folder}/stats/{number}")
        swept(spark)

    def _read(self, what: str, schema: str, numbers: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for n in numbers:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/{n}").withColumn("segment", F.lit(n)))
        return out

    def _live(self, rows: DataFrame, numbers: list[int]) -> DataFrame:
        """Rows of documents that no later segment replaces or removes."""
        if len(numbers) < 2:
            return rows
        dead = self._read("gone", "doc long", numbers[1:]).groupBy("doc").agg(F.max("segment").alias("_dead"))
        return rows.join(dead, "doc", "left").where(F.col("_dead").isNull() | (F.col("segment") >= F.col("_dead"))).drop("_dead")

    def docs(self, numbers: list[int] | None = None) -> DataFrame:
        """(doc, size) of all documents."""
        numbers = self.segments() if numbers is None else numbers
        return self._live(self._read("docs", "doc long, size long", numbers), numbers).select("doc", "size")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings of all terms or of these; then only their folders and row groups are read."""
        numbers = self.segments()
        rows = self._read("postings", f"{POSTINGS}, bucket int", numbers)
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(terms)) if terms else rows.limit(0)
        return self._live(rows, numbers).drop("segment", "bucket")

    def stats(self) -> tuple[int, float]:
        """How many documents there are, and their mean size."""
        numbers = self.segments()
        if not numbers:
            return 0, 0.0
        row = self.spark.read.parquet(f"{self.folder}/stats/{numbers[-1]}").head()
        return row.n, row.mean

    def gaps(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(missing, stale): documents that the index lacks, and (doc) of those it has but that are no more."""
        have = self.docs()
        return docs.join(have.select("doc"), "doc", "left_anti"), have.select("doc").join(docs.select("doc"), "doc", "left_anti")

    def repair(self, docs: DataFrame) -> bool:
        """Add what the index lacks of (doc, text) rows and remove what is no more; whether there was anything."""
        missing, stale = self.gaps(docs)
        if missing.isEmpty() and stale.isEmpty():
            return False
        self.add(missing, stale)
        return True

    def compact(self) -> None:
        """One segment of all that is live."""
        numbers = self.segments()
        if len(numbers) < 2:
            return
        number = numbers[-1] + 1
        live = self.docs()
        every = live.select(F.lit(None).cast("string").alias("term"), "doc", "size", *[F.lit(None).cast("array<int>").alias(c) for c in WEIGHTS])
        self._write(self.postings().unionByName(every), live, None, [], number)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/whole/{number}")

    # -------------------------------------------------------------- searches

    def scores(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        """(doc, score, hits) by BM25 over both columns; a stem of several tokens must stand as a phrase."""
        wanted = phrases(query)
        terms = sorted({t for p in wanted for t in p})
        rows = self.postings(terms)
        placed = sorted({t for p in wanted if len(p) > 1 for t in p})  # only phrases need places
        held: list[Column] = [F.first("size").alias("size")]
        for i, t in enumerate(terms):
            mine = F.col("term") == t
            for c in WEIGHTS:
                held.append(F.coalesce(F.max(F.when(mine, F.size(c))), F.lit(0)).alias(f"{c}{i}"))
                if t in placed:
                    held.append(F.coalesce(F.first(F.when(mine, F.col(c)), ignorenulls=True), F.array().cast("array<int>")).alias(f"{c}_at{i}"))
        by_doc = rows.groupBy("doc").agg(*held)

        def often(phrase: tuple[str, ...]) -> Column:
            f = F.lit(0.0)
            for c, w in WEIGHTS.items():
                if len(phrase) == 1:
                    n = F.col(f"{c}{terms.index(phrase[0])}")
                else:
                    at = F.col(f"{c}_at{terms.index(phrase[0])}")
                    for k, t in enumerate(phrase[1:], 1):
                        at = F.array_intersect(at, F.transform(F.col(f"{c}_at{terms.index(t)}"), _less(k)))
                    n = F.size(at)
                f = f + F.lit(w) * n
            return f

        f = F.array(*map(often, wanted)).cast("array<double>") if wanted else F.array().cast("array<double>")
        return scored(by_doc.select("doc", "size", f.alias("f")), len(wanted), "doc", allowed, self.stats())

    def search(self, query: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """The best documents: those that hold all of the query first, then those that hold any of it."""
        return and_then_or(self.scores(query, allowed), len(phrases(query)), limit, "doc")
