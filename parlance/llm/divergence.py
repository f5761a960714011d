"""How the sources of each language differ in their words, priced exactly.

Each language keeps the terms that enough of its documents hold. A group, which is a language's source, gives a kept
term of count c the price ``p = 1 + floor(SCALE * (c + EACH) / (N + EACH * V))``, with N the group's occurrences of kept
terms and V the number of kept terms. Two groups differ by the sum of abs(p - q) over the kept terms.

As a price depends on nothing but a group and a count, that sum needs no terms: the joint table of two groups, which
says how many terms have count a here and count b there, prices it. Terms are the columns of a matrix of indicators
whose rows are (group, count level). Its product with its transpose holds every joint table. The product is taken
block by block: a block is a few terms of like counts, and a tile of it the rows of some groups. Each cell of a
block's product is priced and summed into a number for each two groups, exactly, in 64-bit integers. Blocks may be
any terms in any order, so no term, source or language makes a hot task; only sums of two groups are shuffled.

Words are counted in tasks, one bounded table at a time, before anything is shuffled.

Defined results: null texts, languages and sources count as empty ones; texts are read whole, piece by piece; a group
without kept terms, or of a language that keeps none, has its price for count 0, and pairs in a language that keeps
none differ by 0; repeated rows are counted as often as they stand there; ties of a rank fall to the smaller item;
an empty table gives no rows; further columns are not read. Sums stay below 2**63 for up to 2**32 kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import PIECE_BYTES, encoded, materialise, slices

SCALE, EACH = 1_000_000_000, 5
#: Documents of a language that must hold a term, and ranks of a group's terms that are told.
LEAST_DOCS, TOP_TERMS = 30, 50
#: Entries of a task's table of counts.
HELD_ENTRIES = 400_000
#: Terms of a block, as powers of two: of rare terms, which have few levels, and of terms with more than so many
#: occurrences, each of which is a level of its own. Groups and rows of a tile. None of these changes a result.
RARE_BITS, COMMON_BITS, COMMON = 9, 5, 2048
TILE_GROUPS, TILE_ROWS = 128, 1024

# Bytes of terms as they count, A-Z lower-cased; all others as spaces. Bytes from 128 on belong to letters of UTF-8.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(_TERM_BYTES)
        while end < len(text) and not piece.endswith(b" "):
            more = text[end : end + 4096].translate(_TERM_BYTES)
            stop = more.find(b" ")
            piece += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield piece.split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and how many of its documents hold it."""
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(text_of(docs["lang"]).alias("lang"), text_of(docs["source"]).alias("source"), text_of(docs["text"]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        holding: dict[tuple[str, str], Counter] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                words = [w.decode() for w in found]
                n = len(words)
                own = holding[lang, source]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(words, pa.string()), pa.array(found.values(), pa.int64()), pa.array(map(own.__getitem__, found), pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)), strict=True):
                into, own = counts.setdefault((lang, source), Counter()), holding.setdefault((lang, source), Counter())
                held -= len(into)
                seen: set[bytes] = set()
                for words in terms(text):
                    into.update(words)
                    seen.update(words)
                own.update(seen)
                held += len(into)
                if held > HELD_ENTRIES:
                    yield from told()
                    counts, holding, held = {}, {}, 0
        yield from told()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """A term's price in a group; exact, whatever the counts."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + EACH)
    return F.call_function("div", part.cast("decimal(38,0)"), (total.cast("decimal(19,0)") + kept.cast("decimal(19,0)") * EACH).cast("decimal(38,0)")) + 1


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The terms that are kept, (lang, term, total, counts of (source, n)), and all groups, (lang, source, n, kept, total); both written."""
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = materialise(by_term.where(F.col("docs") >= least).drop("docs"), "terms")
    held = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("total"))
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    every = docs.select(text_of(docs["lang"]).alias("lang"), text_of(docs["source"]).alias("source")).distinct()
    groups = every.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "kept", "total"])
    return kept, materialise(groups, "groups")


# ------------------------------------------------------------------ products


def blocks_of(kept: DataFrame, rare: int = RARE_BITS, common: int = COMMON_BITS) -> DataFrame:
    """(lang, number, block): up to 2**rare or 2**common terms of a language, each its counts by source; terms of like counts stand together."""
    near = kept.select("lang", "total", "term", "counts").repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term")
    rid = F.monotonically_increasing_id()
    numbered = near.select("lang", "counts", F.when(F.col("total") > COMMON, -1 - F.shiftright(rid, common)).otherwise(F.shiftright(rid, rare)).alias("number"))
    return numbered.groupBy("lang", "number").agg(F.collect_list("counts").alias("block"))


def _levels(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row of counts, the levels that occur and which of them each term has."""
    return [np.unique(row, return_inverse=True) for row in counts]


def _tiles(levels: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Runs of groups whose levels together are at most TILE_ROWS rows; one group stands alone if it has more."""
    start, rows = 0, 0
    for k, (found, _) in enumerate(levels):
        if rows and rows + len(found) > TILE_ROWS:
            yield start, k
            start, rows = k, 0
        rows += len(found)
    yield start, len(levels)


def _indicators(levels: list[tuple[np.ndarray, np.ndarray]], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows (group, level) by terms of ones and zeros, and where each group's rows start."""
    starts = np.cumsum([0] + [len(found) for found, _ in levels])
    out = np.zeros((int(starts[-1]), terms))
    for start, (_, which) in zip(starts, levels, strict=False):
        out[start + which, np.arange(terms)] = 1.0
    return out, starts[:-1]


def differences(left: np.ndarray, right: np.ndarray, price_left: list[dict[int, int]], price_right: list[dict[int, int]]) -> np.ndarray:
    """Sums of abs(p - q) over the terms of a block for each two groups.

    left, right: counts, groups by terms. price_*: each group's price of each of its counts. The sums are over the
    joint tables, which are products of indicators; these hold ones and numbers of terms, which doubles hold exactly.
    """
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = _levels(left), _levels(right)
    p = [np.array([of[int(c)] for c in found], dtype=np.int64) for of, (found, _) in zip(price_left, a, strict=True)]
    q = [np.array([of[int(c)] for c in found], dtype=np.int64) for of, (found, _) in zip(price_right, b, strict=True)]
    of_right = [(j0, j1, *_indicators(b[j0:j1], right.shape[1]), np.concatenate(q[j0:j1])) for j0, j1 in _tiles(b)]
    for i0, i1 in _tiles(a):
        one, starts = _indicators(a[i0:i1], left.shape[1])
        own = np.concatenate(p[i0:i1])
        for j0, j1, other, others, prices in of_right:
            joint = (one @ other.T).astype(np.int64)
            joint *= np.abs(own[:, None] - prices[None, :])
            out[i0:i1, j0:j1] += np.add.reduceat(np.add.reduceat(joint, starts, axis=0), others, axis=1)
    return out


def _prices(counts: np.ndarray, total: int, kept: int) -> dict[int, int]:
    return {c: 1 + SCALE * (c + EACH) // (total + EACH * kept) for c in np.unique(counts).tolist()}


def pair_values(kept: DataFrame, groups: DataFrame, tile: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways round.

    Each block meets the groups of its language, once for each two tiles of them.
    """
    of_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.max("kept").alias("kept"))
    blocks = blocks_of(kept)
    nothing = of_lang.select("lang", F.lit(None).cast("long").alias("number"), F.array().cast(blocks.schema["block"].dataType).alias("block"))  # so that a language without terms has its pairs
    numbers = F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / tile).cast("int"))
    met = blocks.unionByName(nothing).join(of_lang, "lang")
    met = met.withColumn("i", F.explode(numbers)).withColumn("j", F.explode(F.sequence(F.col("i"), F.floor((F.size("groups") - 1) / tile).cast("int"))))
    part = lambda k: F.slice("groups", F.col(k) * tile + 1, F.lit(tile))
    work = met.repartition("lang", "number", "i", "j").select("lang", "block", "kept", part("i").alias("left"), part("j").alias("right"), (F.col("i") == F.col("j")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[list[str], list[str], bool, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, _, _), (a, b, same, value) in sums.items():
                i, j = np.nonzero(np.triu(np.ones(value.shape), 1) if same else np.ones(value.shape))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(i)), pa.array([a[k] for k in i], pa.string()), pa.array([b[k] for k in j], pa.string()), pa.array(value[i, j])], ["lang", "source", "item", "value"])

        for batch in batches:
            for k in range(batch.num_rows):
                lang, block, kept_, left, right, same = (c[k].as_py() for c in batch.columns)
                names = [[g["source"] for g in side] for side in (left, right)]
                key = (lang, names[0][0], names[1][0])
                if key not in sums:
                    if len(sums) >= 64:
                        yield from told()
                        sums.clear()
                    sums[key] = (*names, same, np.zeros((len(left), len(right)), dtype=np.int64))
                if block:
                    counts = []
                    for side in (left, right):
                        row = {g["source"]: r for r, g in enumerate(side)}
                        at = [(row[c["source"]], t, c["n"]) for t, term in enumerate(block) for c in term if c["source"] in row]
                        dense = np.zeros((len(side), len(block)), dtype=np.int64)
                        r, t, n = (np.array(x, dtype=np.int64) for x in (zip(*at, strict=True) if at else ([], [], [])))
                        dense[r, t] = n
                        counts.append(dense)
                    prices = [[_prices(row, g["n"], kept_) for row, g in zip(dense, side, strict=True)] for dense, side in zip(counts, (left, right), strict=True)]
                    sums[key][3][:] += differences(counts[0], counts[1], *prices)
        yield from told()

    half = work.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


# ---------------------------------------------------------------------- audit


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has at a higher price than its language."""
    each = kept.select("lang", "term", F.col("total").alias("in_lang"), F.explode("counts").alias("c")).select("lang", "c.source", "term", "in_lang", "c.n")
    of = groups.select("lang", "source", F.col("n").alias("in_group"), "kept", "total")
    priced = each.join(of, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (price(F.col("n"), F.col("in_group"), F.col("kept")) - price(F.col("in_lang"), F.col("total"), F.col("kept"))).alias("value"))
    return priced.where("value > 0")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of each source, and the ``top`` terms of it."""
    kept, groups = kept_terms(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(order))
    told = term_values(kept, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(told, "term"))
