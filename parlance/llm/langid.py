"""Language identification by prediction by partial matching over bytes.

Each language has a tree of contexts of 0 to ``order`` bytes. A byte seen after the longest known context costs
-log2(c / (n + q)) bits (c its count, n all counts and q the distinct bytes there); any other byte costs the escape
-log2(q / (n + q)) and is looked for after the next shorter context, at last among 256 equal bytes. The statistics
are frozen after training, so that a byte's cost depends on nothing but the bytes before it: the escapes are summed
once, and scoring a text is one table look-up a byte. The language with the shortest code wins.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` whole documents of each language, drawn by
a hash of doc_id, of at most ``SAMPLE_BYTES`` in all for each) and broadcast; every text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if no labelled row
was to learn from; equal codes go to the language that sorts first; equal rows get equal results; a null doc_id
counts as an empty one where its checksum is asked for; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import encoded, slices

#: The bounded sample: whole documents, and their bytes, of each language.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1_500_000
#: Contexts of the full order are kept from this count on.
LEAST_CONTEXT = 4
#: Symbols scored at a time.
PORTION = 1 << 18

_LETTER = re.compile(rb"[A-Za-z]")


def training_sample(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text, place): up to ``docs`` rows of each language of (doc_id, text, lang), by a hash of doc_id."""
    usable = labelled.where("text is not null and lang is not null").withColumn("h", F.xxhash64("doc_id"))
    share = usable.groupBy("lang").agg(F.count("*").alias("n"))  # one row for each language
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / F.lit(float(1 << 53))
    some = usable.join(F.broadcast(share), "lang").where(part <= F.lit(8.0 * docs) / F.col("n"))
    first = Window.partitionBy("lang").orderBy(F.octet_length("text") > 1 << 16, "h", "doc_id", "text")
    return some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= docs).select("lang", "text", "place")


class ByteModel:
    """The frozen context trees of all languages in flat tables."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3):
        self.languages, self.order = sorted(samples), order
        seen = np.zeros(256, dtype=bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        # symbols: 0 stands before a text, 1 for bytes never seen in training, the seen bytes from 2 on
        self.symbol = np.ones(256, dtype=np.int64)
        self.symbol[seen] = np.arange(2, 2 + int(seen.sum()))
        a = self.size = 2 + int(seen.sum())
        streams = {lang: np.concatenate([np.concatenate((np.zeros(order, np.int64), self.symbol[np.frombuffer(t, np.uint8)])) for t in texts]) for lang, texts in samples.items()}
        grams = [{lang: self._counts(s, o) for lang, s in streams.items()} for o in range(order + 1)]
        cost = np.full((1, a, len(self.languages)), 8.0)  # below order 0: 256 equal bytes
        below = np.zeros(1, dtype=np.int64)  # the node of each context of the order before
        tables, base = [cost], 0
        for o in range(order + 1):
            contexts = self._contexts(grams[o], 1 if o < order else LEAST_CONTEXT)
            suffix = below[contexts % a ** max(0, o - 1)] - (base - len(tables[-1]) if o else 0)
            tables.append(self._costs(grams[o], contexts, tables[-1], suffix))
            below = np.tile(below, a) if o else below.copy()  # a context unseen stands for its longest seen suffix
            below[contexts] = base + np.arange(len(contexts))
            base += len(contexts)
        self.node = below.astype(np.int32)
        self.cost = np.concatenate(tables[1:]).reshape(-1, len(self.languages)).astype(np.float32)

    def _counts(self, stream: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of order o, next symbols and counts."""
        real = np.flatnonzero(stream)
        code = np.zeros(len(real), dtype=np.int64)
        for k in range(o, -1, -1):
            code = code * self.size + stream[real - k]
        code, n = np.unique(code, return_counts=True)
        return code // self.size, code % self.size, n

    @staticmethod
    def _contexts(grams: dict[str, tuple], least: int) -> np.ndarray:
        """Contexts that occur ``least`` times in all; a context's suffix occurs as often at least."""
        code, place = np.unique(np.concatenate([g[0] for g in grams.values()] + [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([g[2] for g in grams.values()] + [np.zeros(0, np.int64)]), minlength=len(code))
        return code[n >= least]

    def _costs(self, grams: dict[str, tuple], contexts: np.ndarray, shorter: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Bits of each symbol after each context. shorter, suffix: those of the shorter contexts, and which is whose."""
        out = shorter[suffix].copy()
        for k, lang in enumerate(self.languages):
            ctx, sym, n = grams[lang]
            at = np.searchsorted(contexts, ctx)
            at = np.minimum(at, max(0, len(contexts) - 1))
            keep = contexts[at] == ctx if len(contexts) else np.zeros(len(ctx), bool)
            at, sym, n = at[keep], sym[keep], n[keep]
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            some = kinds > 0
            out[some, :, k] += np.log2((total[some] + kinds[some]) / kinds[some])[:, None]
            out[at, sym, k] = np.log2((total[at] + kinds[at]) / n)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, texts by languages."""
        out = np.zeros((len(texts), len(self.languages)))
        pad = bytes(self.order)
        raw = np.frombuffer(pad + pad.join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes + self.order) - sizes
        stream = self.symbol[raw]
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            stream[s - self.order : s] = 0
        ends = starts + sizes
        for lo in range(self.order, len(stream), PORTION):
            hi = min(lo + PORTION, len(stream))
            code = np.zeros(hi - lo, dtype=np.int64)
            for k in range(self.order, 0, -1):
                code = code * self.size + stream[lo - k : hi - k]
            cost = self.cost[self.node[code].astype(np.int64) * self.size + stream[lo:hi]]
            first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi)
            for i in range(int(first), int(last)):
                a, b = max(int(starts[i]), lo), min(int(ends[i]), hi)
                if a < b:
                    out[i] += cost[a - lo : b - lo].sum(axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES, order: int = 3) -> ByteModel | None:
    """The model of (doc_id, text, lang) rows, from the bounded sample; None if there is none."""
    samples: dict[str, list[bytes]] = {}
    for r in training_sample(labelled, docs).orderBy("lang", "place").collect():
        texts = samples.setdefault(r.lang, [])
        text = r.text.encode()
        if not texts or sum(map(len, texts)) + len(text) <= size:
            texts.append(text)
    return ByteModel(samples, order) if samples else None


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def _predict(model: ByteModel | None, texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
    langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    ask = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
    if ask:
        bits = model.bits([texts[i] for i in ask])
        best = bits.argmin(axis=1)
        for i, b, k in zip(ask, bits, best.tolist(), strict=True):
            langs[i] = model.languages[k]
            scores[i] = float(1 / np.exp2(np.maximum(b[k] - b, -1000)).sum())
            rates[i] = float(b[k] / len(texts[i]))
    return langs, scores, rates


def _predicted(docs: DataFrame, model: ByteModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` under names by place, _0 and on, and lang_pred, score and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[k].alias(n) for k, n in zip(keep, names, strict=True)], docs["text"].alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            langs, scores, rates = _predict(shared.value, encoded(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*names, "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def predict(docs: DataFrame, model: ByteModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score (the posterior of the best code) and bits_per_byte."""
    found = _predicted(docs, model, keep)
    return found.select(*[found[f"_{i}"].alias(k) for i, k in enumerate(keep)], "lang_pred", "score", "bits_per_byte")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's decimal text modulo ``folds``; a null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from the two folds that are not held out."""
    held = fold(docs["doc_id"], 3) == 1
    labelled = docs.where(~held).select(docs["doc_id"], docs["text"], docs["lang"])
    found = predict(docs, train(labelled), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``; lang becomes the predicted one. Learns from all labelled rows."""
    names = docs.columns
    found = _predicted(docs, train(docs.select(docs["doc_id"], docs["text"], docs["lang"])), names)
    return found.where("lang_pred <> 'und'").select(*[F.col("lang_pred" if n == "lang" else f"_{i}").alias(n) for i, n in enumerate(names)])
