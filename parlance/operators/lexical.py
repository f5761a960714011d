"""Lexical retrieval: an inverted index over weighted columns, BM25, and filling AND results up with OR results."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as tx
from parlance.operators.ordered import last_before
from parlance.storage import checkpointed, shuffled

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
WEIGHTS = {"raw": 2.0, "stemmed": 1.0}


_LETTERS = re.compile(r"[^\W_]+")


@functools.cache
def _folded(c: str) -> str:
    """A character without its marks if it is a Latin letter; a mark on its own is dropped."""
    if unicodedata.category(c) == "Mn" and "\u0300" <= c <= "\u036f":
        return ""
    if not unicodedata.name(c, "").startswith("LATIN"):
        return c
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


def index_tokens(text: str | None) -> list[str]:
    """Tokens as the index splits them: letters and digits, lower case, without Latin diacritics; ``_`` separates."""
    lowered = (text or "").lower()
    return _LETTERS.findall(lowered if lowered.isascii() else "".join(map(_folded, lowered)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def index_terms(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``index_tokens`` of a column."""
    for part in text:
        yield part.map(index_tokens)


def two_columns(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, raw, stemmed): the terms of the text and of the stems of its tokens."""
    tokens = tx.tokens(F.col(text))
    return docs.select(doc, index_terms(F.col(text)).alias("raw"), index_terms(F.array_join(tx.stems(tokens), " ")).alias("stemmed"))


def postings(terms: DataFrame, doc: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(term, doc, f, tf): how often each document holds a term, and that weighted by column.

    ``terms`` has an array of terms for each weighted column. Counting combines before it shuffles.
    """
    weights = weights or {c: WEIGHTS[c] for c in WEIGHTS if c in terms.columns}
    parts = [terms.select(doc, F.explode(c).alias("term"), F.lit(float(w)).alias("w")) for c, w in weights.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("term", doc).agg(F.sum("w").alias("f"), F.count("*").alias("tf"))


def bm25(terms: DataFrame, query: list[str], doc: str, weights: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(doc, score, hits): the BM25 score of each document that holds a query term, and how many of them it holds.

    ``terms`` has one row for each document. Document frequencies and the mean length are those of all documents;
    ``allowed`` restricts what is returned only. A term in half of the documents or more counts next to nothing. One
    pass over the terms leaves each document's size and how often it holds each query term; all else is of these.
    """
    query = list(dict.fromkeys(query))
    columns = [c for c in terms.columns if c != doc]
    weights = weights or {c: WEIGHTS[c] for c in columns}
    often = lambda q: sum((F.lit(float(w)) * F.size(F.filter(c, lambda t: t == q)) for c, w in weights.items()), F.lit(0.0))
    size = sum((F.size(c) for c in columns), F.lit(0)).cast("long")
    return scored(terms.select(doc, size.alias("size"), F.array(*map(often, query)).cast("array<double>").alias("f")), len(query), doc, allowed)


def scored(rows: DataFrame, terms: int, doc: str, allowed: DataFrame | None = None, corpus: tuple[int, float] | None = None) -> DataFrame:
    """(doc, score, hits) from (doc, size, f) rows, f being how often each of the query's terms is held, by weight.

    ``corpus`` is the number of documents and their mean size where ``rows`` are not all of them.
    """
    rows = checkpointed(rows)
    held = [F.coalesce(F.sum((F.col("f")[i] > 0).cast("long")), F.lit(0)) for i in range(terms)]
    n, mean, *df = rows.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0)), *held).head()
    if corpus:
        n, mean = corpus
    if allowed is not None:
        rows = rows.join(allowed.select(doc).distinct(), doc, "left_semi")
    score, hits = F.lit(0.0), F.lit(0)
    for i, d in enumerate(df):
        f = F.col("f")[i]
        idf = max(math.log((n - d + 0.5) / (d + 0.5)), 0.0) or LEAST_IDF
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
        hits = hits + (f > 0).cast("int")
    return rows.select(doc, F.round(score, 12).alias("score"), hits.alias("hits")).where("hits > 0")


def and_then_or(scored: DataFrame, terms: int, limit: int, doc: str) -> DataFrame:
    """(doc, score, place): documents that hold every term first, then those that hold any, each by score and id."""
    tier = F.when(F.col("hits") >= terms, 0).otherwise(1)
    top = scored.withColumn("tier", tier).orderBy("tier", F.desc("score"), doc).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("tier", F.desc("score"), doc))).select(doc, "score", "tier", "place")


def phrases(query: str) -> list[tuple[str, ...]]:
    """The distinct stems of a query as the index splits them; a stem of several tokens is a phrase."""
    return list(dict.fromkeys(p for s in tx.query_terms(query) if (p := tuple(index_tokens(s)))))


def index_gaps(docs: DataFrame, indexed: DataFrame, doc: str) -> DataFrame:
    """(doc, what): documents that the index lacks, and index entries whose document is gone."""
    missing = docs.select(doc).join(indexed.select(doc).distinct(), doc, "left_anti").withColumn("what", F.lit("missing"))
    return missing.unionByName(indexed.select(doc).distinct().join(docs.select(doc), doc, "left_anti").withColumn("what", F.lit("stale")))


def containing_unit(messages: DataFrame, units: DataFrame) -> DataFrame:
    """``messages`` with the unit each lies in: by span of ids in its chat and topic, the latest start winning.

    Spans of a chat are joined by steps of 1000 ids, so that a message meets the windows near it and not all of
    its chat's. A message that no window spans falls back to the post that begins with it.
    """
    step = 1000
    spans = units.where("kind = 'window'").select(F.col("chat_id").alias("_chat"), F.col("topic_id").alias("_topic"), F.col("unit_id").alias("_unit"), F.col("msg_id_start").alias("_a"), F.col("msg_id_end").alias("_b"))
    spans = spans.withColumn("_at", F.explode(F.sequence(F.floor(F.col("_a") / step), F.floor(F.col("_b") / step))))
    rows = messages.select("chat_id", "msg_id", "topic_id", F.floor(F.col("msg_id") / step).alias("_step"))
    on = (F.col("chat_id") == F.col("_chat")) & (F.col("_step") == F.col("_at")) & F.col("topic_id").eqNullSafe(F.col("_topic")) & F.col("msg_id").between(F.col("_a"), F.col("_b"))
    met = rows.join(shuffled(spans), on).select("chat_id", "msg_id", "_unit", "_a")
    best = met.groupBy("chat_id", "msg_id").agg(F.max_by("_unit", F.struct("_a", "_unit")).alias("_window"))
    post = units.where("kind = 'post'").select("chat_id", F.col("msg_id_start").alias("msg_id"), F.col("unit_id").alias("_post"))
    out = messages.join(shuffled(best), ["chat_id", "msg_id"], "left").join(shuffled(post), ["chat_id", "msg_id"], "left")
    return out.withColumn("unit_id", F.coalesce("_window", "_post")).drop("_window", "_post")


def window_before(messages: DataFrame, units: DataFrame) -> DataFrame:
    """(chat_id, topic_id, msg_id, before): the window of each message's chat and topic with the greatest start at or before it."""
    starts = units.where("kind = 'window'").select("chat_id", "topic_id", F.col("msg_id_start").alias("at"), F.col("unit_id").alias("before"))
    asks = messages.select("chat_id", "topic_id", "msg_id", F.col("msg_id").alias("at"))
    return last_before(asks, starts, ["chat_id", "topic_id"], "at", "before").drop("at")
