"""Dense retrieval: hashed bag-of-stems vectors, exact nearest neighbours by cosine, and what keeps vectors current."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import text as tx
from parlance.storage import spread

# Words that stand for one another across languages in the deterministic embedder.
LEXICON = {
    "внж": "residence", "residence": "residence", "permit": "residence", "residencia": "residence", "банк": "bank", "bank": "bank",
    "счёт": "account", "account": "account", "виза": "visa", "visa": "visa", "симка": "sim", "сим": "sim", "sim": "sim",
}
_STEMMED = {tx.stem_token(k): v for k, v in LEXICON.items()}


def features(text: str | None) -> list[str]:
    """Stems through the lexicon, without numbers and single characters."""
    import re
    import unicodedata

    words = re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").lower())
    return [_feature(w) for w in words if len(w) > 1 and not w.isdigit()]


#: Words that a process remembers the stems and places of.
REMEMBERED = 50_000


@functools.lru_cache(REMEMBERED)
def _feature(word: str) -> str:
    stem = tx.stem_token(word)
    return _STEMMED.get(stem, stem)


@functools.lru_cache(REMEMBERED)
def _hashed(feature: str) -> tuple[int, float]:
    """A number that gives a feature's place, and its sign."""
    d = hashlib.blake2b(feature.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big"), 1.0 if d[4] % 2 else -1.0


def hashed_vector(text: str | None, dim: int = schema.EMBED_DIM) -> list[float]:
    """Signed counts of hashed features, of unit length; zero for a text without features."""
    out = np.zeros(dim)
    for f in features(text):
        at, sign = _hashed(f)
        out[at % dim] += sign
    size = np.linalg.norm(out)
    return (out / size if size else out).tolist()


#: Embedders by name: a function of a list of texts, and the length of its vectors. Others may be added.
EMBEDDERS: dict[str, tuple[Callable[[list[str | None]], list[list[float]]], int]] = {"hashed": (lambda texts: [hashed_vector(t) for t in texts], schema.EMBED_DIM)}


#: Texts that a model is given together.
TEXTS = 256


def vectors_of(texts: pd.Series, model: Callable[[list[str | None]], list[list[float]]]) -> pd.Series:
    """The vectors of texts as arrays of 32-bit floats; only some rows are lists of Python's numbers at a time."""
    found: list[np.ndarray] = []
    for a in range(0, len(texts), TEXTS):
        found += [np.asarray(v, dtype=np.float32) for v in model(texts.iloc[a : a + TEXTS].tolist())]
    return pd.Series(found, index=texts.index, dtype=object)


def embed(text: Column, name: str = "hashed") -> Column:
    """The vectors of a text column, in batches; a model would be loaded once for each task.

    It is marked as not deterministic so that each text is embedded once, where it lies: else Spark moves a filter on the
    vectors to before a shuffle, and embeds for the filter, in the tasks of the table's files, and again after it.
    """
    model = EMBEDDERS[name][0]

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield vectors_of(part, model)

    return run.asNondeterministic()(text)


class EmbedderUnavailable(RuntimeError):
    """An embedder that cannot run now; searches go on without it."""


def usable(vector: Column) -> Column:
    """Not a zero vector: those are embedded, and never stored or found."""
    return F.exists(vector, lambda x: x != 0)


def check_space(meta: dict[str, str], name: str) -> None:
    """Vectors of one model and length are not compared with those of another."""
    have, want = (meta.get("embed_model"), meta.get("embed_dim")), (name, str(EMBEDDERS[name][1]))
    if have[0] is not None and have != want:
        raise ValueError(f"the index holds vectors of {have[0]} ({have[1]}), not of {name} ({want[1]}): embed again")


def embed_dirty(units: DataFrame, stored: DataFrame, name: str = "hashed") -> DataFrame:
    """Vectors after a change: those of units that are still there, and new ones for units without."""
    have = stored.join(units.select("unit_id"), "unit_id", "left_semi")
    new = units.join(stored.select("unit_id"), "unit_id", "left_anti")
    fresh = spread(new.select("unit_id", "chat_id", "date_start", "text")).select("unit_id", "chat_id", "date_start", embed(F.col("text"), name).alias("embedding")).where(usable(F.col("embedding")))
    return have.unionByName(fresh)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine of a column and a given vector, in the JVM."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, asked, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = float(np.linalg.norm(np.asarray(query, dtype=float)))
    return F.when((norm > 0) & F.lit(size > 0), 1 - dot / (norm * size))


def knn(vectors: DataFrame, query: list[float], k: int, chats: list[int] | None = None, since: int | None = None, until: int | None = None, key: str = "unit_id", lossy: bool = False) -> DataFrame:
    """(key, distance): the k nearest, by (distance, key).

    Chat and date bounds go into the scan. With ``lossy`` and more chats than ``VEC_FANOUT_MAX``, the nearest
    ``KNN_OVERFETCH`` * k of all chats are filtered afterwards, so that fewer than k may be left.
    """
    if not any(query) or chats == []:
        return vectors.limit(0).select(key, F.lit(0.0).alias("distance"))
    rows = vectors
    if since is not None:
        rows = rows.where(F.col("date_start") >= since)
    if until is not None:
        rows = rows.where(F.col("date_start") <= until)
    late = lossy and chats is not None and len(chats) > schema.VEC_FANOUT_MAX
    if chats is not None and not late:
        rows = rows.where(F.col("chat_id").isin(sorted(chats)))
    near = rows.withColumn("distance", cosine_distance(F.col("embedding"), query)).where("distance is not null")
    if late:
        near = near.orderBy("distance", key).limit(schema.KNN_OVERFETCH * k).where(F.col("chat_id").isin(sorted(chats)))
    return near.select(key, "distance").orderBy("distance", key).limit(k)


#: Queries that may be broadcast.
BROADCAST_QUERIES = 20_000


def knn_each(vectors: DataFrame, queries: DataFrame, k: int, by: str, key: str = "vec_id") -> DataFrame:
    """(query_id, key, distance, rank): the k nearest of each query among the rows with its value of ``by``.

    ``queries`` is (query_id, by, q). They are broadcast where they are few, else joined by a shuffle; a task keeps
    each query's k nearest of what it has seen of them (a window's group limit) before they meet.
    """
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    left = vectors.select(key, by, "embedding", size("embedding").alias("_n"))
    asked = queries.withColumn("_m", size("q"))
    scored = left.join(F.broadcast(asked) if queries.count() <= BROADCAST_QUERIES else asked, by)
    scored = scored.where((F.col("_n") > 0) & (F.col("_m") > 0)).select("query_id", key, (1 - dot / (F.col("_n") * F.col("_m"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
