"""Hybrid search: lexical and dense lists fused, reranked, boosted by reactions, and cleared of overlaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import text as tx
from parlance.operators import dense, rank
from parlance.operators.index import Index
from parlance.operators.lexical import and_then_or, containing_unit, phrases
from parlance.storage import checkpointed, shared_folder

MODES = ("hybrid", "lexical", "dense")


class Warnings(list):
    """What a search could not do, in words."""


def message_documents(messages: DataFrame) -> DataFrame:
    """(doc, text): what is indexed of messages; those without any text are not."""
    rows = messages.select(F.xxhash64("chat_id", "msg_id").alias("doc"), tx.index_text(F.col("text"), F.col("extracted")).alias("text"))
    return rows.where("text is not null")


def build_indexes(units: DataFrame, messages: DataFrame, folder: str | None = None) -> tuple[Index, Index]:
    """Indexes of units and of messages, written to a folder once; searches read only their terms' postings."""
    spark = units.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    found = Index(spark, f"{folder}/units")
    if not found.segments():
        found.add(units.select(F.col("unit_id").alias("doc"), "text"), number=1)
    return found, message_index(messages, folder)


def message_index(messages: DataFrame, folder: str) -> Index:
    """The index of messages alone, in its place below the folder of ``build_indexes``."""
    found = Index(messages.sparkSession, f"{folder}/messages")
    if not found.segments():
        found.add(message_documents(messages), number=1)
    return found


def index_delta(indexes: tuple[Index, Index], gone: DataFrame, new: DataFrame, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """Bring the indexes up to date after units went and came (see ``upkeep``), and messages changed or were removed.

    A message whose text is empty now leaves the index.
    """
    indexes[0].add(new.select(F.col("unit_id").alias("doc"), "text"), gone.select(F.col("unit_id").alias("doc")))
    if changed is not None or removed is not None:
        rows = changed if changed is not None else removed.limit(0)
        keys = rows.select("chat_id", "msg_id") if removed is None else rows.select("chat_id", "msg_id").unionByName(removed.select("chat_id", "msg_id"))
        indexes[1].add(message_documents(rows), keys.select(F.xxhash64("chat_id", "msg_id").alias("doc")))


def message_places(messages: DataFrame, units: DataFrame, scores: DataFrame, terms: int, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """(unit_id, place, anchor): units by the best message they hold; messages in no unit are passed over."""
    docs = messages.select("chat_id", "msg_id", "topic_id", F.xxhash64("chat_id", "msg_id").alias("doc"))
    if allowed is not None:
        scores = scores.join(allowed.select(F.xxhash64("chat_id", "msg_id").alias("doc")), "doc", "left_semi")
    hits = and_then_or(scores, terms, limit, "doc")
    rows = docs.join(F.broadcast(hits), "doc").select("chat_id", "msg_id", "topic_id", "place")
    held = containing_unit(rows, units).where("unit_id is not null")
    best = held.groupBy("unit_id").agg(F.min("place").alias("_p"), F.min_by("msg_id", "place").alias("anchor"))
    return best.select("unit_id", F.row_number().over(Window.orderBy("_p")).alias("place"), "anchor")  # at most ``limit`` rows


def best_anchors(units: DataFrame, scores: DataFrame) -> DataFrame:
    """(unit_id, best): of the messages that each of some units lists, the one that any word of the query ranks best."""
    listed = units.select("unit_id", "chat_id", F.explode("msg_ids").alias("msg_id")).withColumn("doc", F.xxhash64("chat_id", "msg_id"))
    return scores.join(F.broadcast(listed), "doc").groupBy("unit_id").agg(F.max_by("msg_id", F.struct("score", -F.col("msg_id"))).alias("best"))


def search(
    units: DataFrame, messages: DataFrame, vectors: DataFrame | None, query: str, k: int = schema.K, mode: str = "hybrid", chats: list[int] | None = None,
    since: int | None = None, until: int | None = None, reranker: str | None = "overlap", embedder: str = "hashed", indexes: tuple[Index, Index] | None = None,
    space: dict[str, str] | None = None, reach: DataFrame | None = None,
) -> tuple[DataFrame, Warnings]:
    """The best k units for a query with score, place and the message to show; and warnings.

    ``units`` has a ``unit_id``; ``indexes`` are of units and messages (``build_indexes``; built for this search where
    none are given). Statistics of terms are those of the whole index; filters restrict what is returned: ``chats``,
    dates of units' starts and of messages, and ``reach``, the chats (chat_id) that an account reaches. ``space`` says
    which embedder made the vectors; those of another are refused. Without words the dense side answers alone, without
    vectors, or where embedder or reranker cannot run, what is left of the search does.
    """
    if mode not in MODES or k < 1:
        raise ValueError(f"mode is one of {', '.join(MODES)} and k at least 1")
    notes, limit = Warnings(), max(k, schema.RERANK_TOP)
    out = units.limit(0).select(*units.columns, F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("anchor"))
    if chats == []:
        return out, notes

    def within(rows: DataFrame, at: str) -> DataFrame:
        if chats is not None:
            rows = rows.where(F.col("chat_id").isin(sorted(chats)))
        if since is not None:
            rows = rows.where(F.col(at) >= since)
        if until is not None:
            rows = rows.where(F.col(at) <= until)
        return rows if reach is None else rows.join(reach.select("chat_id").distinct(), "chat_id", "left_semi")

    filtered = not (chats is None and since is None and until is None and reach is None)
    if reach is not None and reach.isEmpty():
        notes.append("the account reaches no chat")
    wanted = phrases(query)
    lists: list[DataFrame] = []
    anchors = scores = None
    if mode != "dense":
        if wanted:
            unit_index, message_index = indexes or build_indexes(units, messages)
            if not unit_index.stats()[0]:
                notes.append("the index is empty")
            allowed = within(units, "date_start").select(F.col("unit_id").alias("doc")) if filtered else None
            found = unit_index.search(query, limit, allowed)
            lists.append(found.select(F.col("doc").alias("unit_id"), "place"))
            scores = checkpointed(message_index.scores(query))
            dated = "date" in messages.columns
            rows = within(messages if dated else messages.withColumn("date", F.lit(None).cast("long")), "date") if filtered and (dated or (since is None and until is None)) else None
            anchors = checkpointed(message_places(messages, units, scores, len(wanted), limit, rows))
            if filtered and not dated:  # messages without dates follow their units
                anchors = anchors.join(within(units, "date_start").select("unit_id"), "unit_id", "left_semi")
            lists.append(anchors.select("unit_id", "place"))
        else:
            notes.append("the query has no searchable words")
    if mode != "lexical":
        if vectors is None:
            notes.append("there are no vectors: lexical results only")
        else:
            try:
                dense.check_space(space or {}, embedder)
                asked = dense.hashed_vector(query) if embedder == "hashed" else dense.EMBEDDERS[embedder][0]([query])[0]
                near = dense.knn(within(vectors, "date_start") if reach is not None else vectors, asked, limit, chats, since, until).where("distance < 1")
                lists.append(near.select("unit_id", F.row_number().over(Window.orderBy("distance", "unit_id")).alias("place")))
            except dense.EmbedderUnavailable as e:
                notes.append(f"the embedder cannot run: {e}; lexical results only")
    if not lists:
        return out, notes
    found = fused = checkpointed(rank.fuse(lists, units, "unit_id", limit))  # some forty rows, read several times below
    if reranker:
        try:
            found = rank.in_order(rank.reaction_bonus(rank.rerank(found, query, reranker)))
        except rank.RerankerUnavailable as e:
            found = fused
            notes.append(f"the reranker cannot run: {e}; fused order")
    found = checkpointed(rank.dedup(found).orderBy("place").limit(k))
    shown = found.withColumn("anchor", F.lit(None).cast("long"))
    if scores is not None:
        shown = found.join(anchors.select("unit_id", "anchor"), "unit_id", "left").join(best_anchors(found, scores), "unit_id", "left").withColumn("anchor", F.coalesce("anchor", "best"))
    listed = F.when(F.array_contains("msg_ids", F.col("anchor")), F.col("anchor"))
    return shown.withColumn("anchor", F.coalesce(listed, F.col("msg_ids")[0])).select(*units.columns, "score", "place", "anchor"), notes
