"""Readers: a whole reply thread, the messages around one, and messages as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import links as ln
from parlance.functions import text as tx
from parlance.operators.ordered import numbered
from parlance.operators.units import reply_roots
from parlance.storage import checkpointed


def climb(messages: DataFrame, chat_id: int, msg_id: int) -> int | None:
    """The top of a message's reply chain; in a cycle, the message before the chain repeats; null if it is not stored.

    Tops are found for all of the chat at once, by doubling; only a chain that ends in a cycle is climbed by steps.
    """
    chat = messages.where(F.col("chat_id") == chat_id).select("chat_id", "msg_id", "reply_to_msg_id")
    if chat.where(F.col("msg_id") == msg_id).isEmpty():
        return None
    roots = checkpointed(reply_roots(chat))
    found = roots.where(F.col("msg_id") == msg_id).head()
    if found:
        return found.root
    rest = checkpointed(chat.join(roots.select("msg_id"), "msg_id", "left_anti"))  # what leads into cycles
    seen, at = set(), msg_id
    while True:
        row = rest.where(F.col("msg_id") == at).head()
        seen.add(at)
        if row is None or row.reply_to_msg_id is None or row.reply_to_msg_id in seen:
            return at
        at = row.reply_to_msg_id


def thread(messages: DataFrame, chat_id: int, msg_id: int) -> DataFrame:
    """The thread that a message is in: its root and all below, by time."""
    root = climb(messages, chat_id, msg_id)
    chat = messages.where(F.col("chat_id") == chat_id)
    if root is None:
        return chat.limit(0)
    own = chat.select("chat_id", "msg_id", F.when(F.col("msg_id") != root, F.col("reply_to_msg_id")).alias("reply_to_msg_id"))
    below = reply_roots(own).where(F.col("root") == root).select("msg_id")
    return chat.join(below, "msg_id", "left_semi").select(*messages.columns).orderBy("date", "msg_id")


def post_thread(messages: DataFrame, channel_id: int, post_id: int) -> DataFrame:
    """A channel's post thread, then the comments on the post, by time; comments are another chat's rows."""
    own = thread(messages, channel_id, post_id).withColumn("_kind", F.lit(0))
    comments = messages.where((F.col("comment_of_chat_id") == channel_id) & (F.col("comment_of_msg_id") == post_id)).withColumn("_kind", F.lit(1))
    return own.unionByName(comments).orderBy("_kind", "date", "msg_id").drop("_kind")


def context(messages: DataFrame, chat_id: int, msg_id: int, before: int = 15, after: int = 15) -> DataFrame:
    """A message and those before and after it in its chat and topic, by id."""
    if before < 0 or after < 0:
        raise ValueError("before and after must not be negative")
    chat = messages.where(F.col("chat_id") == chat_id)
    anchor = chat.where(F.col("msg_id") == msg_id).select("topic_id").head()
    if anchor is None:
        return chat.limit(0)
    same = chat.where(F.col("topic_id").eqNullSafe(F.lit(anchor.topic_id).cast("long")))
    early = same.where(F.col("msg_id") < msg_id).orderBy(F.desc("msg_id")).limit(before)
    late = same.where(F.col("msg_id") > msg_id).orderBy("msg_id").limit(after)
    return early.unionByName(same.where(F.col("msg_id") == msg_id)).unionByName(late).orderBy("msg_id")


def contexts(messages: DataFrame, anchors: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """(chat_id, anchor, msg_id, step) for many anchors at once: one numbering of each chat's topics and one join."""
    rows = numbered(messages.select("chat_id", "topic_id", "msg_id"), ["chat_id", "topic_id"], "msg_id", "n")
    asked = rows.join(anchors.select("chat_id", "msg_id").distinct(), ["chat_id", "msg_id"]).select("chat_id", "topic_id", F.col("msg_id").alias("anchor"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("step"), "n")
    asked = asked.select(F.col("chat_id").alias("_chat"), F.col("topic_id").alias("_topic"), "anchor", "step", (F.col("n") + F.col("step")).alias("_n"))
    on = (F.col("chat_id") == F.col("_chat")) & (F.col("n") == F.col("_n")) & F.col("topic_id").eqNullSafe(F.col("_topic"))
    return rows.join(asked, on).select("chat_id", "anchor", "msg_id", "step")


def message_views(messages: DataFrame, chats: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(chat_id, peer_id, msg_id, date, from_name, text, url, fallback, reply_to_msg_id, accounts): messages as they are shown.

    The text is the body that a unit's line has; ``reach`` is (chat_id, accounts), see ``chats.provenance``.
    """
    c = chats.select(F.col("id").alias("chat_id"), "type", F.col("peer_id"), "username", F.coalesce("is_forum", F.lit(False)).alias("_forum"))
    joined = messages.join(c, "chat_id")
    joined = joined.join(reach, "chat_id", "left") if reach is not None else joined.withColumn("accounts", F.array().cast("array<string>"))
    url = ln.message_url(F.col("type"), F.col("peer_id"), F.col("username"), F.col("_forum"), F.col("msg_id"), F.col("topic_id"))
    body = tx.body(F.col("text"), F.col("media_kind"), F.col("media_filename"), F.col("extracted"))
    return joined.select("chat_id", "peer_id", "msg_id", "date", "from_name", body.alias("text"), url.alias("url"), ln.fallback_url(F.col("type"), F.col("peer_id")).alias("fallback"), "reply_to_msg_id", F.coalesce("accounts", F.array().cast("array<string>")).alias("accounts"))
