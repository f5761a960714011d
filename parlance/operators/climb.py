"""Reply chains from what changed: up to their tops and down again, a level at a time, reading only what is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.units import reply_roots
from parlance.storage import checkpointed, shuffled

#: Levels that are climbed or descended one by one; chains that are longer are looked up as a whole.
LEVELS = 24
#: Rows of a frontier that may be broadcast.
FEW = 200_000


def _small(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows``, written, as one side of a join with all messages; broadcast where their number is small, and that number."""
    own = checkpointed(rows)
    n = own.count()
    return (F.broadcast(own) if n <= FEW else shuffled(own)), n


def tops_of(messages: DataFrame, ids: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(chat_id, root) of the stored messages ``ids`` (chat_id, msg_id), and (chat_id) of chats whose chains go on after so many levels.

    A parent counts if it is another stored message of the chat. Chains of one top meet on the way up.
    """
    own = messages.select("chat_id", F.col("msg_id").alias("at"), F.when(F.col("reply_to_msg_id") != F.col("msg_id"), F.col("reply_to_msg_id")).alias("up"))
    ends: list[DataFrame] = []
    front = ids.select("chat_id", F.col("msg_id").alias("at"), F.lit(None).cast("long").alias("child")).distinct()
    for _ in range(levels + 1):
        near, n = _small(front)
        if not n:
            break
        met = checkpointed(near.join(own, ["chat_id", "at"]).select("chat_id", "at", "up").distinct())
        ends.append(met.where("up is null").select("chat_id", F.col("at").alias("root")))
        missed = near.where("child is not null").join(shuffled(met.select("chat_id", "at")), ["chat_id", "at"], "left_anti")
        ends.append(missed.select("chat_id", F.col("child").alias("root")))
        front = met.where("up is not null").select("chat_id", F.col("up").alias("at"), F.col("at").alias("child"))
    found = ends[0] if ends else ids.select("chat_id", F.col("msg_id").alias("root")).limit(0)
    for e in ends[1:]:
        found = found.unionByName(e)
    return found.distinct(), front.select("chat_id").distinct()


def below(messages: DataFrame, roots: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(chat_id, msg_id, root): the ``roots`` (chat_id, root) and all below each; and (chat_id, root) of those that go on after so many levels."""
    own = messages.where("reply_to_msg_id is not null and reply_to_msg_id <> msg_id").select("chat_id", "msg_id", F.col("reply_to_msg_id").alias("at"))
    front = roots.select("chat_id", F.col("root").alias("msg_id"), "root").distinct()
    found = front
    for _ in range(levels):
        near, n = _small(front.select("chat_id", F.col("msg_id").alias("at"), "root"))
        if not n:
            break
        front = near.join(own, ["chat_id", "at"]).select("chat_id", "msg_id", "root").where("msg_id <> root")
        found = found.unionByName(front)
    return found, front.select("chat_id", "root").distinct()


def chains(messages: DataFrame, ids: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(chat_id, msg_id, root) of all messages in the reply chains that the stored messages ``ids`` (chat_id, msg_id) belong to.

    Members of a cycle have no top and are left out. Where a chain has more levels, its chat is looked up as a whole,
    by pointers that double their reach, so that the rounds stay few.
    """
    roots, tall = tops_of(messages, ids, levels)
    members, deep = below(messages, roots, levels)
    long = checkpointed(tall.unionByName(deep.select("chat_id")).distinct())
    if long.isEmpty():
        return members.distinct()
    whole = checkpointed(reply_roots(messages.join(long, "chat_id", "left_semi")))
    mine = whole.join(ids.select("chat_id", "msg_id").distinct(), ["chat_id", "msg_id"], "left_semi").select("chat_id", "root").distinct()
    return members.join(long, "chat_id", "left_anti").distinct().unionByName(whole.join(mine, ["chat_id", "root"], "left_semi").select("chat_id", "msg_id", "root"))
