"""Sweeping deletions by witnesses: a message is gone only if every account that reaches its chat says so.

Accounts answer by id, page by page. An empty answer of one account proves nothing, as it may never have seen the
message; so the sweep divides the answers by the witnesses. There is no pairing of witnesses and ids: an id's empty
answers are counted, and so are its chat's witnesses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import numbered
from parlance.storage import checkpointed

#: Stored ids that are asked about together.
PAGE = 100


@dataclass
class Sweep:
    """Messages that are gone (chat_id, msg_id), and what became of each chat."""

    gone: DataFrame
    chats: DataFrame


def sweep(messages: DataFrame, reach: DataFrame, connected: DataFrame, answers: DataFrame, refusals: DataFrame, cursors: DataFrame | None = None, page: int = PAGE) -> Sweep:
    """What the answers of all witnesses say of the stored ``messages`` (chat_id, msg_id).

    ``reach`` (chat_id, account) are all accounts that a chat is known to be reached by, its witnesses; ``connected``
    (account) those that can be asked now; ``answers`` (chat_id, msg_id, account, there) what they said; ``refusals``
    (chat_id, account) who was refused the chat; ``cursors`` (chat_id, after) where an earlier sweep stopped.

    An id is settled if an account has it, or if every witness answers that it is empty. Pages are taken in order of
    id, and a page with an id that is not settled decides nothing and ends its chat's turn. The chats are told as
    (chat_id, outcome, removed, checked, after): ``unreachable`` if no connected account reaches it; ``remaining`` if a
    witness is not connected, if all were refused, or if a page was left unsettled; ``held`` if some were refused
    while another answered, which no later sweep changes; else ``done``, and ``after`` is null. Only pages before the
    first unsettled one are checked, and nothing is removed of chats that are unreachable or held or lack a witness.
    """
    witnesses = reach.select("chat_id", "account").where("account is not null").distinct()
    here = connected.select("account", F.lit(True).alias("_here")).distinct()
    refused = refusals.select("chat_id", "account", F.lit(True).alias("_refused")).distinct()
    said = answers.select("chat_id", "msg_id", "account", "there").where("there is not null")
    spoke = said.select("chat_id", "account", F.lit(True).alias("_spoke")).distinct()
    known = witnesses.join(here, "account", "left").join(refused, ["chat_id", "account"], "left").join(spoke, ["chat_id", "account"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    who = known.groupBy("chat_id").agg(
        F.count("*").alias("_witnesses"), F.sum(yes("_here").cast("long")).alias("_asked"), F.sum(yes("_refused").cast("long")).alias("_refusals"), F.sum((yes("_spoke") & yes("_here") & ~yes("_refused")).cast("long")).alias("_speakers")
    )
    # an account that was refused, is not connected or is no witness of the chat has no say
    may = known.where(yes("_here") & ~yes("_refused")).select("chat_id", "account")
    votes = said.join(may, ["chat_id", "account"], "left_semi").groupBy("chat_id", "msg_id").agg(F.max("there").alias("_there"), F.count_distinct(F.when(~F.col("there"), F.col("account"))).alias("_empty"))
    rows = messages.select("chat_id", "msg_id").distinct()
    if cursors is not None:
        rows = rows.join(cursors.select("chat_id", "after"), "chat_id", "left").where("after is null or msg_id > after").drop("after")
    rows = numbered(rows, ["chat_id"], "msg_id", "_turn").withColumn("_page", F.floor((F.col("_turn") - 1) / page)).drop("_turn")
    told = rows.join(votes, ["chat_id", "msg_id"], "left").join(who, "chat_id", "left")
    full = (F.col("_asked") == F.col("_witnesses")) & (F.col("_refusals") == 0)
    empty = ~yes("_there") & (F.coalesce("_empty", F.lit(0)) == F.col("_witnesses"))
    told = checkpointed(told.withColumn("_settled", F.coalesce(full & (yes("_there") | empty), F.lit(False))).withColumn("_gone", F.coalesce(full & empty, F.lit(False))))
    ends = told.groupBy("chat_id").agg(F.min(F.when(~F.col("_settled"), F.col("_page"))).alias("_end"))
    passed = told.join(ends, "chat_id").where("_end is null or _page < _end")
    gone = passed.where("_gone").select("chat_id", "msg_id")
    sums = passed.groupBy("chat_id").agg(F.count("*").alias("checked"), F.sum(F.col("_gone").cast("long")).alias("removed"), F.max("msg_id").alias("after"))
    outcome = (
        F.when(F.coalesce("_asked", F.lit(0)) == 0, "unreachable").when(F.col("_asked") < F.col("_witnesses"), "remaining").when((F.col("_refusals") > 0) & (F.col("_speakers") > 0), "held")
        .when((F.col("_refusals") > 0) | F.col("_end").isNotNull(), "remaining").otherwise("done")
    )
    chats = ends.join(who, "chat_id", "left").join(sums, "chat_id", "left").withColumn("outcome", outcome)
    if cursors is not None:
        chats = chats.join(cursors.select("chat_id", F.col("after").alias("_was")), "chat_id", "left").withColumn("after", F.coalesce("after", "_was")).drop("_was")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return Sweep(gone, chats.select("chat_id", "outcome", zero("removed"), zero("checked"), F.when(F.col("outcome") != "done", F.col("after")).alias("after")))


def asked(messages: DataFrame, reach: DataFrame, answers: DataFrame, account: str) -> DataFrame:
    """(chat_id, msg_id) that an account is to be asked about: of the chats it reaches, what no other has and it has not answered."""
    own = messages.select("chat_id", "msg_id").join(reach.where(F.col("account") == account).select("chat_id").distinct(), "chat_id", "left_semi")
    known = answers.where(F.col("there") | (F.col("account") == account)).select("chat_id", "msg_id").distinct()
    return own.join(known, ["chat_id", "msg_id"], "left_anti")
