"""The registry of queries, and the given tables read as chats.

Conversations and events stand for chats: a conversation is a chat and its turns are messages; a user's events are a
chat on a time line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE = 1_704_067_200

TALKS = f"""talks AS (
  SELECT conv_id AS chat_id, turn AS msg_id, {BASE} + turn * 60 + turn // 5 * 3600 AS date, role AS from_name, text,
    CASE WHEN turn % 3 > 0 THEN turn - 1 END AS reply_to_msg_id, (conv_id * 7 + turn) % 11 AS reactions
  FROM conversations)"""

EVENTS = """notes AS (
  SELECT user_id AS chat_id, event_id AS msg_id, CAST(floor(epoch(ts)) AS BIGINT) AS date, event_type AS text, CAST(floor(value) AS BIGINT) AS reactions,
    '[' || strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || '] id' || user_id || ': ' || event_type AS line
  FROM events)"""


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: a minute a turn, an hour's pause every five, chains of three replies."""
    t = table(spark, sf_dir, "conversations")
    null = lambda kind: F.lit(None).cast(kind)
    return t.select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("msg_id"), (F.lit(BASE) + F.col("turn") * 60 + F.floor(F.col("turn") / 5) * 3600).alias("date"), null("long").alias("from_id"), F.col("role").alias("from_name"), "text",
        F.when(F.col("turn") % 3 > 0, F.col("turn") - 1).alias("reply_to_msg_id"), null("long").alias("topic_id"), null("string").alias("media_kind"), null("string").alias("media_filename"), null("string").alias("extracted"),
        ((F.col("conv_id") * 7 + F.col("turn")) % 11).alias("reactions"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their users."""
    e = table(spark, sf_dir, "events")
    date = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = e.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("msg_id"), F.lit(None).cast("long").alias("topic_id"), date.alias("date"), F.col("event_type").alias("text"), F.floor("value").alias("reactions"))
    return rows.withColumn("line", tx.line(F.col("date"), tx.sender(F.lit(""), F.col("chat_id")), F.col("text")))
