"""Live feeds: rows of messages as a client hands them over, mapped to stored messages, new ones and comments picked out.

A feed's rows are files in a landing folder (``FEED``); a stream reads each file once, and what is below a chat's
high-water mark is passed over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import links as ln
from parlance.functions import text as tx
from parlance.schema import MESSAGES

FEED = (
    "chat_id long, id long, date long, edit_date long, service boolean, sender_id long, sender_name string, text string, "
    "reply struct<to:long,top:long,forum_topic:boolean,peer_id:long>, "
    "media struct<kind:string,filename:string,voice:boolean,round:boolean,video:boolean,attributes:array<struct<type:string,voice:boolean,round:boolean>>,"
    "question:string,answers:array<string>,title:string,address:string,first_name:string,last_name:string,url:string>, "
    "forward struct<from_id:long,channel_post:long,saved_from_peer:long,saved_from_msg:long,from_name:string,post_author:string,date:long>, "
    "reactions array<struct<count:long>>, entities array<struct<type:string,offset:int,length:int,url:string,user_id:long>>, buttons array<string>, replies long"
)
COMMENTS = f"channel_id long, post_id long, {FEED}"

# What entities are, as kinds of links.
LINK_ENTITIES = {"url": "link", "text_url": "text_url", "mention": "mention", "mention_name": "mention"}
MEDIA_KINDS = ("photo", "document", "webpage", "poll", "contact", "location")


def document_kind(media: Column) -> Column:
    """What a document is: a sticker; else what its first sound or picture attribute says; else animation, flags, document."""
    of = lambda *types: F.filter(media["attributes"], lambda a: a["type"].isin(*types))
    first = F.get(of("audio", "video"), F.lit(0))
    has = lambda name: F.size(F.coalesce(of(name), F.array())) > 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(has("sticker"), "sticker")
        .when(first["type"] == "audio", F.when(yes(first["voice"]), "voice").otherwise("audio"))
        .when(first["type"] == "video", F.when(yes(first["round"]), "video_note").otherwise("video"))
        .when(has("animated"), "video").when(yes(media["voice"]), "voice").when(yes(media["round"]), "video_note").when(yes(media["video"]), "video").otherwise("document")
    )


def media_kind(media: Column) -> Column:
    kind = F.when(media["kind"] == "document", document_kind(media)).when(media["kind"].isin(*MEDIA_KINDS), media["kind"])
    return F.when(media["kind"].isNotNull(), F.coalesce(kind, F.lit("other")))


def media_text(media: Column) -> Column:
    """What polls, places and contacts carry in place of a text."""
    lines = lambda *parts: F.concat_ws("\n", *parts)
    poll = lines(tx.filled(media["question"]), F.filter(media["answers"], lambda a: a.isNotNull() & (a != "")))
    return F.when(media["kind"] == "poll", poll).when(media["kind"] == "location", lines(tx.filled(media["title"]), tx.filled(media["address"]))).when(media["kind"] == "contact", F.concat_ws(" ", tx.filled(media["first_name"]), tx.filled(media["last_name"]))).otherwise("")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Slices of texts by UTF-16 code units, as feeds count them."""
    out = []
    for t, a, n in zip(text, starts, sizes, strict=True):
        raw = (t or "").encode("utf-16-le")
        out.append(None if a is None else [raw[2 * int(i) : 2 * int(i + k)].decode("utf-16-le", "ignore") for i, k in zip(a, n, strict=True)])
    return pd.Series(out)


def reply_of(reply: Column, peer: Column) -> tuple[Column, Column]:
    """(parent, topic): in a forum a header that names only the topic is no reply; one into another chat never is."""
    forum = F.coalesce(reply["forum_topic"], F.lit(False))
    topic = F.when(forum, F.coalesce(reply["top"], reply["to"]))
    parent = F.when(~(forum & reply["top"].isNull()) & (reply["peer_id"].isNull() | (reply["peer_id"] == peer)), reply["to"])
    return parent, topic


def forward_origin(f: Column) -> tuple[Column, Column]:
    """(peer, message) that a forward came from: the post, else where it was saved from, else its author alone, else nothing."""
    post = f["from_id"].isNotNull() & f["channel_post"].isNotNull()
    saved = f["saved_from_peer"].isNotNull() & f["saved_from_msg"].isNotNull()
    return F.when(post, f["from_id"]).when(saved, f["saved_from_peer"]).otherwise(f["from_id"]), F.when(post, f["channel_post"]).when(saved, f["saved_from_msg"])


def feed_messages(rows: DataFrame, chats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Messages, in the columns of ``schema.MESSAGES``, from rows of a feed; service entries, and those without id or date, are left out.

    ``chats`` (id, peer_id, title) are those read; rows of others are left out. ``names`` (id, name) are of peers.
    """
    about = chats.select(F.col("id").alias("chat_id"), F.col("peer_id").alias("_peer"), F.col("title").alias("_title"))
    rows = rows.where(~F.coalesce("service", F.lit(False)) & F.col("id").isNotNull() & F.col("date").isNotNull()).join(about, "chat_id")
    if names is not None:
        known = names.select(F.col("id").alias("_id"), F.col("name"))
        rows = rows.join(known.select(F.col("_id").alias("sender_id"), F.col("name").alias("_sender")), "sender_id", "left")
        rows = rows.withColumn("_author", F.col("forward.from_id")).join(known.select(F.col("_id").alias("_author"), F.col("name").alias("_origin")), "_author", "left")
    else:
        rows = rows.withColumn("_sender", F.lit(None).cast("string")).withColumn("_origin", F.lit(None).cast("string"))
    named = F.filter("entities", lambda e: e["type"].isin(*LINK_ENTITIES))
    rows = rows.withColumn("_e", named).withColumn("_p", _pieces(F.col("text"), F.transform("_e", lambda e: e["offset"]), F.transform("_e", lambda e: e["length"])))
    kind = lambda e: F.element_at(F.create_map(*[F.lit(x) for p in LINK_ENTITIES.items() for x in p]), e["type"])
    value = lambda e, p: F.when(e["type"] == "text_url", e["url"]).when(e["type"] == "mention_name", F.concat(F.lit("peer:"), e["user_id"].cast("string"))).otherwise(p)
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), ln.identity(v).alias("target"))
    none = F.array().cast("array<struct<kind:string,target:string>>")
    m, f = F.col("media"), F.col("forward")
    links = F.concat(
        F.coalesce(F.zip_with("_e", "_p", lambda e, p: F.struct(kind(e).alias("kind"), ln.identity(value(e, p)).alias("target"))), none),
        F.coalesce(F.transform("buttons", lambda b: one("button", b)), none),
        F.when((m["kind"] == "webpage") & m["url"].isNotNull(), F.array(one("webpage", m["url"]))).otherwise(none),
    )
    parent, topic = reply_of(F.col("reply"), F.col("_peer"))
    peer, post = forward_origin(f)
    sender = F.when((F.col("sender_id") == F.col("_peer")) & F.col("_sender").isNull() & tx.filled(F.col("_title")).isNotNull(), F.col("_title")).otherwise(F.coalesce("_sender", tx.filled(F.col("sender_name"))))
    origin = F.coalesce(F.col("_origin"), tx.filled(f["from_name"]), tx.filled(f["post_author"]), F.concat(F.lit("id"), f["from_id"].cast("string")), F.lit("unknown"))
    out = {
        "chat_id": F.col("chat_id"), "msg_id": F.col("id"), "date": F.col("date"), "edit_date": F.col("edit_date"), "from_id": F.col("sender_id"), "from_name": sender, "reply_to_msg_id": parent, "topic_id": topic,
        "text": F.coalesce(tx.filled(F.col("text")), media_text(m), F.lit("")), "media_kind": media_kind(m), "media_filename": F.when(m["kind"] == "document", m["filename"]), "media_state": F.lit(0),
        "reactions": F.coalesce(F.aggregate("reactions", F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r["count"], F.lit(0))), F.lit(0).cast("long")),
        "fwd_from_id": F.when(f.isNotNull(), peer), "fwd_msg_id": F.when(f.isNotNull(), post), "fwd_from_name": F.when(f.isNotNull(), origin), "fwd_date": f["date"],
        "links": F.array_sort(F.array_distinct(F.filter(links, lambda x: x["target"].isNotNull()))), "links_read": F.lit(True), "indexed": F.lit(False),
    }
    return rows.select(*[out.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in T.StructType.fromDDL(MESSAGES).fields])


def read_feed(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the feed's JSON lines in a landing folder; its checkpoint knows which files were read."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_a_batch).json(folder)


def new_messages(rows: DataFrame, chats: DataFrame, since: int | None = None) -> DataFrame:
    """Rows of a feed above their chat's ``last_msg_id``; of chats without any progress those from ``since`` on."""
    mark = chats.select(F.col("id").alias("chat_id"), F.coalesce("last_msg_id", F.lit(0)).alias("_last"))
    ahead = rows.join(mark, "chat_id").where(F.col("id") > F.col("_last"))
    if since is not None:
        ahead = ahead.where((F.col("_last") > 0) | (F.col("date") >= since))
    return ahead.select(*rows.columns)


def advanced(chats: DataFrame, batch: DataFrame, now: int | None = None) -> DataFrame:
    """Chats with their high-water marks after a batch, service entries included; marks never fall."""
    top = batch.groupBy(F.col("chat_id").alias("id")).agg(F.max("id").alias("_top"))
    joined = chats.join(top, "id", "left")
    out = joined.withColumn("last_msg_id", F.greatest("last_msg_id", "_top"))
    if now is not None:
        out = out.withColumn("last_sync_at", F.when(F.col("_top").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_sync_at")))
    return out.select(*chats.columns)


def comment_messages(rows: DataFrame, chats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Messages of comment threads (``COMMENTS``), stored under their channel's discussion group with the post they hang under."""
    groups = chats.where("discussion_of is not null").select(F.col("discussion_of").alias("channel_id"), F.col("id").alias("_group"))
    placed = rows.join(groups, "channel_id").withColumn("chat_id", F.col("_group"))
    keys = placed.select("chat_id", F.col("id").alias("msg_id"), F.col("channel_id").alias("_channel"), F.col("post_id").alias("_post")).dropDuplicates(["chat_id", "msg_id"])
    found = feed_messages(placed.drop("_group", "channel_id", "post_id").dropDuplicates(["chat_id", "id"]), chats, names)
    return found.join(keys, ["chat_id", "msg_id"]).withColumn("comment_of_chat_id", F.col("_channel")).withColumn("comment_of_msg_id", F.col("_post")).select(*found.columns)


def grown_threads(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(chat_id, msg_id): posts whose feed tells of more replies than comments are stored."""
    have = stored.where("comment_of_msg_id is not null").groupBy(F.col("comment_of_chat_id").alias("chat_id"), F.col("comment_of_msg_id").alias("id")).agg(F.count("*").alias("_n"))
    return rows.where("replies > 0").join(have, ["chat_id", "id"], "left").where(F.col("replies") > F.coalesce("_n", F.lit(0))).select("chat_id", F.col("id").alias("msg_id"))
