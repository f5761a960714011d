"""Queries of sources: exports made of conversations and read back, imports, feeds and comment threads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import dates, links, text
from parlance.operators import units
from parlance.queries.base import BASE, ORACLES, TALKS, query, table, talks
from parlance.sources import export, feeds, large_export, live
from parlance.storage import shared_folder

_KINDS = ("personal_chat", "private_group", "public_supergroup", "private_channel", "no_such_chat")


def _exports(spark: SparkSession, sf_dir: str, cuts: bool = True) -> DataFrame:
    """(file, text): an export of one chat for each conversation, of all shapes that a message has; some files are cut."""
    c, t = F.col("conv_id"), F.col("turn")
    i = t % 8
    plain = F.to_json(F.struct(F.col("text").alias("x")))
    body = F.expr("substring(x, 6, length(x) - 6)")
    row = table(spark, sf_dir, "conversations").withColumn("x", plain).withColumn("q", body)  # q: the text as a JSON string

    def fields(*pairs: tuple[str, Column]) -> Column:
        return F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs])

    number = lambda v: v.cast("string")
    said = F.when(i == 1, F.concat(F.lit('["see ",{"type":"text_link","text":"there","href":"https://t.me/Some_Name/'), number(c), F.lit('"},{"type":"mention_name","text":"Bo","user_id":7}]'))).when(i == 2, F.lit('""')).otherwise(F.col("q"))
    date = F.when(i == 3, F.concat(F.lit('"date":"2024-01-01T0'), number(t % 10), F.lit(':00:00"'))).otherwise(F.concat(F.lit('"date_unixtime":"'), number(F.lit(BASE) + t), F.lit('"')))
    more = (
        F.when(i == 2, F.lit(',"poll":{"question":"Q?","answers":[{"text":"A"},{"text":""},{"text":"B"}]}'))
        .when(i == 3, F.lit(',"photo":"p/x.jpg","reactions":[{"type":"emoji","count":2},{"type":"emoji","count":3}]'))
        .when(i == 4, F.lit(',"file":"f/y z.pdf","media_type":"voice_message","forwarded_from":null,"forwarded_from_id":"channel8"'))
        .when(i == 5, F.concat(F.lit(',"reply_to_message_id":'), number(t), F.when(c % 2 == 0, F.lit(',"reply_to_peer_id":"channel5"')).otherwise(F.lit(""))))
        .when(i == 6, F.lit(',"file":"(not included)","mime_type":"x/y","edited_unixtime":"99"'))
        .otherwise(F.lit(""))
    )
    kind = F.when(i == 7, '"service"').when((i == 0) & (c % 5 == 1), '"odd"').otherwise('"message"')
    message = F.concat(F.lit("{"), fields(("id", F.when((i == 0) & (c % 5 == 2), F.lit('"none"')).otherwise(number(t + 1))), ("type", kind), ("from", F.lit('" Ann "')), ("from_id", F.lit('"user5"')), ("text", said)), F.lit(","), date, more, F.lit("}"))
    listed = row.select(c.alias("c"), F.struct(t.alias("t"), message.alias("m")).alias("m")).groupBy("c").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    names = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c") % 5 + 1).cast("int"))
    whole = F.concat(F.lit('{"name":" Room '), F.col("c").cast("string"), F.lit('","type":"'), names, F.lit('","id":'), (F.col("c") + 1).cast("string"), F.lit(',"messages":['), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]}"))
    cut = F.when((F.col("c") % 3 == 0) & F.lit(cuts), F.expr("substring(w, 1, length(w) - 2)")).otherwise(F.col("w"))  # as a stopped export leaves it
    return listed.select(F.concat(F.lit("chat"), F.col("c").cast("string")).alias("file"), whole.alias("w"), "c").select("file", cut.alias("text"))


_EXPORTS = f"""e AS (SELECT conv_id AS c, turn AS t, turn % 8 AS i, text FROM conversations WHERE conv_id % 5 < 4),
x AS (SELECT *, CASE c % 5 WHEN 0 THEN c + 1 WHEN 1 THEN -(c + 1) ELSE -(1000000000000 + c + 1) END AS chat_id FROM e),
m AS (SELECT * FROM x WHERE i <> 7 AND NOT (i = 0 AND c % 5 IN (1, 2)))"""


@query(f"""WITH {_EXPORTS} SELECT chat_id, t + 1 AS msg_id, CASE WHEN i = 3 THEN {BASE} + t % 10 * 3600 ELSE {BASE} + t END AS date, CAST(CASE WHEN i = 6 THEN 99 END AS BIGINT) AS edit_date, CAST(5 AS BIGINT) AS from_id, 'Ann' AS from_name,
  CASE WHEN i = 5 AND c % 2 = 1 THEN t END AS reply_to_msg_id, CASE i WHEN 1 THEN 'see thereBo' WHEN 2 THEN 'Q?' || chr(10) || 'A' || chr(10) || 'B' ELSE text END AS text,
  CASE i WHEN 2 THEN 'poll' WHEN 3 THEN 'photo' WHEN 4 THEN 'voice' WHEN 6 THEN 'document' END AS media_kind, CASE i WHEN 4 THEN 'y z.pdf' END AS media_filename, CAST(CASE WHEN i = 3 THEN 5 ELSE 0 END AS BIGINT) AS reactions,
  CASE WHEN i = 4 THEN -1000000000008 END AS fwd_from_id, CASE WHEN i = 4 THEN 'unknown' END AS fwd_from_name, CASE WHEN i = 1 THEN 'mention peer:7' || CASE WHEN c > 0 THEN ' text_url @some_name/' || c ELSE '' END END AS links FROM m""")
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of exports: plain texts and runs, polls, photos, files, forwards, replies, both kinds of dates, cut files."""
    return _export_columns(export.messages(export.entries(_exports(spark, sf_dir))))


def _export_columns(m: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("links", lambda x: F.concat(x["kind"], F.lit(" "), x["target"])), " ")
    return m.select("chat_id", "msg_id", "date", "edit_date", "from_id", "from_name", "reply_to_msg_id", "text", "media_kind", "media_filename", "reactions", "fwd_from_id", "fwd_from_name", shown.alias("links"))


@query(ORACLES["export_messages"])
def ranged_export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages from an account's export, one file that is read by ranges of bytes."""
    folder = f"{shared_folder(spark)}/export-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    place = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    chats = _exports(spark, sf_dir, cuts=False).select((place + 1).alias("i"), F.concat(F.when(place > 0, ",").otherwise(""), "text").alias("value"))
    ends = spark.createDataFrame([(0, '{"about":"]","chats":{"list":['), (1 << 60, "]}}")], "i long, value string")
    chats.unionByName(ends).repartition(1).sortWithinPartitions("i").select("value").write.text(folder)  # one file is what an export is
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in files.listStatus(make(folder)) if x.getPath().getName().startswith("part-"))
    files.rename(part, make(folder, "result.json"))
    return _export_columns(export.messages(large_export.read_large(spark, folder)))



@query("""WITH x AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id % 5 < 4)
SELECT CASE c % 5 WHEN 0 THEN c + 1 WHEN 1 THEN -(c + 1) ELSE -(1000000000000 + c + 1) END AS id, ['user', 'group', 'supergroup', 'channel'][CAST(c % 5 AS INT) + 1] AS type, 'Room ' || c AS title, true AS unavailable FROM x""")
def export_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of exports: of known types, with marked ids."""
    return export.chats(export.entries(_exports(spark, sf_dir))).select("id", "type", "title", "unavailable")


@query("""WITH e AS (SELECT conv_id AS c, turn % 8 AS i FROM conversations WHERE conv_id % 5 < 4)
SELECT CASE WHEN i = 7 THEN 'service' WHEN c % 5 = 1 THEN 'unknown type' ELSE 'no id' END AS reason, count(*) AS n FROM e WHERE i = 7 OR (i = 0 AND c % 5 IN (1, 2)) GROUP BY 1
UNION ALL SELECT 'a chat of an unknown type', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 5 = 4 UNION ALL SELECT 'the file is cut short', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 3 = 0""")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of exports is not stored, by reason."""
    return export.report(export.entries(_exports(spark, sf_dir)))


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '!?' ELSE c_mktsegment || ' ' || c_custkey % 50 || '!' END AS title FROM customer WHERE c_custkey % 3 > 0),
s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'chat-' || id ELSE replace(lower(title), ' ', '-') END AS slug FROM c), t AS (SELECT id, rtrim(slug, '!') AS slug FROM s)
SELECT id, 'import:' || slug || CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN '-' || id ELSE '' END AS source_id FROM t
UNION ALL SELECT c_custkey, 'import:old' FROM customer WHERE c_custkey % 3 = 0""")
def imported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of customers as private chats, imported beside earlier imports: named after their titles, by id where these clash."""
    key = F.col("c_custkey")
    title = F.when(key % 4 == 0, "!?").otherwise(F.concat("c_mktsegment", F.lit(" "), (key % 50).cast("string"), F.lit("!")))
    c = schema.conform(table(spark, sf_dir, "customer").select(key.alias("id"), key.alias("peer_id"), F.lit("user").alias("type"), title.alias("title")), schema.CHATS)
    stored = c.where("id % 3 = 0").withColumn("source_id", F.lit("import:old")).withColumn("scope", F.lit("default"))
    every, _ = export.import_chats(stored, c.where("id % 3 > 0"), spark.createDataFrame([], schema.MESSAGES))
    return every.select("id", "source_id")


# ------------------------------------------------------------------------ feeds


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows of a feed, of all shapes that these have."""
    t = table(spark, sf_dir, "conversations")
    c, n = F.col("conv_id"), F.col("turn")
    i = n % 8
    typed = {f.name: f.dataType for f in spark.createDataFrame([], feeds.FEED).schema.fields}

    def struct(name: str, **values: Column) -> Column:
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in typed[name].fields])

    attribute = lambda kind, voice=False, round_=False: F.struct(F.lit(kind).alias("type"), F.lit(voice).alias("voice"), F.lit(round_).alias("round"))
    media = (
        F.when(i == 1, struct("media", kind=F.lit("document"), filename=F.lit("a.ogg"), attributes=F.array(attribute("filename"), attribute("audio", voice=True))))
        .when(i == 2, struct("media", kind=F.lit("document"), attributes=F.array(attribute("video"), attribute("sticker"))))
        .when(i == 3, struct("media", kind=F.lit("webpage"), url=F.concat(F.lit("https://t.me/Page_"), c.cast("string"))))
        .when(i == 4, struct("media", kind=F.lit("poll"), question=F.lit("Q"), answers=F.array(F.lit("A"), F.lit("B"))))
        .when(i == 5, struct("media", kind=F.lit("document"), round=F.lit(True), attributes=F.array(attribute("filename"))))
        .when(i == 6, struct("media", kind=F.lit("game")))
    )
    reply = F.when(n % 3 == 1, struct("reply", to=n - 1, forum_topic=c % 2 == 0)).when(n % 3 == 2, struct("reply", to=n - 1, top=F.lit(0), forum_topic=c % 2 == 0, peer_id=F.when(n % 4 == 1, F.lit(-5))))
    forward = F.when(i == 2, struct("forward", from_id=F.lit(-9), channel_post=F.lit(4), date=F.lit(10))).when(i == 3, struct("forward", saved_from_peer=F.lit(-8), saved_from_msg=F.lit(3), from_name=F.lit("Hidden"))).when(i == 4, struct("forward", from_id=F.lit(12)))
    entity = F.when(i == 0, F.array(F.struct(F.lit("mention").alias("type"), F.lit(3).alias("offset"), F.lit(10).alias("length"), F.lit(None).alias("url"), F.lit(None).alias("user_id"))))
    values = {
        "chat_id": c, "id": n + 1, "date": F.lit(BASE) + n, "service": i == 7, "sender_id": F.when(n % 2 == 0, c).otherwise(F.lit(3)), "sender_name": F.when(n % 2 == 1, F.lit("Eve")),
        "text": F.when(i == 4, "").when(i == 0, F.concat(F.lit("🙂 @Some_Name "), F.col("text"))).otherwise(F.col("text")), "media": media, "reply": reply, "forward": forward,
        "reactions": F.array(F.struct((n % 4).alias("count"))), "entities": entity, "buttons": F.when(i == 5, F.array(F.concat(F.lit("t.me/+Abc"), c.cast("string")))), "replies": n % 3,
    }
    return t.select(*[values.get(k, F.lit(None)).cast(v).alias(k) for k, v in typed.items()])


def _rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return schema.conform(ids.select("id", F.col("id").alias("peer_id"), F.concat(F.lit("Room "), F.col("id").cast("string")).alias("title"), (F.col("id") % 4).alias("last_msg_id")), schema.CHATS)


@query(f"""WITH f AS (SELECT conv_id AS c, turn AS n, turn % 8 AS i, text FROM conversations WHERE turn % 8 <> 7)
SELECT c AS chat_id, n + 1 AS msg_id, {BASE} + n AS date, CASE WHEN n % 2 = 0 THEN c ELSE 3 END AS from_id, CASE WHEN n % 2 = 0 OR c = 3 THEN 'Room ' || c ELSE 'Eve' END AS from_name,
  CASE WHEN n % 3 = 0 OR (n % 3 = 1 AND c % 2 = 0) OR (n % 3 = 2 AND n % 4 = 1) THEN NULL ELSE n - 1 END AS reply_to_msg_id, CASE WHEN c % 2 = 0 AND n % 3 = 1 THEN n - 1 WHEN c % 2 = 0 AND n % 3 = 2 THEN 0 END AS topic_id,
  CASE i WHEN 4 THEN 'Q' || chr(10) || 'A' || chr(10) || 'B' WHEN 0 THEN '🙂 @Some_Name ' || text ELSE text END AS text, CASE i WHEN 1 THEN 'voice' WHEN 2 THEN 'sticker' WHEN 3 THEN 'webpage' WHEN 4 THEN 'poll' WHEN 5 THEN 'video_note' WHEN 6 THEN 'other' END AS media_kind,
  CASE i WHEN 1 THEN 'a.ogg' END AS media_filename, n % 4 AS reactions, CASE i WHEN 2 THEN -9 WHEN 3 THEN -8 WHEN 4 THEN 12 END AS fwd_from_id, CASE i WHEN 2 THEN 4 WHEN 3 THEN 3 END AS fwd_msg_id,
  CASE i WHEN 2 THEN 'id-9' WHEN 3 THEN 'Hidden' WHEN 4 THEN 'id12' END AS fwd_from_name, CASE i WHEN 0 THEN 'mention @some_name' WHEN 3 THEN 'webpage @page_' || c WHEN 5 THEN 'button +Abc' || c ELSE '' END AS links FROM f""")
def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a feed: senders, replies and topics, media by attributes and flags, forwards, links by entities, buttons, previews."""
    m = feeds.feed_messages(_feed(spark, sf_dir), _rooms(spark, sf_dir))
    shown = F.array_join(F.transform("links", lambda x: F.concat(x["kind"], F.lit(" "), x["target"])), " ")
    return m.select("chat_id", "msg_id", "date", "from_id", "from_name", "reply_to_msg_id", "topic_id", "text", "media_kind", "media_filename", "reactions", "fwd_from_id", "fwd_msg_id", "fwd_from_name", shown.alias("links"))


@query(f"""WITH f AS (SELECT conv_id AS c, turn + 1 AS id, {BASE} + turn AS date FROM conversations) SELECT c AS chat_id, id AS msg_id FROM f WHERE id > c % 4 AND (c % 4 > 0 OR date >= {BASE + 2})""")
def new_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a feed above each chat's high-water mark; of chats without one those from a date on."""
    return feeds.new_messages(_feed(spark, sf_dir), _rooms(spark, sf_dir), since=BASE + 2).select("chat_id", F.col("id").alias("msg_id"))


@query("SELECT conv_id AS id, greatest(max(CASE WHEN turn % 2 = 0 THEN turn + 1 END), conv_id % 4) AS last_msg_id, max(CASE WHEN turn % 2 = 0 THEN 500 END) AS last_sync_at FROM conversations GROUP BY conv_id")
def feed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water marks after a batch."""
    now = feeds.advanced(_rooms(spark, sf_dir), _feed(spark, sf_dir).where("(id - 1) % 2 = 0"), 500)
    return now.select("id", "last_msg_id", "last_sync_at")


@query("SELECT conv_id + 1000000 AS chat_id, turn + 1 AS msg_id, conv_id AS comment_of_chat_id, turn % 2 AS comment_of_msg_id FROM conversations WHERE turn % 8 <> 7 AND conv_id % 3 = 0")
def comment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment threads of channels, stored under their discussion groups; channels without a group have none."""
    rooms = _rooms(spark, sf_dir)
    groups = rooms.where("id % 3 = 0").withColumn("discussion_of", F.col("id")).withColumn("id", F.col("id") + 1_000_000)
    rows = _feed(spark, sf_dir).withColumn("channel_id", F.col("chat_id")).withColumn("post_id", (F.col("id") - 1) % 2)
    return feeds.comment_messages(rows, rooms.unionByName(groups)).select("chat_id", "msg_id", "comment_of_chat_id", "comment_of_msg_id")


@query("SELECT conv_id AS chat_id, turn + 1 AS msg_id FROM conversations WHERE turn % 3 > CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END")
def grown_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that tell of more replies than are stored."""
    stored = _feed(spark, sf_dir).where("(id - 1) % 2 = 0").select(F.col("chat_id").alias("comment_of_chat_id"), F.col("id").alias("comment_of_msg_id"))
    return feeds.grown_threads(_feed(spark, sf_dir), stored)


# -------------------------------------------------------------------- functions


@query(f"""WITH {TALKS} SELECT chat_id, msg_id, CASE msg_id % 4 WHEN 0 THEN '[empty]' WHEN 1 THEN '[photo]' WHEN 2 THEN '[document: a.pdf]' ELSE '[empty]' END AS placeholder,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one_line, trim(text, ' \t\n\r') || CASE WHEN msg_id % 2 = 0 THEN ' and more' ELSE '' END AS indexed,
  CASE WHEN chat_id % 2 = 0 THEN '' WHEN msg_id % 2 = 0 THEN 'work' ELSE 'home' END AS scope FROM talks""")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders, texts on one line, what is indexed of a message, and whose its chat is."""
    i = F.col("msg_id")
    kind = F.when(i % 4 == 1, "photo").when(i % 4 == 2, "document")
    read = F.when(i % 2 == 0, " and \n more ")
    scope = links.scope(F.when(F.col("chat_id") % 2 == 0, "channel").otherwise("user"), F.when(i % 2 == 0, "work").otherwise("home"))
    return talks(spark, sf_dir).select("chat_id", "msg_id", text.placeholder(kind, F.when(i % 4 == 2, "a.pdf")).alias("placeholder"), text.one_line(F.col("text")).alias("one_line"), text.index_text(F.col("text"), read).alias("indexed"), scope.alias("scope"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '  «Größe ΣΑΣ» ' ELSE '' END || p_name || ' ' || p_type AS name FROM part)
SELECT p_partkey, trim(regexp_replace(replace(replace(lower(name), 'ß', 'ss'), 'ς', 'σ'), '\\s+', ' ', 'g')) AS folded, rtrim(substr(trim(regexp_replace(replace(replace(lower(name), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 1, 12), '-') AS slug FROM p""")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are compared, and as they name sources."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "  «Größe ΣΑΣ» ").otherwise(""), "p_name", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.folded(name).alias("folded"), text.slug(name, 12).alias("slug"))


@query("""SELECT l_orderkey, round(CASE WHEN len(list_distinct(list(l_suppkey))) > 0 THEN len(list_intersect(list_distinct(list(l_suppkey)), list_distinct(list(l_partkey % 100)))) / len(list_distinct(list(l_suppkey))) ELSE 0 END, 9) AS share FROM lineitem GROUP BY l_orderkey""")
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of one list's distinct ids that another has."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("a"), F.collect_list(F.col("l_partkey") % 100).alias("b"))
    return rows.select("l_orderkey", F.round(text.overlap_ratio(F.col("a"), F.col("b")), 9).alias("share"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents), f AS (SELECT *, instr(lower(flat), 'the ') - 1 AS pos, length(flat) AS n FROM d),
g AS (SELECT *, CASE WHEN pos < 0 THEN 0 ELSE greatest(0, least(pos - 13, n - 40)) END AS a FROM f)
SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN n <= 40 THEN flat ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || substr(flat, a + 1, 40) || CASE WHEN a + 40 < n THEN '…' ELSE '' END END AS snippet FROM g""")
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty characters of every document around a word."""
    return table(spark, sf_dir, "documents").select("doc_id", text.evidence_snippet(F.col("text"), F.lit("the "), 40).alias("snippet"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate <= TIMESTAMP '1997-06-30 23:59:59'")
def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within bounds that are written as a month and a day; the bounds reach the scan as literals."""
    since, until = dates.date_range("1997-02", "1997-06-30")
    at = lambda s: F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("timestamp_ntz").between(at(since), at(until))).select("o_orderkey")


@query(f"""WITH {TALKS}, k AS (SELECT *, chat_id % 3 = 0 AS cast_ FROM talks), w AS (SELECT chat_id, msg_id // 5 AS part FROM k WHERE NOT cast_)
SELECT 'post' AS kind, count(*) AS n FROM k WHERE cast_ UNION ALL SELECT 'window', count(DISTINCT (chat_id, part)) FROM w UNION ALL SELECT 'thread', count(DISTINCT (chat_id, msg_id // 3)) FROM k WHERE NOT cast_ AND msg_id % 3 > 0""")
def units_of_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units of each kind all chats give: channels' posts, other chats' windows and threads."""
    m = schema.conform(talks(spark, sf_dir), schema.MESSAGES)
    c = m.select(F.col("chat_id").alias("id"), F.lit(False).alias("is_forum"), (F.col("chat_id") % 3 == 0).alias("is_broadcast")).distinct()
    return units.build_units(m.withColumn("text", F.lit("x")), c).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""SELECT conv_id % 10 AS chat_id, conv_id * 1000 + turn AS id, {BASE} + conv_id * 1000 + turn AS date, text FROM conversations WHERE conv_id * 1000 + turn >= 20000""")
def fed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through a live feed: a first run from a date on, and a second one that asks above each chat's mark only."""
    folder = f"{shared_folder(spark)}/feed-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    i = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("chat_id"), i.alias("id"), (F.lit(BASE) + i).alias("date"), "text")
    half = max((rows.agg(F.max("id")).head()[0] or 0) // 2, 19_999)  # what lies before the date is there at the first run
    spark.dataSource.register(live.ChatFeed)
    for part in (rows.where(F.col("id") <= half), rows.where(F.col("id") > half)):
        live.write_feed(part, f"{folder}/feed")
        uri = re.sub("^(file:)?/+", "file:///", folder)  # as an address, however the shared folder is named
        feed = spark.readStream.format("chat_feed").options(client="parlance.sources.live:folder_client", path=f"{uri}/feed", page=100_000, since=BASE + 20_000)
        feed.load().writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(live.ROWS).parquet(f"{folder}/out")
