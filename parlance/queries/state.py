"""Queries of stored state: upserts, clocks, pages, attachments, chats, discussions, deletions, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema, storage
from parlance.operators import chats as ch
from parlance.operators import readers
from parlance.queries.base import EVENTS, TALKS, notes, query, table, talks
from parlance.sinks import results

_LINKS = "array<struct<kind:string,target:string>>"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored messages with attachments, links and clocks."""
    i = F.col("msg_id")
    n = notes(spark, sf_dir).withColumn("topic_id", F.when(i % 2 == 0, i % 9)).withColumn("media_kind", F.when(i % 3 == 0, "photo").when(i % 3 == 1, "document"))
    n = n.withColumn("media_filename", F.when(i % 3 == 1, F.concat(F.lit("f"), (i % 4).cast("string"), F.when(i % 4 == 0, ".PDF").when(i % 4 == 1, ".zip").otherwise(".docx")))).withColumn("media_state", (i % 6).cast("int"))
    n = n.withColumn("extracted", F.when(i % 6 == 1, "read")).withColumn("links", F.when(i % 5 == 0, F.array(F.struct(F.lit("link").alias("kind"), F.concat(F.lit("@name"), (i % 7).cast("string")).alias("target"))).cast(_LINKS)))
    n = n.withColumn("links_read", i % 5 == 0).withColumn("lead_seq", i % 11).withColumn("indexed", i % 4 > 0)
    return schema.conform(n, schema.MESSAGES)


_M = f"""{EVENTS}, m AS (SELECT chat_id, msg_id, date, text, reactions, CASE WHEN msg_id % 2 = 0 THEN msg_id % 9 END AS topic_id,
  CASE msg_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'document' END AS media_kind,
  CASE WHEN msg_id % 3 = 1 THEN 'f' || msg_id % 4 || CASE msg_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.zip' ELSE '.docx' END END AS media_filename,
  CAST(msg_id % 6 AS INT) AS media_state, CASE WHEN msg_id % 6 = 1 THEN 'read' END AS extracted,
  CASE WHEN msg_id % 5 = 0 THEN '@name' || msg_id % 7 END AS link, msg_id % 5 = 0 AS links_read, msg_id % 11 AS lead_seq, msg_id % 4 > 0 AS indexed FROM notes)"""


@query(f"""WITH {_M}, b AS (SELECT msg_id + 30 AS key, chat_id, text || '!' AS text, CASE WHEN msg_id % 4 = 0 THEN 77 END AS topic_id, media_kind, CASE WHEN msg_id % 7 = 0 THEN 'other.pdf' ELSE media_filename END AS media_filename, msg_id % 3 = 0 AS says FROM m WHERE msg_id % 10 > 0),
o AS (SELECT *, msg_id AS key FROM m WHERE msg_id % 8 > 0)
SELECT coalesce(b.chat_id, o.chat_id) AS chat_id, coalesce(b.key, o.key) AS msg_id, CASE WHEN b.key IS NULL THEN o.text ELSE b.text END AS text,
  CASE WHEN b.key IS NULL THEN o.topic_id ELSE coalesce(b.topic_id, o.topic_id) END AS topic_id,
  CASE WHEN b.key IS NULL THEN o.extracted WHEN o.key IS NULL THEN NULL WHEN o.media_kind IS DISTINCT FROM b.media_kind OR o.media_filename IS DISTINCT FROM b.media_filename THEN NULL ELSE o.extracted END AS extracted,
  CASE WHEN b.key IS NULL THEN o.media_state WHEN o.key IS NULL OR o.media_kind IS DISTINCT FROM b.media_kind OR o.media_filename IS DISTINCT FROM b.media_filename THEN 0 ELSE o.media_state END AS media_state,
  CASE WHEN b.key IS NULL THEN o.link WHEN b.says THEN '@new' ELSE o.link END AS link,
  CASE WHEN b.key IS NULL THEN o.links_read ELSE b.says OR coalesce(o.links_read, false) END AS links_read,
  CASE WHEN b.key IS NULL THEN o.lead_seq WHEN o.key IS NULL OR b.says THEN 99 ELSE o.lead_seq END AS lead_seq,
  CASE WHEN b.key IS NULL THEN o.indexed ELSE false END AS indexed
FROM o FULL JOIN b ON o.chat_id = b.chat_id AND o.key = b.key""")
def upserted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of messages stored over others: what each column keeps, whose attachment is read again, what the clock stamps."""
    m = _messages(spark, sf_dir)
    i = F.col("msg_id")
    says = F.array(F.struct(F.lit("link").alias("kind"), F.lit("@new").alias("target"))).cast(_LINKS)
    batch = m.where("msg_id % 10 > 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("topic_id", F.when(i % 4 == 0, 77)).withColumn("media_filename", F.when(i % 7 == 0, "other.pdf").otherwise(F.col("media_filename")))
    batch = batch.withColumn("links", F.when(i % 3 == 0, says)).withColumn("extracted", F.lit(None)).withColumn("media_state", F.lit(None)).withColumn("msg_id", i + 30)
    now = storage.upsert_messages(m.where("msg_id % 8 > 0"), batch, tick=99)
    return now.select("chat_id", "msg_id", "text", "topic_id", "extracted", "media_state", F.col("links")[0]["target"].alias("link"), "links_read", "lead_seq", "indexed")


@query(f"WITH {_M} SELECT chat_id, msg_id, CASE WHEN msg_id % 3 = 0 THEN 'seen ' || msg_id ELSE extracted END AS extracted, CASE WHEN msg_id % 3 = 0 THEN 1 ELSE media_state END AS media_state, CASE WHEN msg_id % 3 = 0 THEN false ELSE indexed END AS indexed FROM m")
def attachment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read from photos is stored, and their rows are to be indexed again."""
    m = _messages(spark, sf_dir)
    read = m.where("msg_id % 3 = 0").select("chat_id", "msg_id", F.concat(F.lit("seen "), F.col("msg_id").cast("string")).alias("read"))
    return storage.set_media_text(m, read).select("chat_id", "msg_id", "extracted", "media_state", "indexed")


@query(f"""WITH {_M} SELECT chat_id, msg_id, CASE WHEN media_kind IS NULL THEN media_state WHEN media_kind = 'photo' THEN CASE WHEN media_state = 0 THEN 5 ELSE media_state END
  WHEN media_state IN (0, 5, 3, 2) THEN CASE WHEN lower(media_filename) LIKE '%.pdf' OR lower(media_filename) LIKE '%.docx' THEN 0 ELSE 2 END ELSE media_state END AS media_state FROM m""")
def parked_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds alone decide: photos are switched off, documents are tried again, those that no reader knows are parked."""
    state = storage.offline_media_state(F.col("media_state"), F.col("media_kind"), F.col("media_filename"), ["photo", "document"], ["photo"], retry_failed=True)
    return _messages(spark, sf_dir).select("chat_id", "msg_id", state.alias("media_state"))


@query(f"WITH {_M} SELECT chat_id, msg_id, CASE WHEN msg_id % 6 = 1 THEN '@late' ELSE link END AS link, CASE WHEN msg_id % 6 = 1 THEN chat_id END AS fwd_from_id, links_read OR msg_id % 6 = 1 AS links_read, CASE WHEN msg_id % 6 = 1 THEN 50 ELSE lead_seq END AS lead_seq, indexed FROM m")
def recaptured_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links read again for stored rows: nothing else of a row changes, and nothing is made of what is not stored."""
    m = _messages(spark, sf_dir)
    says = F.array(F.struct(F.lit("link").alias("kind"), F.lit("@late").alias("target"))).cast(_LINKS)
    read = m.where("msg_id % 6 = 1").select("chat_id", "msg_id", says.alias("links"), F.col("chat_id").alias("fwd_from_id"), F.lit(5).cast("long").alias("fwd_msg_id"), F.lit(None).cast("long").alias("fwd_date"))
    lost = read.withColumn("msg_id", -F.col("msg_id"))
    now = storage.set_captured_links(m, read.unionByName(lost), 50)
    return now.select("chat_id", "msg_id", F.col("links")[0]["target"].alias("link"), "fwd_from_id", "links_read", "lead_seq", "indexed")


@query(f"WITH {_M} SELECT chat_id, msg_id, CASE WHEN msg_id % 10 = 3 THEN true ELSE indexed END AS indexed FROM m")
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows marked as indexed, by their keys."""
    m = _messages(spark, sf_dir)
    return storage.mark_indexed(m, m.where("msg_id % 10 = 3")).select("chat_id", "msg_id", "indexed")


@query("""SELECT event_id AS unit_id, event_id % 4 > 1 AS dirty, CASE WHEN event_id % 4 = 1 THEN 'hashed' END AS embedded_model FROM events""")
def embedded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units after some of those to be embedded were."""
    u = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit_id"), (F.col("event_id") % 4 > 0).alias("dirty"), F.lit(None).cast("string").alias("embedded_model"))
    return storage.set_embedded(u, u.where("unit_id % 4 = 1"), "hashed")


@query(f"WITH {_M} SELECT 'unindexed' AS what, chat_id FROM m WHERE NOT indexed UNION SELECT 'pending', chat_id FROM m WHERE media_state = 0 AND media_kind IS NOT NULL UNION SELECT 'unread', chat_id FROM m WHERE NOT links_read")
def waiting_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats that hold rows to be indexed, extracted, or read for links."""
    m = _messages(spark, sf_dir)
    out = None
    for what in ("unindexed", "pending", "unread"):
        part = storage.chats_with(m, what).select(F.lit(what).alias("what"), "chat_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {EVENTS} SELECT chat_id, msg_id FROM notes WHERE msg_id > (chat_id % 10) * 900 QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY msg_id) <= 3")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three messages of every chat after its cursor; a page is the feature."""
    n = notes(spark, sf_dir)
    cursors = n.select("chat_id").distinct().withColumn("after", (F.col("chat_id") % 10) * 900)
    return storage.next_pages(n, cursors, 3).select("chat_id", "msg_id")


@query(f"""WITH {EVENTS}, top AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY msg_id DESC) AS i FROM notes)
SELECT chat_id, msg_id, CASE WHEN msg_id % 4 = 1 THEN text || '?' ELSE text END AS text FROM top WHERE i <= 20 AND msg_id % 4 = 1""")
def reread_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chat's twenty newest messages read again, those that differ from what is stored; what a feed leaves out is no change."""
    n = _messages(spark, sf_dir)
    again = n.withColumn("text", F.when(F.col("msg_id") % 4 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text"))).withColumn("topic_id", F.lit(None).cast("long")).withColumn("links", F.lit(None).cast(_LINKS)).withColumn("extracted", F.lit(None).cast("string"))
    return storage.edits(n, again, 20).select("chat_id", "msg_id", "text")


@query(f"""WITH {EVENTS}, s AS (SELECT chat_id, min(msg_id) AS a, max(msg_id) AS b FROM notes WHERE msg_id % 4 <> 1 GROUP BY chat_id)
SELECT n.chat_id, n.msg_id FROM notes n JOIN s USING (chat_id) WHERE n.msg_id % 4 = 1 AND n.msg_id % 3 > 0 AND n.msg_id BETWEEN a AND b""")
def deleted_but_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a second look no longer finds; comments are left alone."""
    n = _messages(spark, sf_dir).withColumn("comment_of_chat_id", F.when(F.col("msg_id") % 3 == 0, F.lit(-1)))
    return storage.deleted(n, n.where("msg_id % 4 <> 1")).select("chat_id", "msg_id")


# ------------------------------------------------------------------------ chats


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as chats: stored ones of one account, and a resolution of another's."""
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("channel", "user", "supergroup", "bot"))), (key % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(kind.alias("type"), F.col("c_name").alias("title"), key.alias("peer_id"), F.lit("src").alias("source_id"), F.when(key % 9 == 0, key + 1).alias("discussion_of"), F.lit(7).alias("last_msg_id"))
    stored = schema.conform(c.where("peer_id % 3 = 0").withColumn("id", F.col("peer_id")).withColumn("scope", F.when(F.col("type").isin("channel", "supergroup"), "").otherwise("default")), schema.CHATS)
    return stored, schema.conform(c.where("peer_id % 2 = 0").withColumn("title", F.concat("title", F.lit("+"))).withColumn("discussion_of", F.lit(None)), schema.CHATS)


@query("""WITH c AS (SELECT c_custkey AS peer_id, c_name AS title, ['channel', 'user', 'supergroup', 'bot'][CAST(c_custkey % 4 AS INT) + 1] AS type, CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 1 END AS discussion_of FROM customer),
s AS (SELECT *, CASE WHEN type IN ('channel', 'supergroup') THEN '' ELSE 'default' END AS scope FROM c WHERE peer_id % 3 = 0), f AS (SELECT *, CASE WHEN type IN ('channel', 'supergroup') THEN '' ELSE 'work' END AS scope FROM c WHERE peer_id % 2 = 0),
n AS (SELECT f.*, f.peer_id IN (SELECT peer_id FROM s) AS taken FROM f WHERE (scope, peer_id) NOT IN (SELECT (scope, peer_id) FROM s))
SELECT s.peer_id AS id, s.scope, s.peer_id, CASE WHEN f.peer_id IS NULL THEN s.title ELSE s.title || '+' END AS title, s.discussion_of, CAST(7 AS BIGINT) AS last_msg_id FROM s LEFT JOIN f ON f.scope = s.scope AND f.peer_id = s.peer_id
UNION ALL SELECT CASE WHEN taken THEN 4611686018427387904 + row_number() OVER (PARTITION BY taken ORDER BY scope, peer_id) - 1 ELSE peer_id END, scope, peer_id, title || '+', NULL, 7 FROM n""")
def upserted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of a second account stored beside those of the first: shared ones are one row, private ones with a taken id get a synthetic one."""
    stored, fresh = _accounts(spark, sf_dir)
    return storage.upsert_chats(stored, fresh, "work").select("id", "scope", "peer_id", "title", "discussion_of", "last_msg_id")


def _discussions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as channels 0, 1, ... and their groups; (chats, messages, units)."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = ids.select(F.col("conv_id").alias("id"), F.lit("channel").alias("type"), F.lit(True).alias("is_broadcast"), F.lit(None).cast("long").alias("discussion_of"))
    g = ids.select((F.col("conv_id") + 1_000_000).alias("id"), F.lit("supergroup").alias("type"), F.lit(False).alias("is_broadcast"), F.col("conv_id").alias("discussion_of"))
    t = schema.conform(talks(spark, sf_dir), schema.MESSAGES).withColumn("indexed", F.lit(True))
    m = t.where("msg_id < 2").unionByName(t.where("msg_id >= 2").withColumn("comment_of_chat_id", F.col("chat_id")).withColumn("comment_of_msg_id", F.col("msg_id") % 2).withColumn("chat_id", F.col("chat_id") + 1_000_000))
    u = t.where("msg_id < 2").select("chat_id", (F.col("chat_id") * 10 + F.col("msg_id")).alias("unit_id"), F.lit("thread").alias("kind"), F.array("msg_id").alias("msg_ids"))
    return schema.conform(c.unionByName(g), schema.CHATS), m, u


@query("""WITH i AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT id, CAST(NULL AS BIGINT) AS discussion_of FROM i UNION ALL SELECT id + 1000000, CASE WHEN id % 5 = 1 OR (id % 5 = 0 AND id + 1 IN (SELECT id FROM i)) THEN NULL ELSE id END FROM i WHERE NOT (id % 5 = 1 AND id - 1 IN (SELECT id FROM i))
UNION ALL SELECT id + 1000000, id - 1 FROM i WHERE id % 5 = 1 AND id - 1 IN (SELECT id FROM i)""")
def moved_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats after channels 0, 5, 10, ... took over the next channel's group, and that channel was left without."""
    chats, _, _ = _discussions(spark, sf_dir)
    own = chats.where("type = 'channel'").select("id")
    given = own.where("id % 5 = 0").join(own.select((F.col("id") - 1).alias("id")), "id", "left_semi").select(F.col("id").alias("channel_id"), (F.col("id") + 1_000_001).alias("group_id"))
    none = own.where("id % 5 = 1").select(F.col("id").alias("channel_id"), F.lit(None).cast("long").alias("group_id"))
    return storage.move_discussions(chats, given.unionByName(none))[0].select("id", "discussion_of")


@query(f"""WITH {TALKS}, c AS (SELECT DISTINCT chat_id AS id FROM talks),
m AS (SELECT CASE WHEN msg_id < 2 THEN chat_id ELSE chat_id + 1000000 END AS chat_id, chat_id AS of, msg_id FROM talks),
quoted AS (SELECT DISTINCT of, msg_id % 2 AS post FROM m WHERE msg_id >= 2 AND of % 4 = 1)
SELECT 'chat' AS what, id, CAST(NULL AS BIGINT) AS msg_id, true AS flag FROM c WHERE id % 4 <> 2 UNION ALL SELECT 'chat', id + 1000000, NULL, id % 4 <> 2 FROM c WHERE id % 4 <> 1
UNION ALL SELECT 'message', chat_id, msg_id, CASE WHEN msg_id < 2 THEN (of, msg_id) NOT IN (SELECT (of, post) FROM quoted) ELSE of % 4 <> 2 END FROM m WHERE NOT (msg_id < 2 AND of % 4 = 2) AND NOT (msg_id >= 2 AND of % 4 = 1)
UNION ALL SELECT 'unit', chat_id, msg_id, true FROM m WHERE msg_id < 2 AND of % 4 <> 2 AND (of, msg_id) NOT IN (SELECT (of, post) FROM quoted)""")
def deleted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups 1, 5, ... and channels 2, 6, ... deleted: quoting post threads go with the groups, groups live on without their channels.

    ``flag`` says of a group whether it is still linked, of a message whether its row is indexed, or is a comment still.
    """
    chats, messages, units = _discussions(spark, sf_dir)
    gone = chats.where("(type = 'supergroup' and discussion_of % 4 = 1) or (type = 'channel' and id % 4 = 2)").select(F.col("id").alias("chat_id"))
    left = storage.delete_chats({"chats": chats, "messages": messages, "units": units}, gone)
    null = F.lit(None).cast("long").alias("msg_id")
    c = left["chats"].select(F.lit("chat").alias("what"), "id", null, F.when(F.col("type") == "channel", True).otherwise(F.col("discussion_of").isNotNull()).alias("flag"))
    m = left["messages"].select(F.lit("message").alias("what"), F.col("chat_id").alias("id"), "msg_id", F.when(F.col("msg_id") < 2, F.col("indexed")).otherwise(F.col("comment_of_chat_id").isNotNull()).alias("flag"))
    u = left["units"].select(F.lit("unit").alias("what"), F.col("chat_id").alias("id"), F.col("msg_ids")[0].alias("msg_id"), F.lit(True).alias("flag"))
    return c.unionByName(m).unionByName(u)


@query("SELECT c_custkey AS id, c_custkey % 3 > 0 AND c_nationkey <> 5 AS again, c_custkey % 4 = 0 OR c_custkey % 4 = 2 OR c_nationkey % 2 = 0 AS mine FROM customer")
def fetchable_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chats may be asked for again, and which an account may fetch."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(key.alias("id"), (key % 3 == 0).alias("unavailable"), F.when(F.col("c_nationkey") == 5, "import:x").otherwise("chat:y").alias("source_id"), F.when(key % 2 == 0, "").when(F.col("c_nationkey") % 2 == 0, "work").otherwise("home").alias("scope"))
    again = storage.refetchable(c).select("id", F.lit(True).alias("again"))
    mine = storage.fetchable_by(c, "work").select("id", F.lit(True).alias("mine"))
    return c.select("id").join(again, "id", "left").join(mine, "id", "left").select("id", F.coalesce("again", F.lit(False)).alias("again"), F.coalesce("mine", F.lit(False)).alias("mine"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS chat_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'default' ELSE lower(o_orderpriority) END AS account FROM orders),
b AS (SELECT * FROM a UNION SELECT c_custkey, account FROM customer JOIN a ON a.chat_id = c_nationkey)
SELECT chat_id, string_agg(account, ',' ORDER BY account <> 'default', account) AS accounts FROM b GROUP BY chat_id""")
def chat_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts that each chat came through, a group's also by its channel, the default one first."""
    access = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "default").otherwise(F.lower("o_orderpriority")).alias("account"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("discussion_of"))
    return ch.provenance(access, groups).select("chat_id", F.array_join("accounts", ",").alias("accounts"))


@query("""WITH l AS (SELECT c_custkey AS chat_id, 's' || c_nationkey % 4 AS source_id, CAST(c_nationkey % 4 AS INT) AS position FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, 's9', 9 FROM customer WHERE c_custkey % 3 = 0),
h AS (SELECT c_custkey AS chat_id, 's' || c_nationkey % 4 AS source_id, CAST(c_nationkey % 4 AS INT) AS position FROM customer WHERE c_custkey % 5 = 0),
b AS (SELECT * FROM l WHERE source_id <> 's2' UNION SELECT * FROM h WHERE source_id = 's2')
SELECT chat_id, source_id, row_number() OVER (PARTITION BY chat_id ORDER BY position, source_id) = 1 AS "primary" FROM b""")
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources cover after one of them failed and kept what it had; the first in order is primary."""
    c = table(spark, sf_dir, "customer")
    of = lambda rows: rows.select(F.col("c_custkey").alias("chat_id"), F.concat(F.lit("s"), (F.col("c_nationkey") % 4).cast("string")).alias("source_id"), (F.col("c_nationkey") % 4).alias("position"))
    listed = of(c.where("c_custkey % 2 = 0")).unionByName(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("chat_id"), F.lit("s9").alias("source_id"), F.lit(9).alias("position")))
    failed = spark.range(1).select(F.lit("s2").alias("source_id"))
    return ch.resolved_sources(listed, of(c.where("c_custkey % 5 = 0")), failed).select("chat_id", "source_id", "primary")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 4 THEN 'kept' WHEN c_custkey % 11 = 0 THEN 'kept' ELSE 'offered' END AS verdict,
  CASE WHEN c_nationkey % 5 = 4 THEN 'not a configured source' WHEN c_custkey % 11 = 0 THEN 'a channel''s discussion group' ELSE 'no longer listed' END AS reason FROM customer WHERE c_nationkey % 5 > 1 AND c_custkey % 2 = 1""")
def prune_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats that came by folders which no longer list them: what may go and what stays, and why."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey") % 5
    source = F.when(nation == 0, "import:x").when(nation == 1, "chat:@y").when(nation == 4, "folder:gone").otherwise(F.concat(F.lit("work/folder:f"), nation.cast("string")))
    c = table(spark, sf_dir, "customer").select(key.alias("id"), source.alias("source_id"), F.when(key % 11 == 0, F.lit(1)).cast("long").alias("discussion_of"))
    listed = c.where("id % 2 = 0").select(F.col("id").alias("chat_id"))
    sources = spark.range(2, 4).select(F.concat(F.lit("work/folder:f"), F.col("id").cast("string")).alias("source_id"))
    return ch.prune_scan(c, listed, sources, sources.limit(0), listed.limit(0))


@query(f"""WITH {TALKS}, s AS (SELECT chat_id, count(*) AS messages FROM talks GROUP BY chat_id), l AS (SELECT chat_id, 'src' || chat_id % 3 AS source_id FROM s)
SELECT source_id, count(DISTINCT chat_id) AS chats, CAST(sum(messages) AS BIGINT) AS messages FROM l JOIN s USING (chat_id) GROUP BY source_id""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats and messages of every source."""
    counts = talks(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("messages"))
    listed = counts.select("chat_id", F.concat(F.lit("src"), (F.col("chat_id") % 3).cast("string")).alias("source_id"), (F.col("chat_id") % 3).alias("position"))
    return ch.source_status(listed, counts).select("source_id", "chats", "messages")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS chat_id, o_orderpriority AS account FROM orders), n AS (SELECT DISTINCT account FROM a UNION SELECT 'default')
SELECT n.account, count(chat_id) AS chats, CAST(n.account <> 'default' AS INT) AS place FROM n LEFT JOIN a USING (account) GROUP BY n.account""")
def account_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with the chats they reach, the default one first."""
    access = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderpriority").alias("account"))
    return results.account_status(access.select("account").unionByName(spark.range(1).select(F.lit("default").alias("account"))), access)


@query(f"""WITH {TALKS} SELECT chat_id, msg_id, '[photo: p.jpg]' AS text, 'https://t.me/c/' || chat_id || CASE WHEN chat_id % 2 = 0 THEN '/4' ELSE '' END || '/' || msg_id AS url FROM talks WHERE msg_id % 3 = 1
UNION ALL SELECT chat_id, msg_id, trim(text, ' \t\n\r'), 'https://t.me/c/' || chat_id || CASE WHEN chat_id % 2 = 0 THEN '/4' ELSE '' END || '/' || msg_id FROM talks WHERE msg_id % 3 = 0
UNION ALL SELECT chat_id, msg_id, trim(text, ' \t\n\r') || ' [photo: p.jpg] what was read', 'https://t.me/c/' || chat_id || CASE WHEN chat_id % 2 = 0 THEN '/4' ELSE '' END || '/' || msg_id FROM talks WHERE msg_id % 3 = 2""")
def message_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they are shown: bodies with attachments and what was read from them, and links that open them."""
    i = F.col("msg_id") % 3
    m = schema.conform(talks(spark, sf_dir), schema.MESSAGES).withColumn("topic_id", F.lit(4).cast("long")).withColumn("text", F.when(i == 1, "").otherwise(F.col("text")))
    m = m.withColumn("media_kind", F.when(i > 0, "photo")).withColumn("media_filename", F.when(i > 0, "p.jpg")).withColumn("extracted", F.when(i == 0, "of no attachment").when(i == 2, " what  was\nread "))
    c = m.select(F.col("chat_id").alias("id"), F.lit("supergroup").alias("type"), (-(F.col("chat_id") + schema.CHANNEL_MARK)).alias("peer_id"), F.lit(None).cast("string").alias("username"), (F.col("chat_id") % 2 == 0).alias("is_forum")).distinct()
    return readers.message_views(m, c).select("chat_id", "msg_id", "text", "url")
