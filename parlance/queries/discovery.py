"""Queries of link discovery over the links of pages, which stand for messages that name chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import links as ln
from parlance.operators import leads
from parlance.queries.base import query, table
from parlance.sinks import results
from parlance.storage import checkpointed

_RESERVED = ", ".join(f"'{r}'" for r in ln.RESERVED)

# the identities of the links that a page shows: user names of 4 to 32 letters, digits and underscores
_PAGES = rf"""pages_ AS (SELECT page_id, page_id % 40 AS chat_id, page_id % 3 = 0 AS sent, -(1000000000000 + page_id % 7) AS peer, CASE WHEN page_id % 2 = 0 THEN page_id % 11 + 1 END AS post, CASE WHEN page_id % 5 > 0 THEN 100 END AS sent_at, page_id % 9 + 1 AS tick,
  regexp_extract_all(replace(html, '@', ' at '), 'href="/([^"<>\s''`]*)', 1) AS hrefs FROM pages),
origins AS (SELECT *, CASE WHEN sent AND post IS NOT NULL THEN 'post:' || peer || '/' || post WHEN sent THEN 'fwd:' || peer || '@' || coalesce(sent_at, 0) WHEN chat_id % 2 = 0 THEN 'post:' || chat_id || '/' || page_id ELSE 'msg:default:' || chat_id || '/' || page_id END AS origin FROM pages_),
named AS (SELECT DISTINCT page_id, chat_id, origin, tick, regexp_replace(h, '[.,;:!?)\]}}>»"'']+$', '') AS name FROM (SELECT *, unnest(hrefs) AS h FROM origins)),
leads AS (SELECT DISTINCT chat_id, page_id AS msg_id, 'link' AS via, '@' || lower(name) AS target, '@' || lower(name) AS chat, origin, tick FROM named WHERE regexp_matches(name, '^[A-Za-z][A-Za-z0-9_]{{3,31}}$') AND lower(name) NOT IN ({_RESERVED})
  UNION ALL SELECT chat_id, page_id, 'forward', 'peer:' || peer, 'peer:' || peer, origin, tick FROM origins WHERE sent)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages whose links lead to chats; every third is forwarded, some from a known post, some at an unknown time."""
    i = F.col("page_id")
    text = F.replace(F.replace("html", F.lit("@"), F.lit(" at ")), F.lit('href="/'), F.lit('href="https://t.me/'))
    sent = i % 3 == 0
    rows = table(spark, sf_dir, "pages").select(
        (i % 40).alias("chat_id"), i.alias("msg_id"), text.alias("text"), F.when(sent, -(F.lit(10**12) + i % 7)).alias("fwd_from_id"), F.when(sent & (i % 2 == 0), i % 11 + 1).alias("fwd_msg_id"), F.when(sent & (i % 5 > 0), F.lit(100)).alias("fwd_date"), (i % 9 + 1).alias("lead_seq"),
    )
    return schema.conform(rows, schema.MESSAGES)


def _chats(spark: SparkSession) -> DataFrame:
    c = spark.range(40).select("id", F.col("id").alias("peer_id"), F.when(F.col("id") % 2 == 0, "channel").otherwise("user").alias("type"), F.when(F.col("id") % 2 == 1, "default").otherwise("").alias("scope"))
    return schema.conform(c, schema.CHATS)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.collect_leads(_messages(spark, sf_dir), _chats(spark))


@query(f"WITH {_PAGES} SELECT chat_id, msg_id, via, target, chat, origin FROM leads")
def lead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages name: the links that they show, and where they were forwarded from."""
    return leads.message_leads(_messages(spark, sf_dir), _chats(spark)).select("chat_id", "msg_id", "via", "target", "chat", "origin")


@query(f"WITH {_PAGES} SELECT chat_id, msg_id, chat FROM leads WHERE tick > chat_id % 8 AND tick <= 7")
def collected_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of messages whose links changed after each chat's cursor, and no later than a tick."""
    cursors = spark.range(40).select(F.col("id").alias("chat_id"), (F.col("id") % 8).alias("after"))
    return leads.collect_leads(_messages(spark, sf_dir), _chats(spark), cursors, 7).select("chat_id", "msg_id", "chat")


@query(f"WITH {_PAGES} SELECT chat, count(DISTINCT origin) AS corroboration, count(DISTINCT chat_id) AS chats, CAST(row_number() OVER (ORDER BY count(DISTINCT origin) DESC, chat) AS INT) AS rank FROM leads GROUP BY chat")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats that pages name, by how many origins name them."""
    found = checkpointed(_found(spark, sf_dir))
    return leads.ranked(leads.candidates(found), found).select("chat", "corroboration", "chats", "rank")


@query(f"WITH {_PAGES} SELECT chat_id, count(DISTINCT chat) AS names FROM leads GROUP BY chat_id HAVING count(DISTINCT chat) >= 10")
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats whose stored links and forwards name at least ten others."""
    m = _messages(spark, sf_dir)
    return leads.directories(leads.named_chats(m.withColumn("links", ln.text_leads(F.col("text"))), _chats(spark)))


@query(f"""WITH {_PAGES}, c AS (SELECT chat, count(DISTINCT origin) AS n FROM leads GROUP BY chat) SELECT chat FROM c WHERE chat NOT LIKE '@t%' AND chat NOT LIKE '@a%' ORDER BY n DESC, chat LIMIT 10""")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates that are neither known nor excluded; the session's room is the limit."""
    cands = checkpointed(leads.candidates(_found(spark, sf_dir)))
    return leads.propose(cands, cands.where("chat like '@t%'"), cands.where("chat like '@a%'"), 2, 10).select("chat")


_ROUND = f"""{_PAGES}, s AS (SELECT * FROM leads WHERE chat_id % 2 = 0 AND tick > CASE WHEN chat_id = 4 THEN 5 ELSE 0 END),
c AS (SELECT chat, count(DISTINCT origin) AS n FROM s GROUP BY chat), o AS (SELECT chat, row_number() OVER (ORDER BY n DESC, chat) AS i FROM c WHERE chat NOT LIKE '@o%' AND chat NOT LIKE '@w%')"""


def _round(spark: SparkSession, sf_dir: str) -> leads.Discovery:
    m = _messages(spark, sf_dir)
    seeds = spark.range(0, 40, 2).select(F.col("id").alias("chat_id"))
    found = checkpointed(leads.collect_leads(m, _chats(spark)).select("chat").distinct())
    known = schema.conform(found.where("chat like '@o%'").withColumn("depth", F.lit(3)).withColumn("status", F.lit("approved")).withColumn("decided", F.lit(True)), leads.CANDIDATES)
    cursors = spark.createDataFrame([(4, 0, "this", 5, False), (6, 0, "other", 8, False)], leads.CURSORS)
    none = spark.createDataFrame([], leads.EVIDENCE)
    return leads.discover(m, _chats(spark), seeds, known, none, cursors, found.where("chat like '@w%'"), "this", max_depth=2, room=15)


@query(f"WITH {_ROUND} SELECT chat, 1 AS depth, 'proposed' AS status FROM o WHERE i <= 15 UNION ALL SELECT chat, CASE WHEN chat IN (SELECT chat FROM s) THEN 1 ELSE 3 END, 'approved' FROM (SELECT DISTINCT chat FROM leads) WHERE chat LIKE '@o%'")
def discovered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after a round of discovery: known ones with their least depth, and the best fifteen new ones."""
    return _round(spark, sf_dir).candidates.select("chat", "depth", "status")


@query(f"""WITH {_ROUND}, t AS (SELECT DISTINCT chat_id FROM (SELECT range AS chat_id FROM range(0, 40, 2))), b AS (SELECT DISTINCT chat_id FROM s WHERE chat IN (SELECT chat FROM o WHERE i > 15)), n AS (SELECT chat_id, max(tick) AS newest FROM pages_ GROUP BY chat_id)
SELECT t.chat_id, CASE WHEN b.chat_id IS NOT NULL THEN CASE WHEN t.chat_id = 4 THEN 5 ELSE 0 END ELSE greatest(coalesce(newest, 0), CASE WHEN t.chat_id = 4 THEN 5 ELSE 0 END) END AS after FROM t LEFT JOIN b USING (chat_id) LEFT JOIN n USING (chat_id)""")
def discovery_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each chat was read: not further than before where a lead was cut off by the room."""
    return _round(spark, sf_dir).cursors.select("chat_id", "after")


@query(f"""WITH {_ROUND}, k AS (SELECT chat FROM o WHERE i <= 15 UNION SELECT DISTINCT chat FROM s WHERE chat LIKE '@o%') SELECT chat, count(DISTINCT origin) AS origins, count(*) FILTER (via <> 'directory') AS paths FROM s JOIN k USING (chat) GROUP BY chat""")
def discovery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What proves each candidate: distinct origins, and paths; what directories add proves nothing more."""
    found = _round(spark, sf_dir).evidence
    return found.groupBy("chat").agg(F.countDistinct("origin").alias("origins"), F.count(F.when(F.col("via") != "directory", 1)).alias("paths"))


@query(f"""WITH {_PAGES}, e AS (SELECT chat, origin, min((chat_id, msg_id, via)) AS e FROM leads GROUP BY ALL), r AS (SELECT chat, e, row_number() OVER (PARTITION BY chat ORDER BY e) AS i FROM e)
SELECT chat, count(*) AS shown, CAST(min(e[2]) FILTER (i = 1) AS BIGINT) AS first FROM r WHERE i <= 5 GROUP BY chat""".replace("e[2]", "struct_extract(e, 2)"))
def candidate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate with at most five pieces of evidence, an origin once; five are what a report shows."""
    found = checkpointed(_found(spark, sf_dir))
    told = results.candidate_report(leads.candidates(found), found)
    return told.select("chat", F.size("evidence").cast("long").alias("shown"), F.col("evidence")[0]["msg_id"].alias("first"))


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 2 END AS peer_id, CASE WHEN c_custkey % 4 > 0 THEN 'n' || c_custkey % 9 END AS username, c_custkey % 7 AS depth, c_custkey // 10 AS "group", c_custkey % 10 = 4 AS decided FROM customer),
g AS (SELECT *, min(id) OVER (PARTITION BY "group") AS first FROM c), k AS (SELECT * FROM g WHERE NOT (decided AND id <> first))
SELECT first AS id, arg_min(peer_id, id) FILTER (peer_id IS NOT NULL) AS peer_id, arg_min(username, id) FILTER (username IS NOT NULL) AS username, min(depth) AS depth FROM k GROUP BY first
UNION ALL SELECT id, peer_id, username, depth FROM g WHERE decided AND id <> first""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of candidates folded into their oldest; those with a decision stay beside."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 3 > 0, F.floor(key / 2).cast("long")).alias("peer_id"), F.when(key % 4 > 0, F.concat(F.lit("n"), (key % 9).cast("string"))).alias("username"),
        (key % 7).alias("depth"), (key % 10 == 4).alias("decided"), F.lit("proposed").alias("status"), F.floor(key / 10).cast("long").alias("_g"),
    )
    groups = c.join(c.groupBy("_g").agg(F.min("id").alias("group")), "_g").select("id", "group")
    return leads.merged_candidates(c.drop("_g"), groups).select("id", "peer_id", "username", "depth")


@query("SELECT c_custkey AS chat, CAST(greatest(0, c_custkey % 5 - CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS left_ FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 > 0")
def live_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that held, and what is left of them after some use."""
    key = F.col("c_custkey")
    grants = table(spark, sf_dir, "customer").select(key.alias("chat"), F.when(key % 3 == 0, 50).when(key % 3 == 1, 150).cast("long").alias("until"), (key % 5).alias("left"))
    used = grants.where("chat % 2 = 0").select("chat", F.explode(F.array(F.lit(1), F.lit(1))).alias("n"))
    return leads.consumed(leads.granted(grants, 100), used).select("chat", F.col("left").cast("long").alias("left_"))


@query("""WITH c AS (SELECT c_custkey AS chat, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 3 END AS peer_id, 'N' || c_custkey % 50 AS username FROM customer)
SELECT chat, 'excluded' AS what FROM c WHERE chat % 40 = 1 OR peer_id % 17 = 3 OR username = 'N9' UNION ALL SELECT chat, 'renamed' FROM c WHERE peer_id IS NOT NULL AND username = 'N4' AND peer_id <> 6""")
def covered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that exclusions cover under any spelling, and those whose name is another's now."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(key.alias("chat"), F.when(key % 2 == 0, F.floor(key / 3).cast("long")).alias("peer_id"), F.concat(F.lit("N"), (key % 50).cast("string")).alias("username"))
    null = F.lit(None)
    out = c.where("chat % 40 = 1").select("chat", null.cast("long").alias("peer_id"), null.cast("string").alias("username"))
    out = out.unionByName(c.where("peer_id % 17 = 3").select(null.cast("long").alias("chat"), "peer_id", null.cast("string").alias("username"))).unionByName(spark.range(1).select(null.cast("long").alias("chat"), null.cast("long").alias("peer_id"), F.lit("n9").alias("username")))
    moved = spark.range(1).select(F.lit("n4").alias("username"), F.lit(6).cast("long").alias("peer_id"))
    return leads.excluded_by(c, out).select("chat", F.lit("excluded").alias("what")).unionByName(leads.renamed_away(c, moved).select("chat", F.lit("renamed").alias("what")))


@query(f"WITH {_PAGES} SELECT DISTINCT chat, page_id AS chat_id FROM leads JOIN pages_ ON chat = '@' || lower(regexp_replace(hrefs[1], '[.,;:!?]+$', '')) OR chat = 'peer:' || -(1000000000000 + page_id)")
def held_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are chats of the index, by id or by user name."""
    first = F.regexp_replace(F.regexp_extract(F.replace("html", F.lit("@"), F.lit(" at ")), r"href=\"/([^\"<>\s'`]*)", 1), r"[.,;:!?]+$", "")
    index = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (-(F.lit(10**12) + F.col("page_id"))).alias("peer_id"), first.alias("username"))
    return leads.held(_found(spark, sf_dir).select("chat").distinct(), index)
