"""Queries of units kept current: late and edited messages, threads, posts and comments, whole chats."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema
from parlance.budget import Budget
from parlance.operators import units, upkeep
from parlance.operators.sweep import Sweep, sweep
from parlance.operators.vectors import VectorLog
from parlance.queries.base import EVENTS, TALKS, notes, query, table, talks
from parlance.storage import checkpointed, comment_counts, shared_folder, written
from parlance.streaming.changes import Changes
from parlance.streaming.maintenance import Store

_LIMITS = {"gap_min": 720, "max_msgs": 5, "max_chars": 140}


def _windows_sql(rows: str) -> str:
    """Greedy windows of ``rows`` (chat_id, topic_id, msg_id, date, reactions, line)."""
    cut = "p.date - c.date > 43200 OR c.n >= 5 OR c.chars + 1 + length(p.line) > 140"
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY chat_id, topic_id ORDER BY date, msg_id) AS i FROM {rows}), cut AS (
  SELECT chat_id, topic_id, msg_id, date, reactions, line, i, CAST(0 AS BIGINT) AS w, CAST(1 AS BIGINT) AS n, CAST(length(line) AS BIGINT) AS chars FROM placed WHERE i = 1
  UNION ALL
  SELECT p.chat_id, p.topic_id, p.msg_id, p.date, p.reactions, p.line, p.i, c.w + CASE WHEN {cut} THEN 1 ELSE 0 END,
    CASE WHEN {cut} THEN 1 ELSE c.n + 1 END, CASE WHEN {cut} THEN length(p.line) ELSE c.chars + 1 + length(p.line) END
  FROM cut c JOIN placed p ON p.chat_id = c.chat_id AND p.topic_id IS NOT DISTINCT FROM c.topic_id AND p.i = c.i + 1)
SELECT chat_id, topic_id, min(msg_id) AS msg_id_start, max(msg_id) AS msg_id_end, min(date) AS date_start, max(date) AS date_end,
  string_agg(line, chr(10) ORDER BY date, msg_id) AS text, CAST(sum(reactions) AS BIGINT) AS reactions FROM cut GROUP BY chat_id, topic_id, w"""


_NOTES = """n AS (SELECT *, CASE WHEN chat_id % 3 = 0 AND msg_id % 4 > 0 THEN msg_id % 4 END AS topic_id FROM notes)"""
_SHOWN = ["chat_id", "topic_id", "msg_id_start", "msg_id_end", "date_start", "date_end", "text", "reactions"]


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return schema.conform(ids.select("id", (F.col("id") % 3 == 0).alias("is_forum"), F.lit(False).alias("is_broadcast")), schema.CHATS)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored messages; every third chat is a forum, and the topics of others count for nothing."""
    n = notes(spark, sf_dir).withColumn("topic_id", F.when(F.col("msg_id") % 4 > 0, F.col("msg_id") % 4)).withColumn("from_id", F.col("chat_id"))
    return schema.conform(n, schema.MESSAGES)


def _shown(cut: DataFrame) -> DataFrame:
    return cut.where("kind = 'window'").select(*_SHOWN)


@query(f"WITH RECURSIVE {EVENTS}, {_NOTES}, {_windows_sql('n')}")
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows after every third message came late, below windows that were cut already: as if all had been there at once."""
    m, c = _notes(spark, sf_dir), _chats(spark, sf_dir)
    stored = m.where("msg_id % 3 <> 1")
    cut = written(upkeep.with_ids(units.windows(units.render(units.window_topic(stored, c)), **_LIMITS)))
    gone, new = upkeep.rebuild(m, cut, m.where("msg_id % 3 = 1"), c, **_LIMITS)
    return _shown(upkeep.applied(cut, gone, new))


@query(f"""WITH RECURSIVE {EVENTS}, {_NOTES}, e AS (SELECT chat_id, topic_id, msg_id, date, reactions, CASE WHEN msg_id % 50 = 7 THEN line || ' (edited)' ELSE line END AS line FROM n WHERE msg_id % 40 <> 3), {_windows_sql('e')}""")
def invalidated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows after messages in closed ones were edited, and others deleted."""
    m, c = _notes(spark, sf_dir), _chats(spark, sf_dir)
    cut = written(upkeep.with_ids(units.windows(units.render(units.window_topic(m, c)), **_LIMITS)))
    now = m.where("msg_id % 40 <> 3").withColumn("text", F.when(F.col("msg_id") % 50 == 7, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    gone, new = upkeep.invalidate(now, cut, m.where("msg_id % 40 = 3 or msg_id % 50 = 7"), c, **_LIMITS)
    return _shown(upkeep.applied(cut, gone, new))


@query(f"""WITH {EVENTS}, {_NOTES}, w AS (SELECT chat_id, topic_id, min(msg_id) AS a, max(msg_id) AS b FROM n WHERE msg_id % 11 <> 5 GROUP BY chat_id, topic_id, msg_id // 700),
o AS (SELECT chat_id, topic_id, max(b) AS b, arg_max(a, b) AS a FROM w GROUP BY ALL),
c AS (SELECT chat_id, topic_id, max(msg_id) AS top, min(CASE WHEN msg_id % 11 = 5 THEN msg_id END) AS loose FROM n WHERE msg_id % 11 IN (4, 5) GROUP BY ALL)
SELECT c.chat_id, c.topic_id, CASE WHEN o.a IS NULL THEN NULL WHEN loose < o.a THEN coalesce((SELECT max(w.a) FROM w WHERE w.chat_id = c.chat_id AND w.topic_id IS NOT DISTINCT FROM c.topic_id AND w.a <= loose), loose) ELSE o.a END AS start
FROM c LEFT JOIN o ON o.chat_id = c.chat_id AND o.topic_id IS NOT DISTINCT FROM c.topic_id WHERE o.a IS NULL OR loose < o.a OR top >= o.a""")
def recut_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where windows are cut again, of each chat and topic, after some messages came that no window lists, and others were edited."""
    m = units.window_topic(_notes(spark, sf_dir), _chats(spark, sf_dir))
    cut = m.where("msg_id % 11 <> 5").groupBy("chat_id", "topic_id", F.floor(F.col("msg_id") / 700)).agg(F.min("msg_id").alias("msg_id_start"), F.max("msg_id").alias("msg_id_end"), F.collect_list("msg_id").alias("msg_ids"))
    cut = checkpointed(cut.withColumn("kind", F.lit("window")).withColumn("unit_id", F.xxhash64("chat_id", "topic_id", "msg_id_start")))
    return upkeep.recut_starts(m.where("msg_id % 11 in (4, 5)"), cut)


@query(f"WITH {EVENTS}, {_NOTES} SELECT chat_id, msg_id FROM n WHERE msg_id % 3 = 0 AND chat_id % 2 = 0")
def windowed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a window of their topic lists, and not those it only spans."""
    m = units.window_topic(_notes(spark, sf_dir), _chats(spark, sf_dir))
    cut = m.where("msg_id % 3 = 0 and chat_id % 2 = 0").groupBy("chat_id", "topic_id").agg(F.collect_list("msg_id").alias("msg_ids")).withColumn("kind", F.lit("window"))
    return upkeep.windowed(m, cut).select("chat_id", "msg_id")


@query(f"WITH {EVENTS}, {_NOTES} SELECT chat_id, msg_id FROM n WHERE (chat_id, coalesce(topic_id, -1)) NOT IN (SELECT (chat_id, coalesce(topic_id, -1)) FROM n WHERE msg_id % 20 = 1)")
def rows_without_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of topics that have no window at all."""
    m = units.window_topic(_notes(spark, sf_dir), _chats(spark, sf_dir))
    cut = m.where("msg_id % 20 = 1").select("chat_id", "topic_id", F.lit("window").alias("kind"))
    return upkeep.uncut_rows(m, cut).select("chat_id", "msg_id")


_THREADS = f"""{TALKS}, climb AS (
  SELECT chat_id, msg_id, msg_id AS root, reply_to_msg_id AS up FROM talks
  UNION ALL SELECT c.chat_id, c.msg_id, t.msg_id, t.reply_to_msg_id FROM climb c JOIN talks t ON t.chat_id = c.chat_id AND t.msg_id = c.up),
roots AS (SELECT chat_id, msg_id, min(root) AS root FROM climb GROUP BY ALL),
lines AS (SELECT *, '[' || strftime(to_timestamp(date) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || '] ' || from_name || ': ' || trim(text, ' \t\n\r') AS line FROM talks),
pieces AS (SELECT r.chat_id, r.root, l.msg_id, l.date, l.line, l.reactions, (row_number() OVER (PARTITION BY r.chat_id, r.root ORDER BY l.date, l.msg_id) - 1) // 2 AS piece FROM roots r JOIN lines l USING (chat_id, msg_id) WHERE r.msg_id <> r.root)
SELECT p.chat_id, p.root AS msg_id_start, max(p.msg_id) AS msg_id_end, min(h.date) AS date_start, max(p.date) AS date_end, min(h.line) || chr(10) || string_agg(p.line, chr(10) ORDER BY p.date, p.msg_id) AS text, CAST(sum(p.reactions) + min(h.reactions) AS BIGINT) AS reactions
FROM pieces p JOIN lines h ON h.chat_id = p.chat_id AND h.msg_id = p.root GROUP BY p.chat_id, p.root, piece"""


@query(f"WITH RECURSIVE {_THREADS}")
def rebuilt_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply threads of at most three messages, after the latter half of the messages came: whole threads from their tops on."""
    m = checkpointed(schema.conform(talks(spark, sf_dir), schema.MESSAGES))
    c = m.select(F.col("chat_id").alias("id"), F.lit(False).alias("is_forum"), F.lit(False).alias("is_broadcast")).distinct()
    cut = upkeep.with_ids(units.threads(units.render(m.where("msg_id < 4")), cap=3))
    gone, new = upkeep.rebuild(m, cut, m.where("msg_id >= 4"), c, cap=3)
    return upkeep.applied(cut, gone, new).where("kind = 'thread'").select("chat_id", "msg_id_start", "msg_id_end", "date_start", "date_end", "text", "reactions")


@query(f"""WITH {TALKS}, p AS (SELECT chat_id, msg_id, date, '[' || strftime(to_timestamp(date) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || '] ' || from_name || ': ' || trim(text, ' \t\n\r') AS line FROM talks),
c AS (SELECT chat_id, date, line, (row_number() OVER (PARTITION BY chat_id ORDER BY date, msg_id) - 1) // 2 AS piece FROM p WHERE msg_id > 0)
SELECT p.chat_id, max(c.date) AS date_end, min(p.line) || chr(10) || string_agg(c.line, chr(10) ORDER BY c.date) AS text FROM c JOIN p ON p.chat_id = c.chat_id AND p.msg_id = 0 GROUP BY p.chat_id, piece""")
def arrived_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post threads of three messages after more comments came: first turns are channels' posts, others comments in their groups."""
    t = schema.conform(talks(spark, sf_dir), schema.MESSAGES)
    posts = t.where("msg_id = 0")
    comments = t.where("msg_id > 0").withColumn("comment_of_chat_id", F.col("chat_id")).withColumn("comment_of_msg_id", F.lit(0).cast("long")).withColumn("chat_id", F.col("chat_id") + 10_000_000).withColumn("reply_to_msg_id", F.lit(None).cast("long"))
    m = checkpointed(posts.unionByName(comments))
    c = m.select(F.col("chat_id").alias("id"), F.lit(False).alias("is_forum"), (F.col("chat_id") < 10_000_000).alias("is_broadcast"), F.when(F.col("chat_id") >= 10_000_000, F.col("chat_id") - 10_000_000).alias("discussion_of")).distinct()
    lines = units.render(m.where("msg_id < 3"))
    cut = upkeep.with_ids(units.posts(lines.where("comment_of_chat_id is null")).unionByName(units.post_threads(lines.where("comment_of_chat_id is null"), lines, cap=3)))
    gone, new = upkeep.rebuild(m, cut, m.where("msg_id >= 3"), c, cap=3)
    return upkeep.applied(cut, gone, new).where("kind = 'thread'").select("chat_id", "date_end", "text")


@query(f"WITH {TALKS} SELECT chat_id + 10000000 AS chat_id, chat_id AS channel_id, CAST(0 AS BIGINT) AS post_id, count(*) AS comments FROM talks WHERE msg_id > 0 GROUP BY ALL")
def counted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many comments are stored of each post, by the group that holds them."""
    t = schema.conform(talks(spark, sf_dir), schema.MESSAGES).where("msg_id > 0")
    return comment_counts(t.withColumn("comment_of_chat_id", F.col("chat_id")).withColumn("comment_of_msg_id", F.lit(0)).withColumn("chat_id", F.col("chat_id") + 10_000_000))


@query(f"""WITH RECURSIVE {EVENTS}, {_NOTES}, {_windows_sql('n').replace('43200', '1800').replace('c.n >= 5', 'c.n >= 30').replace('> 140', '> 1500')}""")
def recut_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows after every second chat was cut again under changed rules, the others having had them before."""
    m, c = checkpointed(_notes(spark, sf_dir)), _chats(spark, sf_dir)
    lines = units.render(units.window_topic(m, c))
    cut = upkeep.with_ids(units.windows(lines.where("chat_id % 2 = 0"), **_LIMITS).unionByName(units.windows(lines.where("chat_id % 2 = 1"))))
    gone, new = upkeep.recut_chats(m, cut, c.where("id % 2 = 0").select(F.col("id").alias("chat_id")), c)
    return _shown(upkeep.applied(cut, gone, new))


@query(f"""WITH {EVENTS}, s AS (SELECT chat_id, msg_id FROM notes WHERE msg_id % 6 = 1 AND chat_id % 5 = 2) SELECT chat_id, msg_id FROM s WHERE chat_id IN (SELECT DISTINCT chat_id FROM s ORDER BY chat_id LIMIT 10)""")
def stranded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an earlier run left without units, of the ten first chats that have any: what a run mends at most."""
    m = _notes(spark, sf_dir).withColumn("indexed", ~((F.col("msg_id") % 6 == 1) & (F.col("chat_id") % 5 == 2)))
    return upkeep.stranded(m, 10)


@query(f"WITH {EVENTS} SELECT chat_id, msg_id FROM notes ORDER BY chat_id, msg_id LIMIT 700")
def budgeted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget of 700 messages takes of a batch, oldest first, chat by chat."""
    return upkeep.affordable(_notes(spark, sf_dir), 700).select("chat_id", "msg_id")


@query(f"""WITH {EVENTS} SELECT chat_id, min(msg_id) AS first, count(*) AS n, CAST(sum(reactions + CASE WHEN msg_id % 7 = 3 THEN 10 ELSE 0 END) AS BIGINT) AS reactions FROM notes GROUP BY chat_id, msg_id // 500""")
def reaction_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units' reactions, unit by unit, after some of their messages got ten more; no unit changes otherwise."""
    m = checkpointed(_notes(spark, sf_dir))
    cut = m.groupBy("chat_id", F.floor(F.col("msg_id") / 500)).agg(F.collect_list("msg_id").alias("msg_ids"), F.sum("reactions").alias("reactions"), F.min("msg_id").alias("unit_id"))
    now = m.withColumn("reactions", F.col("reactions") + F.when(F.col("msg_id") % 7 == 3, 10).otherwise(0))
    return upkeep.units_with_reactions(cut, now, m.where("msg_id % 7 = 3")).select("chat_id", F.col("unit_id").alias("first"), F.size("msg_ids").cast("long").alias("n"), "reactions")


# who reaches a customer's orders, who of them can be asked, and what they say
_SWEEP = """m AS (SELECT o_custkey AS chat_id, o_orderkey AS msg_id FROM orders),
accounts AS (SELECT 'a' || range AS account, range AS n FROM range(4)),
reach AS (SELECT c_custkey AS chat_id, account FROM customer, accounts WHERE (c_custkey + n) % 3 > 0 AND c_custkey % 11 > 0 AND (n < 3 OR c_custkey % 7 = 0)),
refused AS (SELECT chat_id, account FROM reach WHERE chat_id % 5 = 0 AND (account = 'a1' OR chat_id % 10 = 0)),
said AS (SELECT m.chat_id, msg_id, account, (msg_id + n) % 4 = 0 AS there FROM m JOIN accounts ON n < 3 WHERE (msg_id // 32 + n) % 9 > 0 AND m.chat_id * 10 + n NOT IN (SELECT r.chat_id * 10 + CAST(substr(r.account, 2) AS BIGINT) FROM refused r)),
who AS (SELECT chat_id, count(*) AS w, count(*) FILTER (account <> 'a3') AS asked, count(*) FILTER ((chat_id, account) IN (SELECT (chat_id, account) FROM refused)) AS refusals,
  count(*) FILTER (account <> 'a3' AND (chat_id, account) IN (SELECT (chat_id, account) FROM said)) AS speakers FROM reach GROUP BY chat_id),
paged AS (SELECT *, (row_number() OVER (PARTITION BY chat_id ORDER BY msg_id) - 1) // 3 AS page FROM m),
votes AS (SELECT chat_id, msg_id, bool_or(there) AS there, count(*) FILTER (NOT there) AS empty FROM said JOIN reach USING (chat_id, account) GROUP BY chat_id, msg_id),
told AS (SELECT p.chat_id, msg_id, page, w, asked, refusals, speakers, coalesce(asked = w AND refusals = 0 AND NOT coalesce(there, false) AND coalesce(empty, 0) = w, false) AS gone,
  coalesce(asked = w AND refusals = 0 AND coalesce(there, false), false) AS kept FROM paged p LEFT JOIN votes USING (chat_id, msg_id) LEFT JOIN who USING (chat_id)),
ends AS (SELECT chat_id, min(page) FILTER (NOT gone AND NOT kept) AS stop FROM told GROUP BY chat_id),
passed AS (SELECT t.* FROM told t JOIN ends USING (chat_id) WHERE stop IS NULL OR page < stop)"""


def _sweep(spark: SparkSession, sf_dir: str) -> Sweep:
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("msg_id"))
    account = lambda n: F.concat(F.lit("a"), n.cast("string"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    key, n = F.col("chat_id"), F.col("n")
    reach = c.where(((key + n) % 3 > 0) & (key % 11 > 0) & ((n < 3) | (key % 7 == 0))).select("chat_id", account(n).alias("account"))
    refused = reach.where((key % 5 == 0) & ((F.col("account") == "a1") | (key % 10 == 0)))
    said = m.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.floor(F.col("msg_id") / 32) + n) % 9 > 0)
    said = said.select("chat_id", "msg_id", account(n).alias("account"), ((F.col("msg_id") + n) % 4 == 0).alias("there")).join(refused, ["chat_id", "account"], "left_anti")
    return sweep(m, reach, spark.createDataFrame([(f"a{k}",) for k in range(3)], "account string"), said, refused, page=3)


@query(f"WITH {_SWEEP} SELECT chat_id, msg_id FROM passed WHERE gone")
def swept_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that every account which reaches the customer says are gone, page by page."""
    return _sweep(spark, sf_dir).gone


@query(f"""WITH {_SWEEP}, sums AS (SELECT chat_id, count(*) AS checked, count(*) FILTER (gone) AS removed, max(msg_id) AS last FROM passed GROUP BY chat_id),
out AS (SELECT e.chat_id, CASE WHEN coalesce(asked, 0) = 0 THEN 'unreachable' WHEN asked < w THEN 'remaining' WHEN refusals > 0 AND speakers > 0 THEN 'held' WHEN refusals > 0 OR stop IS NOT NULL THEN 'remaining' ELSE 'done' END AS outcome,
  coalesce(removed, 0) AS removed, coalesce(checked, 0) AS checked, last FROM ends e LEFT JOIN who USING (chat_id) LEFT JOIN sums USING (chat_id))
SELECT chat_id, outcome, removed, checked, CASE WHEN outcome <> 'done' THEN last END AS after FROM out""")
def sweep_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each customer's sweep: done, remaining, held by a refusal, or out of reach."""
    return _sweep(spark, sf_dir).chats


class _Stopped(Store):
    """A store that stops before its commit, as a run that is killed there."""

    def commit(self, touched: list[int], number: int) -> None:
        raise InterruptedError


@query(f"""WITH RECURSIVE {EVENTS}, {_NOTES}, e AS (SELECT chat_id, topic_id, msg_id, date, reactions, CASE WHEN msg_id % 50 = 7 THEN line || ' (edited)' ELSE line END AS line FROM n WHERE msg_id % 40 <> 3), {_windows_sql('e')}""")
def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows after edits and deletions whose run was killed before its commit, finished by the next run from what was written down."""
    m, c = _notes(spark, sf_dir), _chats(spark, sf_dir)
    folder = f"{shared_folder(spark)}/changes-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    first = Changes(Store(spark, folder, buckets=8), c, **_LIMITS)
    first.declare(put=m)
    first.replay()
    edited = m.where("msg_id % 50 = 7").withColumn("text", F.concat("text", F.lit(" (edited)")))
    killed = Changes(_Stopped(spark, folder, buckets=8), c, **_LIMITS)
    killed.declare(put=edited, drop=m.where("msg_id % 40 = 3"))
    with contextlib.suppress(InterruptedError):
        killed.replay()
    again = Changes(Store(spark, folder, buckets=8), c, **_LIMITS)
    again.replay()
    return _shown(again.store.read("units"))


@query("""SELECT o_orderkey AS unit_id, o_custkey AS chat_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4096 AS slice,
CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 2 * 4096 THEN 1 ELSE 2 END AS run FROM orders""")
def embedded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' comments embedded in slices: a run whose time is up after two slices, and one that goes on from there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("chat_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("date_start"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    log = VectorLog(spark, f"{shared_folder(spark)}/vectors-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    looks = iter([0, 0, 0, 9])  # the clock at the start and at each look between slices
    log.embed(o, size=4096, budget=Budget(1, clock=lambda: next(looks, 9)))
    log.embed(o, size=4096)
    return log.rows().select("unit_id", "chat_id", "slice", "run")
