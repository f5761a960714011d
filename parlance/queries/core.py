"""Queries of functions, units, retrieval, readers, storage and streams, each with its twin in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import links as ln
from parlance.functions import text as tx
from parlance.operators import chats as ch
from parlance.operators import dense, leads, lexical, rank, readers, units
from parlance.queries.base import EVENTS, ORACLES, TALKS, notes, query, table, talks
from parlance.storage import PENDING, changed, checkpointed, deleted, latest, merge, next_media_state, shared_folder, spread
from parlance.streaming.maintenance import Store, maintain
from parlance.streaming.windows import WindowLog, keep_windows


# ------------------------------------------------------------------ functions


@query(f"""WITH {TALKS}
SELECT chat_id, msg_id, '[' || strftime(to_timestamp(date) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || '] ' || from_name || ': ' || trim(text, ' \t\n\r') AS line FROM talks""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as the line that stands for it in a unit."""
    return units.render(talks(spark, sf_dir)).select("chat_id", "msg_id", "line")


@query(r"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY token""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and in how many each is."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query()
def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all documents: distinct tokens are stemmed, once each."""
    tokens = token_counts(spark, sf_dir)
    stemmed = tokens.withColumn("stem", tx.stems(F.array("token"))[0])
    return stemmed.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[Ѐ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ]') THEN 'russian'
  WHEN regexp_matches(lower(text), '[a-zÀ-ɏ]') THEN 'english' END AS stemmer,
  CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS clipped FROM documents""")
def stemmer_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stemmer a text asks for, and its first 80 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.language(F.col("text")).alias("stemmer"), tx.clip(F.col("text"), 80).alias("clipped"))


@query(f"""WITH {TALKS}, kinds AS (SELECT *, ['channel', 'supergroup', 'group', 'user'][CAST(chat_id % 4 AS INT) + 1] AS kind FROM talks)
SELECT chat_id, msg_id, kind, CASE kind WHEN 'channel' THEN 'https://t.me/c/' || chat_id || '/' || msg_id
  WHEN 'supergroup' THEN 'https://t.me/room' || chat_id || '/5/' || msg_id
  WHEN 'group' THEN 'tg://openmessage?chat_id=' || chat_id || '&message_id=' || msg_id
  ELSE 'tg://openmessage?user_id=' || chat_id || '&message_id=' || msg_id END AS url FROM kinds""")
def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep links of messages in chats of four kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("channel", "supergroup", "group", "user"))), (F.col("chat_id") % 4 + 1).cast("int"))
    rows = talks(spark, sf_dir).select("chat_id", "msg_id", kind.alias("kind"))
    peer = ln.marked_id(F.col("chat_id"), F.col("kind"))
    name = F.when(F.col("kind") == "supergroup", F.concat(F.lit("room"), F.col("chat_id").cast("string")))
    return rows.withColumn("url", ln.message_url(F.col("kind"), peer, name, F.col("kind") == "supergroup", F.col("msg_id"), F.lit(5)))


@query(f"""WITH {TALKS} SELECT chat_id, msg_id, CASE WHEN reactions > 0 THEN round(ln(1 + reactions) / (1 + ln(1 + reactions)), 9) ELSE 0.0 END AS share FROM talks""")
def reaction_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reactions add to a score."""
    return talks(spark, sf_dir).select("chat_id", "msg_id", F.round(tx.reaction_share(F.col("reactions")), 9).alias("share"))


# ---------------------------------------------------------------------- units


@query(f"""WITH RECURSIVE {EVENTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY date, msg_id) AS i FROM notes), cut AS (
  SELECT chat_id, msg_id, date, reactions, line, i, CAST(0 AS BIGINT) AS w, CAST(1 AS BIGINT) AS n, CAST(length(line) AS BIGINT) AS chars FROM placed WHERE i = 1
  UNION ALL
  SELECT p.chat_id, p.msg_id, p.date, p.reactions, p.line, p.i,
    c.w + CASE WHEN p.date - c.date > 43200 OR c.n >= 5 OR c.chars + 1 + length(p.line) > 140 THEN 1 ELSE 0 END,
    CASE WHEN p.date - c.date > 43200 OR c.n >= 5 OR c.chars + 1 + length(p.line) > 140 THEN 1 ELSE c.n + 1 END,
    CASE WHEN p.date - c.date > 43200 OR c.n >= 5 OR c.chars + 1 + length(p.line) > 140 THEN length(p.line) ELSE c.chars + 1 + length(p.line) END
  FROM cut c JOIN placed p ON p.chat_id = c.chat_id AND p.i = c.i + 1)
SELECT chat_id, min(msg_id) AS msg_id_start, max(msg_id) AS msg_id_end, count(*) AS n, min(date) AS date_start, max(date) AS date_end,
  string_agg(line, chr(10) ORDER BY date, msg_id) AS text, CAST(sum(reactions) AS BIGINT) AS reactions FROM cut GROUP BY chat_id, w""")
def window_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time windows of users' events: cut at gaps of half a day, five messages, or 140 characters."""
    cut = units.windows(notes(spark, sf_dir), gap_min=720, max_msgs=5, max_chars=140)
    return cut.select("chat_id", "msg_id_start", "msg_id_end", F.size("msg_ids").cast("long").alias("n"), "date_start", "date_end", "text", "reactions")


@query(f"""WITH {EVENTS}, marked AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY chat_id ORDER BY date) > 86400 THEN 1 ELSE 0 END AS fresh FROM notes),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM marked)
SELECT chat_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(date) AS date_start, max(date) AS date_end FROM numbered GROUP BY ALL""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: a pause of over a day ends one."""
    rows = units.gap_sessions(notes(spark, sf_dir), "chat_id", "date", "msg_id", 86_400)
    return rows.groupBy("chat_id", "session").agg(F.count("*").alias("n"), F.min("date").alias("date_start"), F.max("date").alias("date_end"))


_ROOTS = f"""{TALKS}, climb AS (
  SELECT chat_id, msg_id, msg_id AS root, reply_to_msg_id AS up FROM talks
  UNION ALL SELECT c.chat_id, c.msg_id, t.msg_id, t.reply_to_msg_id FROM climb c JOIN talks t ON t.chat_id = c.chat_id AND t.msg_id = c.up),
roots AS (SELECT chat_id, msg_id, min(root) AS root FROM climb GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_ROOTS} SELECT chat_id, msg_id, root FROM roots")
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of every reply chain."""
    return units.reply_roots(talks(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ROOTS}, replies AS (SELECT r.chat_id, r.root, t.msg_id, t.date, t.reactions, (row_number() OVER (PARTITION BY r.chat_id, r.root ORDER BY t.date, t.msg_id) - 1) // 1 AS piece
  FROM roots r JOIN talks t USING (chat_id, msg_id) WHERE r.msg_id <> r.root)
SELECT r.chat_id, r.root AS msg_id_start, max(r.msg_id) AS msg_id_end, count(*) + 1 AS n, min(h.date) AS date_start, max(r.date) AS date_end, CAST(sum(r.reactions) + min(h.reactions) AS BIGINT) AS reactions
FROM replies r JOIN talks h ON h.chat_id = r.chat_id AND h.msg_id = r.root GROUP BY r.chat_id, r.root, piece""")
def thread_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply threads in pieces of two messages, the root in each."""
    cut = units.threads(units.render(talks(spark, sf_dir)), cap=2)
    return cut.select("chat_id", "msg_id_start", "msg_id_end", F.size("msg_ids").cast("long").alias("n"), "date_start", "date_end", "reactions")


@query(f"""WITH {TALKS}, c AS (SELECT chat_id, msg_id, date, (row_number() OVER (PARTITION BY chat_id ORDER BY date, msg_id) - 1) // 2 AS piece FROM talks WHERE msg_id > 0)
SELECT p.chat_id, CAST(0 AS BIGINT) AS post_id, count(*) AS comments, max(c.date) AS date_end, min(p.reactions) AS reactions FROM c JOIN talks p ON p.chat_id = c.chat_id AND p.msg_id = 0 GROUP BY p.chat_id, piece""")
def post_comment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as posts, the others as their comments, three messages a piece."""
    lines = units.render(talks(spark, sf_dir))
    comments = lines.where("msg_id > 0").select("*", F.col("chat_id").alias("comment_of_chat_id"), F.lit(0).cast("long").alias("comment_of_msg_id")).withColumn("line", F.lit("comment"))
    cut = units.post_threads(lines.where("msg_id = 0").withColumn("line", F.lit("post")), comments, cap=3)
    return cut.select("chat_id", F.col("msg_id_start").alias("post_id"), (F.size(F.split("text", "\n")) - 1).cast("long").alias("comments"), "date_end", "reactions")


def _event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    cut = units.windows(rows, gap_min=720, max_msgs=5, max_chars=140)
    return cut.withColumn("unit_id", F.xxhash64("chat_id", "msg_id_start"))


@query(f"""WITH {EVENTS} SELECT chat_id, CAST(sum(reactions) + count(*) AS BIGINT) AS reactions, count(*) AS listed FROM notes GROUP BY chat_id""")
def refreshed_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units' reactions summed again after each message got one more."""
    cut = _event_units(spark, sf_dir)
    now = units.refresh_reactions(cut, notes(spark, sf_dir).withColumn("reactions", F.col("reactions") + 1))
    return now.groupBy("chat_id").agg(F.sum("reactions").alias("reactions"), F.sum(F.size("msg_ids")).cast("long").alias("listed"))


@query(f"""WITH {EVENTS} SELECT 'gone' AS what, count(*) AS n FROM notes WHERE chat_id % 10 = 3 UNION ALL SELECT 'new', count(*) FROM notes WHERE chat_id % 10 = 4""")
def changed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that go and units that come, by what they hold."""
    u = units.posts(notes(spark, sf_dir))
    gone, new = units.unit_delta(u.where("chat_id % 10 <> 4"), u.where("chat_id % 10 <> 3").withColumn("reactions", F.lit(0).cast("long")))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(gone, "gone").union(count(new, "new"))


@query(f"WITH {EVENTS} SELECT msg_id FROM notes WHERE chat_id % 2 = 1")
def uncut_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that no window lists."""
    return units.uncut(notes(spark, sf_dir), _event_units(spark, sf_dir).where("chat_id % 2 = 0")).select("msg_id")


# ------------------------------------------------------------------- retrieval

_WORDS = ["the", "thand", "ononer", "tion"]

_BM25 = r"""terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
sizes AS (SELECT d.doc_id, count(t.term) AS size FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY d.doc_id),
whole AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
held AS (SELECT doc_id, term, 2.0 * count(*) AS f FROM terms WHERE term IN ('the', 'thand', 'ononer', 'tion') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
scored AS (SELECT doc_id, count(*) AS hits,
  sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM held JOIN df USING (term) JOIN sizes USING (doc_id), whole GROUP BY doc_id)"""


def _raw_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("raw"))


@query(f"WITH {_BM25} SELECT doc_id, hits, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of all documents for four words, on the plain column."""
    found = lexical.bm25(_raw_terms(spark, sf_dir), _WORDS, "doc_id", {"raw": 2.0})
    return found.select("doc_id", "hits", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, tier, CAST(row_number() OVER (ORDER BY tier, score DESC, doc_id) AS INT) AS place FROM (SELECT *, CASE WHEN hits >= 4 THEN 0 ELSE 1 END AS tier FROM scored) QUALIFY place <= 50")
def all_words_then_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50: documents with all four words, then those with any."""
    found = lexical.bm25(_raw_terms(spark, sf_dir), _WORDS, "doc_id", {"raw": 2.0})
    return lexical.and_then_or(found, len(_WORDS), 50, "doc_id").select("doc_id", "tier", "place")


@query(f"WITH {_BM25} SELECT s.doc_id, round(score, 6) AS score FROM scored s JOIN documents d ON d.doc_id = s.doc_id WHERE d.lang = 'en'")
def filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter changes what is returned, and no score."""
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    found = lexical.bm25(_raw_terms(spark, sf_dir), _WORDS, "doc_id", {"raw": 2.0}, allowed)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(r"""SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings."""
    return lexical.postings(_raw_terms(spark, sf_dir), "doc_id", {"raw": 2.0}).select("term", "doc_id", "tf")


@query("SELECT doc_id, 'missing' AS what FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'stale' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0")
def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index lacks, and what it has too much."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return lexical.index_gaps(docs.where("doc_id % 5 <> 0 or doc_id % 7 = 0"), docs.where("doc_id % 7 <> 0"), "doc_id")


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(distance, 6) + 0.0 AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT query_id, vec_id, 1 - list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda x: x[1] * x[2]))
      / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(q AS DOUBLE[]), lambda x: x * x)))) AS distance
    FROM embeddings JOIN q USING (label))) WHERE rank <= 10""")
def nearest_in_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, each within its own label."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    found = dense.knn_each(v, asked, 10, by="label")
    return found.select("query_id", "vec_id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3), d AS (
  SELECT vec_id, 1 - list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) AS distance
  FROM embeddings, q WHERE label IN (1, 2, 3))
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 20""")
def filtered_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest to one vector among three labels; the filter is in the scan."""
    v = table(spark, sf_dir, "embeddings")
    asked = [float(x) for x in v.where("vec_id = 3").head().embedding]
    found = dense.knn(v.withColumnRenamed("label", "chat_id").withColumn("date_start", F.lit(0)), asked, 20, [1, 2, 3], key="vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all conversations' turns; zero vectors are not stored."""
    turns = talks(spark, sf_dir).withColumn("unit_id", F.xxhash64("chat_id", "msg_id")).withColumnRenamed("date", "date_start")
    none = turns.limit(0).select("unit_id", "chat_id", "date_start", F.array(F.lit(0.0).cast("float")).alias("embedding"))
    return dense.embed_dirty(turns, none)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars % 97, doc_id) AS place FROM documents QUALIFY place <= 100)
SELECT doc_id, round(sum(1.0 / (60 + place)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of documents by reciprocal rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    top = lambda order: docs.orderBy(*order).limit(100).withColumn("place", F.row_number().over(units.Window.orderBy(*order))).select("doc_id", "place")
    fused = rank.rrf([top([F.desc("n_chars"), "doc_id"]), top([F.col("n_chars") % 97, "doc_id"])], "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {TALKS}, c AS (SELECT chat_id, CAST(sum(reactions) AS BIGINT) AS reactions, CAST(count(*) AS DOUBLE) AS score FROM talks GROUP BY chat_id)
SELECT chat_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) + 0.05 * (ln(1 + reactions) / (1 + ln(1 + reactions))), 9) AS score FROM c""")
def reaction_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on a common span, with what reactions add."""
    c = talks(spark, sf_dir).groupBy("chat_id").agg(F.sum("reactions").alias("reactions"), F.count("*").cast("double").alias("score"))
    boosted = rank.reaction_bonus(c)
    return boosted.select("chat_id", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS unit_id, list_sort(list_distinct(list(l_suppkey))) AS ids, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_orderkey) AS place FROM lineitem GROUP BY l_orderkey),
fold AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[][]) AS kept, CAST(NULL AS BIGINT) AS unit_id
  UNION ALL SELECT o.place, CASE WHEN list_bool_or(list_transform(f.kept, lambda x: 2 * len(list_intersect(o.ids, x)) >= len(o.ids))) THEN f.kept ELSE list_append(f.kept, o.ids) END,
    CASE WHEN list_bool_or(list_transform(f.kept, lambda x: 2 * len(list_intersect(o.ids, x)) >= len(o.ids))) THEN NULL ELSE o.unit_id END
  FROM fold f JOIN o ON o.place = f.place + 1 WHERE o.place <= 40)
SELECT unit_id, CAST(place AS INT) AS place FROM fold WHERE unit_id IS NOT NULL""")
def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best forty candidates, as many as a search reranks, those that overlap no better one by half."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("msg_ids"), F.sum("l_quantity").alias("score")).orderBy(F.desc("score"), "l_orderkey").limit(40)
    c = best.select(F.col("l_orderkey").alias("unit_id"), F.lit(1).alias("chat_id"), "msg_ids", "score", F.row_number().over(units.Window.orderBy(F.desc("score"), "l_orderkey")).alias("place"))
    return rank.dedup(c).select("unit_id", "place")


# -------------------------------------------------------------- joins, readers


_TOPICS = f"""{EVENTS}, t AS (SELECT *, CASE WHEN chat_id % 3 > 0 AND msg_id % 5 > 0 THEN msg_id % 5 END AS topic_id FROM notes)"""


def _in_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages; two chats in three are forums of four topics, and of messages outside of any."""
    return notes(spark, sf_dir).withColumn("topic_id", F.when((F.col("chat_id") % 3 > 0) & (F.col("msg_id") % 5 > 0), F.col("msg_id") % 5))


@query(f"""WITH {_TOPICS}, w AS (SELECT chat_id, topic_id, msg_id AS a, msg_id + 400 AS b FROM t WHERE msg_id % 9 = 0 AND chat_id % 4 > 0), p AS (SELECT chat_id, msg_id AS a FROM t WHERE msg_id % 2 = 0)
SELECT t.chat_id, t.msg_id, coalesce(max(w.a), max(CASE WHEN p.a IS NOT NULL THEN -1 - p.a END)) AS unit FROM t
LEFT JOIN w ON w.chat_id = t.chat_id AND w.topic_id IS NOT DISTINCT FROM t.topic_id AND t.msg_id BETWEEN w.a AND w.b LEFT JOIN p ON p.chat_id = t.chat_id AND p.a = t.msg_id GROUP BY ALL""")
def containing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: the last window of its topic that spans each message, else the post that it is."""
    n = _in_topics(spark, sf_dir)
    unit = lambda kind, key, end: (F.lit(kind).alias("kind"), key.alias("unit_id"), F.col("msg_id").alias("msg_id_start"), end.alias("msg_id_end"))
    w = n.where("msg_id % 9 = 0 and chat_id % 4 > 0").select("chat_id", "topic_id", *unit("window", F.col("msg_id"), F.col("msg_id") + 400))
    p = n.where("msg_id % 2 = 0").select("chat_id", "topic_id", *unit("post", -1 - F.col("msg_id"), F.col("msg_id")))
    return lexical.containing_unit(n, w.unionByName(p)).select("chat_id", "msg_id", F.col("unit_id").alias("unit"))


@query(f"""WITH {_TOPICS}, w AS (SELECT chat_id, topic_id, msg_id AS a FROM t WHERE msg_id % 9 = 0)
SELECT t.chat_id, t.topic_id, t.msg_id, max(w.a) AS before FROM t LEFT JOIN w ON w.chat_id = t.chat_id AND w.topic_id IS NOT DISTINCT FROM t.topic_id AND w.a <= t.msg_id GROUP BY ALL""")
def window_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the last window of its topic that starts at or before each message."""
    n = _in_topics(spark, sf_dir)
    w = n.where("msg_id % 9 = 0").select("chat_id", "topic_id", F.lit("window").alias("kind"), F.col("msg_id").alias("unit_id"), F.col("msg_id").alias("msg_id_start"))
    return lexical.window_before(n, w)


@query(f"""WITH {_TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, topic_id ORDER BY msg_id) AS i FROM t)
SELECT a.chat_id, a.msg_id AS anchor, b.msg_id, CAST(b.i - a.i AS INT) AS step FROM r a JOIN r b ON a.chat_id = b.chat_id AND a.topic_id IS NOT DISTINCT FROM b.topic_id AND b.i BETWEEN a.i - 2 AND a.i + 2""")
def context_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages before and after each message, in its topic."""
    n = _in_topics(spark, sf_dir)
    return readers.contexts(n, n).select("chat_id", "anchor", "msg_id", "step")


@query(f"WITH {TALKS} SELECT chat_id, msg_id FROM talks WHERE chat_id = (SELECT min(chat_id) FROM talks WHERE msg_id = 4) AND msg_id BETWEEN 3 AND 5")
def one_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply thread that the fifth turn of a conversation is in."""
    t = talks(spark, sf_dir)
    chat = t.where("msg_id = 4").agg(F.min("chat_id")).head()[0]
    return readers.thread(t, chat, 4).select("chat_id", "msg_id")


@query(f"WITH {TALKS} SELECT chat_id, msg_id FROM talks WHERE chat_id = (SELECT min(chat_id) FROM talks WHERE msg_id = 4) AND msg_id BETWEEN 2 AND 5")
def one_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns before and one after the fifth."""
    t = talks(spark, sf_dir)
    chat = t.where("msg_id = 4").agg(F.min("chat_id")).head()[0]
    return readers.context(t, chat, 4, 2, 1).select("chat_id", "msg_id")


# -------------------------------------------------------------------- storage


@query("""WITH fresh AS (SELECT c_custkey + 75 AS c_custkey, c_name || '!' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, c_nationkey + 1 AS c_nationkey FROM customer WHERE c_custkey > 60)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name,
  CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal WHEN o.c_custkey IS NULL THEN n.c_acctbal ELSE coalesce(n.c_acctbal, o.c_acctbal) END AS c_acctbal,
  CASE WHEN n.c_custkey IS NULL THEN o.c_nationkey WHEN o.c_custkey IS NULL THEN n.c_nationkey ELSE greatest(o.c_nationkey, n.c_nationkey) END AS c_nationkey
FROM customer o FULL JOIN fresh n ON n.c_custkey = o.c_custkey""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch merged into a table by three rules."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    fresh = c.where("c_custkey > 60").selectExpr("c_custkey + 75 as c_custkey", "concat(c_name, '!') as c_name", "case when c_custkey % 2 = 0 then c_acctbal end as c_acctbal", "c_nationkey + 1 as c_nationkey")
    return merge(c, fresh, ["c_custkey"], {"c_acctbal": "keep", "c_nationkey": "max"})


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return latest(o, ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 = 0")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from what is stored, nulls included."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return changed(c, c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))), ["c_custkey"])


@query(f"""WITH {EVENTS}, s AS (SELECT chat_id, min(msg_id) AS a, max(msg_id) AS b FROM notes WHERE msg_id % 4 <> 1 GROUP BY chat_id)
SELECT n.chat_id, n.msg_id FROM notes n JOIN s USING (chat_id) WHERE n.msg_id % 4 = 1 AND n.msg_id BETWEEN a AND b""")
def deleted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a second look no longer finds, within the range it covered."""
    n = notes(spark, sf_dir)
    return deleted(n, n.where("msg_id % 4 <> 1")).select("chat_id", "msg_id")


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(event_id % 6 AS INT) END AS state, event_type AS outcome FROM events)
SELECT event_id, CASE WHEN state <> 0 THEN state ELSE CASE outcome WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END END AS state FROM s""")
def media_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where attachments stand after a round of extraction; events' types stand for outcomes."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 2 == 0, PENDING).otherwise((F.col("event_id") % 6).cast("int"))
    says = {"view": "text", "click": "empty", "signup": "unsupported", "error": "error", "purchase": "skipped"}
    outcome = F.element_at(F.create_map(*[F.lit(x) for p in says.items() for x in p]), F.col("event_type"))
    return e.select("event_id", next_media_state(state, outcome).alias("state"))


# ------------------------------------------------------------------ discovery


@query("SELECT o_custkey AS chat_id, CAST(min(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END) AS INT) AS depth FROM orders GROUP BY o_custkey")
def scan_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and fetched chats at their least depth."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), (F.col("o_orderkey") % 4).alias("depth"))
    no_groups = spark.range(0).select(F.col("id"), F.col("id").alias("discussion_of"))
    return leads.scan_targets(o.where("chat_id % 3 = 0").select("chat_id").distinct(), o, no_groups)


@query("""WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 2 END AS peer, CASE WHEN c_custkey % 5 > 0 THEN 'n' || c_custkey // 4 END AS name FROM customer),
p AS (SELECT peer, min(id) AS first FROM i WHERE peer IS NOT NULL GROUP BY peer),
k AS (SELECT name, arg_min(i.peer, first) AS peer FROM i JOIN p USING (peer) WHERE name IS NOT NULL GROUP BY name),
f AS (SELECT i.id, i.name, k.peer FROM i LEFT JOIN k USING (name) WHERE i.peer IS NULL),
a AS (SELECT id, 'p' || peer AS key FROM i WHERE peer IS NOT NULL UNION ALL SELECT id, coalesce('p' || peer, 'g' || coalesce(name, CAST(id AS VARCHAR))) FROM f)
SELECT id, min(id) OVER (PARTITION BY key) AS "group" FROM a""")
def same_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates, some of a known peer, some of a name only: which are one chat. Different peers never are."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    peer = F.when(key % 3 > 0, F.floor(key / 2).cast("long"))
    name = F.when(key % 5 > 0, F.concat(F.lit("N"), F.floor(key / 4).cast("string")))
    return leads.same_chats(c.select(key.alias("id"), peer.alias("peer_id"), name.alias("username"), F.lit(None).cast("string").alias("invite")))


# ------------------------------------------------------------- chats, streaming


@query("""WITH l AS (SELECT c_custkey AS chat_id, 'src' || c_nationkey % 4 AS source_id, c_nationkey % 4 AS position FROM customer UNION ALL SELECT c_custkey, 'src9', 9 FROM customer WHERE c_custkey % 2 = 0)
SELECT chat_id, arg_min(source_id, position) AS source_id FROM l GROUP BY chat_id""")
def primary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source in order that lists a chat."""
    c = table(spark, sf_dir, "customer")
    one = c.select(F.col("c_custkey").alias("chat_id"), F.concat(F.lit("src"), (F.col("c_nationkey") % 4).cast("string")).alias("source_id"), (F.col("c_nationkey") % 4).alias("position"))
    two = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("chat_id"), F.lit("src9").alias("source_id"), F.lit(9).alias("position"))
    return ch.primary_source(one.unionByName(two))


@query("""WITH own AS (SELECT DISTINCT o_custkey AS chat_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT chat_id FROM own UNION SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT chat_id FROM own)""")
def account_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats an account reaches, and groups that belong to them."""
    access = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderpriority").alias("account"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("discussion_of"))
    return ch.reach(access, groups, "1-URGENT")


@query()
def near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names are near some words."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return ch.title_scores(parts, "steel rod").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {EVENTS}, marked AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY chat_id ORDER BY date, msg_id) > 86400 THEN 1 ELSE 0 END AS fresh FROM notes),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY date, msg_id) AS w FROM marked)
SELECT chat_id, min(date) AS date_start, max(date) AS date_end, count(*) AS n FROM numbered GROUP BY chat_id, w""")
def streamed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows kept up to date from a stream of events, read back when all has been read."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("msg_id"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("date"), F.col("event_type").alias("text"), F.lit(0).cast("long").alias("reactions"))
    folder = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    maintain(rows, folder, f"{folder}/checkpoint", order=["date"], buckets=8, gap_min=1440, max_msgs=10**6, max_chars=10**9).awaitTermination()
    found = Store(spark, folder, buckets=8).read("units").where("kind = 'window'")
    return found.select("chat_id", "date_start", "date_end", F.size("msg_ids").cast("long").alias("n"))


@query(ORACLES["window_units"])
def state_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from streaming state, over five batches by time of arrival; every 97th event arrives days late."""
    folder = f"{shared_folder(spark)}/windows-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    rows = notes(spark, sf_dir)
    delay = F.when(F.col("msg_id") % 97 == 0, 20 * 86_400 + F.col("msg_id") % 1000).otherwise(F.pmod(F.xxhash64("msg_id"), F.lit(3600)))
    rows = checkpointed(rows.withColumn("arrived", F.timestamp_seconds(F.col("date") + delay)))
    edges = rows.agg(F.percentile_approx(F.unix_seconds("arrived"), [k / 5 for k in range(1, 5)])).head()[0] or []
    batch = sum([(F.unix_seconds("arrived") > e).cast("int") for e in edges], F.lit(0))
    for k in range(5):  # a file for each batch, the first to arrive first
        rows.where(batch == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep_windows(stream, f"{folder}/out", f"{folder}/checkpoint", gap_min=720, max_msgs=5, max_chars=140, lateness_s=3600).awaitTermination()
    found = WindowLog(spark, f"{folder}/out").settled(rows, ended=True, gap_min=720, max_msgs=5, max_chars=140)
    return found.where("state <> 'late'").select("chat_id", "msg_id_start", "msg_id_end", F.size("msg_ids").cast("long").alias("n"), "date_start", "date_end", "text", "reactions")
