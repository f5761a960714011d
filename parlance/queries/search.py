"""Queries of the stored index and of searches. Indexes are written once for a folder of tables, in the shared folder."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema
from parlance.operators import dense, units, upkeep
from parlance.operators.index import Index
from parlance.operators.lexical import and_then_or
from parlance.plans.search import build_indexes, message_index, search
from parlance.queries.base import query, table, talks
from parlance.sinks import results
from parlance.storage import checkpointed, shared_folder, spread


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark)}/parlance-{spark.sparkContext.applicationId}/{name}-{zlib.crc32(sf_dir.encode())}"


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all documents; written by whoever asks first."""
    index = Index(spark, _folder(spark, sf_dir, "documents"))
    if not index.segments():
        index.add(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), number=1)
    return index


_TERMS = r"""terms AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents)"""


@query(rf"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings of the stored index, as they are read back: how often each document's text holds each term."""
    return document_index(spark, sf_dir).postings().where(F.size("raw") > 0).select("term", F.col("doc").alias("doc_id"), F.size("raw").cast("long").alias("tf"))


# fixed values: every form that the given tables have of the stems of two words
_FORMS = {
    "ha": ("ha", "haed", "haedly", "haing", "haingly"),
    "ing": ("ing", "inged", "ingedly", "inges", "inging", "ingingly", "ingly", "inglyed", "inglying"),
}
_COLUMNS = " UNION ALL ".join(f"SELECT doc_id, '{stem}' AS stem, term, '{stem}' = term AS raw FROM terms WHERE term IN ({', '.join(repr(f) for f in forms)})" for stem, forms in _FORMS.items())


_SCORED = rf"""{_TERMS}, held AS ({_COLUMNS}), sizes AS (SELECT d.doc_id, 2 * count(t.term) AS size FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY d.doc_id), whole AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
f AS (SELECT doc_id, stem, sum(CASE WHEN raw THEN 2.0 ELSE 0.0 END) + count(*) AS f FROM held GROUP BY ALL), df AS (SELECT stem, count(*) AS df FROM f GROUP BY stem),
s AS (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score, CAST(count(*) AS INT) AS hits FROM f JOIN df USING (stem) JOIN sizes USING (doc_id), whole GROUP BY doc_id)"""


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score, hits FROM s")
def two_column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of all documents over the plain and the stemmed column, for two words, from the stored index."""
    found = document_index(spark, sf_dir).scores("haing inging")
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "hits")


@query(f"""WITH {_SCORED}, r AS (SELECT *, CASE WHEN hits = 2 THEN 0 ELSE 1 END AS tier FROM s)
SELECT doc_id, tier, CAST(row_number() OVER (ORDER BY tier, round(score, 12) DESC, doc_id) AS INT) AS place, round(score, 6) AS score FROM r QUALIFY place <= 20""")
def two_column_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 documents over both columns: those with both words first."""
    found = document_index(spark, sf_dir).search("haing inging", 20)
    return found.select(F.col("doc").alias("doc_id"), "tier", "place", F.round("score", 6).alias("score"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), 1) AS i FROM documents)
SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.term = 'the' AND b.term = 'of'""")
def phrase_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold two words next to one another."""
    return document_index(spark, sf_dir).scores("the_of").select(F.col("doc").alias("doc_id"))


@query("SELECT doc_id, 'missing' AS what FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'stale' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 > 0")
def stored_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored index lacks, and what it has that is no more."""
    index = Index(spark, _folder(spark, sf_dir, "gaps"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    if not index.segments():
        index.add(docs.where("doc % 7 > 0"), number=1)
    missing, stale = index.gaps(docs.where("doc % 5 > 0 or doc % 7 = 0"))
    return missing.select(F.col("doc").alias("doc_id"), F.lit("missing").alias("what")).unionByName(stale.select(F.col("doc").alias("doc_id"), F.lit("stale").alias("what")))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed words ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 8 > 0),
t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS docs FROM t GROUP BY term""")
def repaired_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term is, after some were replaced, some removed, gaps repaired and segments made one."""
    index = Index(spark, _folder(spark, sf_dir, "repaired"))
    if not index.segments():
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
        now = docs.withColumn("text", F.when(F.col("doc") % 3 == 0, F.concat(F.lit("changed words "), F.col("doc").cast("string"))).otherwise(F.col("text")))
        index.add(docs.where("doc % 2 = 0"), number=1)
        index.add(now.where("doc % 3 = 0"), docs.where("doc % 8 = 0").where("doc % 3 > 0").select("doc"), number=2)
        index.repair(now.where("doc % 8 > 0"))
        index.compact()
    return index.postings().where(F.size("raw") > 0).groupBy("term").agg(F.countDistinct("doc").alias("docs"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages."""
    return schema.conform(talks(spark, sf_dir), schema.MESSAGES)


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, units, vectors) of conversations, written once."""
    folder = _folder(spark, sf_dir, "corpus")
    m = _messages(spark, sf_dir)
    if not Index(spark, f"{folder}/index/units").segments():
        lines = units.render(spread(m))
        u = upkeep.with_ids(units.windows(lines).unionByName(units.threads(lines)))
        u.write.mode("overwrite").parquet(f"{folder}/units")
        u = spark.read.parquet(f"{folder}/units")
        spread(u.select("unit_id", "chat_id", "date_start", "text")).select("unit_id", "chat_id", "date_start", dense.embed(F.col("text")).alias("embedding")).where(dense.usable(F.col("embedding"))).write.mode("overwrite").parquet(f"{folder}/vectors")
        build_indexes(u, m, f"{folder}/index")
    return m, spark.read.parquet(f"{folder}/units"), spark.read.parquet(f"{folder}/vectors")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over conversations: windows and threads, lexical and dense lists."""
    m, u, v = _corpus(spark, sf_dir)
    found, _ = search(u, m, v, "thonen inging thand", indexes=build_indexes(u, m, f"{_folder(spark, sf_dir, 'corpus')}/index"))
    return found.select("unit_id", "chat_id", "kind", "msg_ids", "place", "anchor", F.round("score", 6).alias("score"))


@query(r"""WITH t AS (SELECT conv_id AS chat_id, turn AS msg_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT DISTINCT chat_id, msg_id FROM t WHERE term IN ('the', 'und', 'la') AND chat_id % 2 = 0""")
def matching_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every second chat that hold any of three words, by the messages' index."""
    m = _messages(spark, sf_dir)
    index = message_index(m, f"{_folder(spark, sf_dir, 'corpus')}/index")  # all it asks: no units, no vectors
    allowed = m.where("chat_id % 2 = 0").select(F.xxhash64("chat_id", "msg_id").alias("doc"))
    held = index.postings(["the", "und", "la"]).where(F.size("raw") > 0).select("doc").distinct().join(allowed, "doc", "left_semi")
    return m.withColumn("doc", F.xxhash64("chat_id", "msg_id")).join(held, "doc", "left_semi").select("chat_id", "msg_id")


@query("""SELECT conv_id AS chat_id, turn AS msg_id, CAST(turn - min(turn) OVER (PARTITION BY conv_id, turn // 5) AS INT) AS pos FROM conversations""")
def listed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every window in the order of its text."""
    m, u, _ = _corpus(spark, sf_dir)
    five = m.groupBy("chat_id", F.floor(F.col("msg_id") / 5).alias("part")).agg(F.array_sort(F.collect_list("msg_id")).alias("msg_ids")).withColumn("unit_id", F.xxhash64("chat_id", "part"))
    return results.unit_messages(five, m).select("chat_id", "msg_id", "pos")


@query()
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a search as documents: snippets around the best message, links, spans."""
    m, u, v = _corpus(spark, sf_dir)
    found, _ = search(u, m, v, "thonen inging thand", indexes=build_indexes(u, m, f"{_folder(spark, sf_dir, 'corpus')}/index"))
    chats = m.select(F.col("chat_id").alias("id"), F.concat(F.lit("Room "), F.col("chat_id").cast("string")).alias("title"), F.lit("supergroup").alias("type"), (-(F.col("chat_id") + schema.CHANNEL_MARK)).alias("peer_id"), F.lit(None).cast("string").alias("username"), F.lit(False).alias("is_forum")).distinct()
    hits = checkpointed(results.with_links(found, chats))
    rows = [(h["place"], h["chat_id"], h["title"], h["url"], h["snippet"]) for h in results.hit_documents(hits, "thonen inging thand", m)]
    return spark.createDataFrame(rows, "place int, chat_id long, title string, url string, snippet string")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT doc_id, CAST(count(DISTINCT term) AS INT) AS hits, CASE WHEN count(DISTINCT term) = 3 THEN 0 ELSE 1 END AS tier FROM t WHERE term IN ('12', '2024', '7') GROUP BY doc_id""")
def number_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all of three numbers, then those that hold any: numbers are their own stems."""
    index = document_index(spark, sf_dir)
    found = checkpointed(index.scores("12 2024 7"))
    ranked = and_then_or(found, 3, found.count() or 1, "doc")
    return ranked.join(found.select("doc", "hits"), "doc").select(F.col("doc").alias("doc_id"), "hits", "tier")
