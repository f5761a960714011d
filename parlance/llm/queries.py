"""The queries of the training-data operators: each runs its operator over a whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.chat import format_examples, loss_text, parse_turns
from parlance.llm.chunkdedup import repeated_passages
from parlance.llm.common import documents, shared_dir
from parlance.llm.decontam import contaminated
from parlance.llm.divergence import source_divergence
from parlance.llm.katz import katz_scores
from parlance.llm.langid import fold, identify
from parlance.llm.merkle import audit, leaf
from parlance.llm.packing import assign, tokenised
from parlance.llm.quality import assess
from parlance.llm.rabitq import nearest
from parlance.llm.sharding import shard_documents
from parlance.llm.simhash import simhash_components
from parlance.llm.warc import read_archives, write_archives


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    found = shard_documents(documents(spark, sf_dir), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut to pieces of 4096 tokens at most and packed."""
    pieces = tokenised(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    packed = assign(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_rabitq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: A text that holds the template's control strings.
_HARD_TALK = r"\### Assistant: </turn> ok"


def op5_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted as examples and read back from them."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_HARD_TALK).alias("text"))
    examples = format_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(hard))
    turns = F.when(F.col("last"), parse_turns(F.col("text")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = examples.select("conv_id", "example", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("text").cast("long").alias("chars"), F.col("loss_start").isNotNull().alias("trained"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), "last")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    each = back.groupBy("conv_id").agg(F.max(F.when(F.col("last"), F.col("n_turns"))).alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), told.alias("loss"), F.sum("chars").alias("formatted_chars"), F.sum(F.col("trained").cast("long")).alias("examples"))
    return each.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "examples")


_OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(role) + length(text)
      + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS examples
FROM summed GROUP BY conv_id
"""


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder)


_OP6_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
    row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS i,
    max(page_id) OVER (PARTITION BY hex) AS top
  FROM hashed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN i > 1 THEN top END AS refers_to
FROM named
"""


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of the documents, and who keeps it."""
    return repeated_passages(documents(spark, sf_dir))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it was held out."""
    return identify(documents(spark, sf_dir))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, under what the documents that are not held out teach."""
    docs = documents(spark, sf_dir)
    held = fold(docs["doc_id"], 7) == 2
    found = katz_scores(docs.select("doc_id", "text", (~held).alias("train")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, each held against it; of those whose doc_id's checksum 7 divides, n_chars is tampered with."""
    docs = documents(spark, sf_dir)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    longer = leaf(*[docs[c].cast("decimal(20,0)") + 1 if c == "n_chars" else docs[c] for c in columns])
    tampered = F.when((F.crc32(docs["doc_id"].cast("string")) % 7 == 0) & docs["n_chars"].isNotNull(), longer)
    return audit(docs, columns, altered=tampered).withColumnRenamed("key", "doc_id")


_LEAF_SQL = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
_OP11_SQL = f"""
WITH RECURSIVE crcs AS (  -- the unsigned crc32 of the decimal doc_id, bit by bit
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(substr(s, i, 1)) AS BIGINT)), CAST(range(8) AS BIGINT[])),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END)
  FROM crcs WHERE i <= length(s)
), sums AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM crcs WHERE i = length(s) + 1
), leaves AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF_SQL.replace("{n_chars}", "n_chars")}) AS leaf,
    CASE WHEN s.crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF_SQL.replace("{n_chars}", "(n_chars + 1)")}) END AS altered
  FROM (SELECT doc_id, source, lang, n_chars, text FROM documents) d LEFT JOIN sums s USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), levels AS (
  SELECT 0 AS level, tree, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM levels WHERE n > 1 GROUP BY level, tree, place // 2, n
), subroots AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS tree_place FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree_place AS place, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, place // 2, n
), nodes AS (
  SELECT tree, level, place, h FROM levels UNION ALL
  SELECT s.tree, s.height + t.level, t.place, t.h FROM subroots s, tops t
), folds AS (
  SELECT p.doc_id, p.leaf, p.tree, s.subroot, s.height, s.tree_place, 0 AS level, p.place, coalesce(p.altered, p.leaf) AS h, '' AS proof,
    s.height + (SELECT max(level) FROM tops) AS most, p.place AS own
  FROM placed p JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.subroot, f.height, f.tree_place, f.level + 1,
    CASE WHEN f.level + 1 = f.height THEN f.tree_place ELSE f.place // 2 END,
    sha256(CASE WHEN f.place % 2 = 0 THEN f.h || coalesce(x.h, '') ELSE coalesce(x.h, '') || f.h END),
    f.proof || coalesce(x.h, ''), f.most, f.own
  FROM (SELECT * REPLACE (CASE WHEN level = 0 AND height = 0 THEN tree_place ELSE place END AS place) FROM folds WHERE level < most) f
  LEFT JOIN (SELECT tree, level, place, h FROM levels WHERE n > 1 UNION ALL
             SELECT s.tree, s.height + t.level, t.place, t.h FROM subroots s, tops t WHERE t.n > 1) x
    ON x.tree = f.tree AND x.level = f.level AND x.place = xor(CAST(f.place AS BIGINT), CAST(1 AS BIGINT))
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folds f, (SELECT h FROM tops WHERE n = 1) r WHERE f.level = f.most
"""


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, and whether it was held out."""
    return assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of each language differs from its others, and in which terms from the language."""
    return source_divergence(documents(spark, sf_dir))


_OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), sums AS (
  SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source
), groups AS (
  SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sums s USING (lang, source) LEFT JOIN langs l USING (lang)
), prices AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + CAST((CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS BIGINT) AS p,
    1 + CAST((CAST(1000000000 AS HUGEINT) * (k.total + 5)) // (l.n + 5 * l.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), told AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)
  FROM prices WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM told WHERE part = 'pair' OR rank <= 50
"""


QUERIES = {f.__name__: f for f in (op1_kd_tree_sharding, op2_simhash_decontamination, op3_pattern_packing, op4_rabitq_search, op5_prefix_target_chat, op6_warc_zstd, op7_gear_chunks, op8_ppm_language, op9_katz_backoff, op10_simhash_bktree, op11_merkle_manifest, op12_attention_quality, op13_source_divergence)}
ORACLES: dict[str, str] = {"op5_prefix_target_chat": _OP5_SQL, "op6_warc_zstd": _OP6_SQL, "op11_merkle_manifest": _OP11_SQL, "op13_source_divergence": _OP13_SQL}
