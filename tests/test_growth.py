"""Steps whose cost must grow no faster than their input: what is broadcast, how often a table is read, and how it is dealt to tasks."""

import os

from pyspark.sql import functions as F

from parlance import schema, storage
from parlance.operators import dense, leads, units, upkeep
from parlance.operators.index import Index
from parlance.queries import search
from parlance.queries import upkeep as kept


def _messages(spark, n=20):
    rows = spark.range(n).selectExpr("0L as chat_id", "id as msg_id", "id * 60 as date", "case when id % 3 > 0 then id - 1 end as reply_to_msg_id", "'x' as text", "1L as reactions")
    return schema.conform(rows, schema.MESSAGES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_threads_broadcast_no_messages(spark, tmp_path):
    """Of a few columns of a wide stored table Spark guesses a small size, and would send all its rows through the driver."""
    _messages(spark).write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    cut = units.threads(units.render(stored))
    assert "BroadcastExchange" not in _plan(cut)
    assert sorted(r.msg_ids for r in cut.collect()) == [[i, i + 1, i + 2][: 20 - i] for i in range(0, 20, 3)]


def test_a_large_row_group_is_spread(spark, tmp_path, monkeypatch):
    """A file of one row group is many tasks' work, and a guessed size behind a join doesn't make thousands of them."""
    spark.range(50_000).selectExpr("id", "uuid() as t").coalesce(1).write.parquet(f"{tmp_path}/f")
    rows = spark.read.parquet(f"{tmp_path}/f")
    monkeypatch.setattr(storage, "TASK_BYTES", 1 << 17)
    assert 8 < storage.spread(rows).rdd.getNumPartitions() <= 64
    asked = storage.checkpointed(rows.crossJoin(spark.range(10).toDF("k")).select("id"))
    assert storage.spread(rows.join(asked, "id")).rdd.getNumPartitions() <= 4 * storage.TASKS


def test_links_are_parsed_where_their_text_lies(spark, tmp_path):
    """The texts' rows are read once, and no text is moved for each of its links."""
    _messages(spark).write.parquet(f"{tmp_path}/m")
    chats = schema.conform(spark.range(1).selectExpr("id", "id as peer_id", "'channel' as type"), schema.CHATS)
    m = spark.read.parquet(f"{tmp_path}/m")
    assert _plan(leads.message_leads(m, chats)).count(f"{tmp_path}/m") <= 1


def test_texts_are_embedded_once_after_they_are_spread(spark, tmp_path):
    """A filter on the vectors must not embed every text before the shuffle too, in the tasks of the file."""
    rows = spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(["one two", "", None, "three"])], "unit_id long, chat_id long, date_start long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/u")
    have = spark.createDataFrame([], "unit_id long, chat_id long, date_start long, embedding array<float>")
    made = dense.embed_dirty(spark.read.parquet(f"{tmp_path}/u"), have)
    assert _plan(made).count("ArrowEvalPython") == 1
    assert sorted(r.unit_id for r in made.collect()) == [0, 3]


def test_matching_messages_writes_no_units_and_no_vectors(spark, tmp_path):
    """Its index of messages is all it asks for."""
    spark.createDataFrame([(2, 0, "user", "the one"), (2, 1, "user", "other"), (3, 0, "user", "the")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in search.matching_messages(spark, str(tmp_path)).collect()] == [(2, 0)]
    assert not Index(spark, f"{search._folder(spark, str(tmp_path), 'corpus')}/index/units").segments()


def test_kept_units_broadcast_no_table_that_grows(spark, tmp_path):
    """Ids of units and of messages are few bytes of wide stored tables, and as many as the units and the messages."""
    _messages(spark).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    upkeep.with_ids(units.windows(units.render(m), max_msgs=3)).write.parquet(f"{tmp_path}/u")
    u = spark.read.parquet(f"{tmp_path}/u")
    steps = [upkeep.applied(u, u.where("msg_id_start = 0"), u.where("msg_id_start = 3")), upkeep.units_with_reactions(u, m, m.where("msg_id = 4")), upkeep.windowed(m, u), upkeep.threads_touching(u, m)]
    chats = schema.conform(spark.range(1).selectExpr("id"), schema.CHATS)
    steps += upkeep.invalidate(m, u, m.where("msg_id = 4"), chats, max_msgs=3)
    assert not [s for s in steps if "BroadcastExchange" in _plan(s)]
    assert steps[0].count() == 7 and steps[2].count() == 20


def test_kept_units_are_written_once_and_compressed(spark, tmp_path):
    """Units of a change lie in the shared folder as a compressed table, and the messages of the query not at all."""
    rows = spark.range(3000).selectExpr("id as event_id", "id % 30 as user_id", "timestamp_seconds(1704067200 + id * 600) as ts", "'view' as event_type", "1.0d as value", "'' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    shared = storage.shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared) for f in files)
    before = size()
    assert kept.invalidated_windows(spark, str(tmp_path)).count() > 500
    assert size() - before < 100_000, size() - before


def test_postings_are_written_where_they_are_made(spark, tmp_path):
    """Postings take some times the disk of the text: no task reads those that another made, and none lie there twice."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j} the" for j in range(40)) if i % 9 else None) for i in range(60)], "doc long, text string")
    index = Index(spark, f"{tmp_path}/i")
    index.add(docs)
    rows = index.postings().withColumn("task", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1))
    assert {r.n for r in rows.groupBy("doc").agg(F.countDistinct("task").alias("n")).collect()} == {1}
    assert rows.select("task").distinct().count() > 1 and rows.where("term is null").isEmpty()
    assert rows.where("term = 'the'").count() == 53 and index.docs().count() == 60 and index.docs().where("size = 0").count() == 7
    folders = sorted(os.listdir(f"{tmp_path}/i"))
    assert folders == ["docs", "gone", "postings", "stats"] and f"bucket={-1}" not in os.listdir(f"{tmp_path}/i/postings/1")
