import time

import pytest
from pyspark.sql import functions as F

from parlance import schema
from parlance.budget import Budget, Deadline
from parlance.operators import units
from parlance.operators.vectors import VectorLog
from parlance.streaming.changes import Changes
from parlance.streaming.maintenance import Store

LIMITS = {"gap_min": 10, "max_msgs": 4, "max_chars": 400}


@pytest.fixture
def talk(spark):
    rows = [(c, i, 1_700_000_000 + i * (700 if i % 5 == 0 else 60), f"text {c} {i}", i - 1 if i % 3 else None) for c in range(6) for i in range(1, 13)]
    messages = schema.conform(spark.createDataFrame(rows, "chat_id long, msg_id long, date long, text string, reply_to_msg_id long"), schema.MESSAGES)
    chats = schema.conform(spark.createDataFrame([(c, False, c == 5) for c in range(6)], "id long, is_forum boolean, is_broadcast boolean"), schema.CHATS)
    return messages, chats


def content(df):
    return sorted((r.chat_id, r.kind, tuple(r.msg_ids), r.text) for r in df.collect())


class Killed(RuntimeError):
    pass


def stops(store, after):
    """The store, killed after so many of its writes (a commit is one)."""
    left = [after]
    for name in ("write", "commit"):
        plain = getattr(store, name)

        def counted(*args, plain=plain):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            return plain(*args)

        setattr(store, name, counted)
    return store


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_a_restart_finishes_what_was_written_down(spark, talk, tmp_path, after):
    """Killed after the intent, the messages, the units, or not at all: the next run leaves the same."""
    messages, chats = talk
    folder = str(tmp_path)
    first = Changes(Store(spark, folder, buckets=2), chats, **LIMITS)
    first.declare(put=messages)
    assert first.replay() == [0] and first.pending() == []
    now = messages.where("msg_id <> 4").withColumn("text", F.when(F.col("msg_id") == 2, "edited").otherwise(F.col("text")))
    new = schema.conform(spark.createDataFrame([(1, 99, 1_700_009_000, "new")], "chat_id long, msg_id long, date long, text string"), schema.MESSAGES)
    killed = Changes(stops(Store(spark, folder, buckets=2), after), chats, **LIMITS)
    killed.declare(put=now.where("msg_id = 2").unionByName(new), drop=messages.where("msg_id = 4"))
    if after < 3:
        with pytest.raises(Killed):
            killed.replay()
        assert killed.pending() == [1]
    else:
        killed.replay()
    again = Changes(Store(spark, folder, buckets=2), chats, **LIMITS)
    assert again.replay() == ([1] if after < 3 else []) and again.pending() == []
    assert content(again.store.read("units")) == content(units.build_units(now.unionByName(new), chats, **LIMITS))
    assert again.store.read("messages").count() == 6 * 11 + 1
    again.tidy()
    assert again.pending() == []


def test_chats_are_cut_again_by_a_new_recipe(spark, talk, tmp_path):
    """A slice at a time, the first one whatever the budget, until all carry the recipe."""
    messages, chats = talk
    old = Changes(Store(spark, str(tmp_path), buckets=2), chats, **LIMITS)
    old.declare(put=messages)
    old.replay()
    wide = {"gap_min": 60, "max_msgs": 30, "max_chars": 4000}
    fresh = Changes(Store(spark, str(tmp_path), buckets=2), chats, **wide)
    assert fresh.recut_pending("2", Budget(0), size=2) == 2 and fresh.marked("2").count() == 2
    cancelled = Budget(100)
    cancelled.cancel()
    assert fresh.recut_pending("2", cancelled, size=2) == 0
    assert fresh.recut_pending("2", limit=3, size=2) == 3 and fresh.recut_pending("2", size=2) == 1 and fresh.recut_pending("2") == 0
    assert content(fresh.store.read("units")) == content(units.build_units(messages, chats, **wide))
    fresh.tidy()
    assert fresh.marked("2").count() == 6


def test_vectors_in_slices(spark, tmp_path):
    rows = [(k * 7 % 50, 1, 100 + k, f"words {k}" if k % 9 else "") for k in range(50)]
    some = spark.createDataFrame(rows, "unit_id long, chat_id long, date_start long, text string")
    log, looks = VectorLog(spark, str(tmp_path)), iter([0, 0, 0, 5])
    assert log.embed(some, size=8, budget=Budget(1, lambda: next(looks, 5))) == 16
    assert sorted(r.unit_id for r in log.rows().collect()) == list(range(16))
    assert log.embed(some, size=8) == 34 and log.embed(some, size=8) == 0
    assert sorted(r.unit_id for r in log.rows().collect()) == list(range(50))
    assert log.vectors(some.where("unit_id < 20")).count() == sum(1 for k in range(50) if k * 7 % 50 < 20 and k % 9)
    with pytest.raises(KeyError):
        log.embed(some, "no such")
    with pytest.raises(ValueError):
        log.embed(some, size=0)


def test_budgets():
    now = [0.0]
    budget = Budget(10, lambda: now[0])
    assert list(budget.over(range(3))) == [0, 1, 2] and budget.left == 10
    now[0] = 11
    assert list(budget.over(range(3))) == [] and list(budget.over(range(3), at_least=1)) == [0]
    budget.cancel()
    assert list(budget.over(range(3), at_least=1)) == []
    assert not Budget(None).expired


def test_a_stream_ends_at_its_deadline(spark, tmp_path):
    """Between batches; the next run reads the rest, and no row twice."""
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    budget = Budget(None)
    deadline = Deadline(budget)
    spark.streams.addListener(deadline)

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return deadline.watch(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start(str(tmp_path / "out")))

    try:
        first = start()
        while not first.recentProgress:
            time.sleep(0.05)
        budget.cancel()
        assert first.awaitTermination(60)
        deadline.budget = Budget(None)
        second = start()
        second.processAllAvailable()
        deadline.budget = budget
        assert second.awaitTermination(60)
    finally:
        spark.streams.removeListener(deadline)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))


def test_slices_without_a_budget_go_in_rounds_that_double(spark, tmp_path):
    """40 slices are 6 writes, not 40; rows tell their slices as before, and a later run goes on above them."""
    some = spark.range(158).selectExpr("id as unit_id", "1L as chat_id", "id as date_start", "concat('words ', id) as text")
    log = VectorLog(spark, str(tmp_path))
    assert log.embed(some, size=4) == 158
    assert [(r.unit_id, r.slice) for r in log.rows().orderBy("unit_id").collect()] == [(k, k // 4) for k in range(158)]
    assert len([p for p in (tmp_path / "slices").iterdir() if p.is_dir()]) == 6
    more = some.selectExpr("unit_id + 100 as unit_id", "chat_id", "date_start", "text")
    assert log.embed(more, size=4, budget=Budget(None)) == 100
    assert {r.slice for r in log.rows().where("unit_id >= 158").collect()} == set(range(40, 65))
