import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import units
from parlance.storage import finished
from parlance.streaming.windows import WindowLog, cut, keep_windows, open_windows

LINES = "chat_id long, topic_id long, date long, msg_id long, line string, reactions long, arrived timestamp"
LIMITS = {"gap_min": 10, "max_msgs": 4, "max_chars": 60}


def spans(df):
    return sorted((r.chat_id, r.topic_id or 0, tuple(r.msg_ids), r.text, r.reactions) for r in df.collect())


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches of (chat, topic, date, msg_id, arrival) rows and runs the stream over what is new."""

    def push(*batches):
        for rows in batches:
            full = [(c, t, d, i, f"{'x' * (i % 17)}{i}", i % 3, a) for c, t, d, i, a in rows]
            df = spark.createDataFrame(full, LINES.replace("timestamp", "long")).withColumn("arrived", F.timestamp_seconds("arrived"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        keep_windows(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lateness_s=60, slack="0 seconds", **LIMITS).awaitTermination()
        return WindowLog(spark, str(tmp_path / "out")), spark.read.schema(LINES).parquet(str(tmp_path / "in"))

    return push


def test_cut_as_in_batches(spark):
    rng = random.Random(3)
    rows, date = [], 0
    for i in range(300):
        date += rng.choice([1, 30, 599, 600, 601, 2000])
        rows.append((date, i, "y" * rng.randrange(50), 1))
    df = spark.createDataFrame([(1, None, d, i, t, r) for d, i, t, r in rows], "chat_id long, topic_id long, date long, msg_id long, line string, reactions long")
    assert sorted(tuple(r.msg_ids) for r in units.windows(df, **LIMITS).collect()) == sorted(tuple(m[1] for m in w) for w in cut(rows, 600, 4, 60))


def test_windows_over_batches(feed):
    """Closed once and never again, by the next window or by the timer; what came too late is told apart, then cut in."""
    t = 1_700_000_000
    log, stored = feed([(1, None, t, 1, t + 1), (1, None, t + 30, 2, t + 31), (2, 7, t, 1, t + 2)])
    assert spans(log.state("closed")) == [] and len(spans(log.state("open"))) == 2
    # a message within the lateness finds its place, one of another chat moves the clock past the gap of chat 2
    log, stored = feed([(1, None, t + 10, 3, t + 40), (3, None, t + 5000, 1, t + 5000)], [(3, None, t + 5010, 2, t + 5011)])
    closed = spans(log.state("closed"))
    assert [(c, k, i) for c, k, i, _, _ in closed] == [(1, 0, (1, 3, 2)), (2, 7, (1,))]
    # a message days too late for a closed window, and one that begins a stretch of its own
    log, stored = feed([(1, None, t + 20, 4, t + 5020), (2, 7, t - 9000, 9, t + 5021), (3, None, t + 5020, 3, t + 5025)])
    assert sorted((r.chat_id, r.msg_ids[0]) for r in log.state("late").collect()) == [(1, 4), (2, 9)]
    assert spans(log.state("closed")) == closed
    batch = spans(units.windows(stored, **LIMITS))
    assert spans(log.settled(stored, ended=True, **LIMITS).where("state <> 'late'")) == batch
    log.compact(stored, **LIMITS)
    assert spans(log.settled(stored, **LIMITS).where("state <> 'late'")) == batch and log.state("late").count() == 0
    log, stored = feed([(3, None, t + 5030, 4, t + 5040), (1, None, t + 5030, 5, t + 5041)])
    assert spans(log.settled(stored, ended=True, **LIMITS).where("state <> 'late'")) == spans(units.windows(stored, **LIMITS))


def test_random_feeds(spark, feed, tmp_path):
    """Six batches in two runs, with messages late by seconds and by hours, and some that come twice; the stretches that still grow wait."""
    rng, rows, t = random.Random(6), [], 1_700_000_000
    for c in range(4):
        date = t
        for i in range(60):
            date += rng.choice([5, 40, 300, 900])
            rows.append((c, None if c % 2 else 1 + i % 2, date, i, date + rng.choice([0, 10, 55]) + (7200 if i % 11 == 5 else 0)))
    rows.sort(key=lambda r: r[4])
    parts = [rows[k * 40 : k * 40 + 40] for k in range(6)]
    for a, b in zip(parts, parts[1:]):  # arrivals of one second stay in one batch
        while b and a and b[0][4] <= a[-1][4]:
            a.append(b.pop(0))
    feed(*parts[:3])
    log, stored = feed(*parts[3:])
    assert len(finished(spark, str(tmp_path / "out" / "batches"))) >= 6
    want = spans(units.windows(stored, **LIMITS))
    assert spans(log.settled(stored, ended=True, **LIMITS).where("state <> 'late'")) == want
    waiting = log.settled(stored, **LIMITS)
    assert {r[:3] for r in spans(waiting.where("state = 'closed'"))} <= {r[:3] for r in want} | {r[:3] for r in spans(log.state("closed"))}
    log.compact(stored, **LIMITS)
    assert spans(log.settled(stored, ended=True, **LIMITS).where("state <> 'late'")) == want


def test_an_empty_log(spark, tmp_path):
    log = WindowLog(spark, str(tmp_path))
    assert log.state("closed").count() == log.state("open").count() == 0
    log.compact(spark.createDataFrame([], LINES), **LIMITS)


class Kept:
    """A key's state as Spark hands it over."""

    def __init__(self, watermark_s, value=None, hasTimedOut=False):
        self.get, self.exists, self.hasTimedOut, self.watermark_s, self.timeout = value, value is not None, hasTimedOut, watermark_s, None

    def getCurrentWatermarkMs(self):
        return self.watermark_s * 1000

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_state_goes_with_the_rows_of_its_key():
    """What is held comes and goes as one value, large ids stay whole beside nulls, and a timer closes what is left."""
    tell, i = open_windows(600, 4, 60, 60), (1 << 60) + 1
    rows = pd.DataFrame({"date": [1000, 1010], "msg_id": [i, i + 2], "line": ["a", None], "reactions": [None, 2.0]})
    first = Kept(0)
    [told] = tell((5, -1), iter([rows]), first)
    assert told[["topic_id", "msg_id_start", "msg_id_end", "msg_ids", "text", "reactions", "state"]].values.tolist() == [[None, i, i + 2, [i, i + 2], "a", 2, "open"]]
    assert first.timeout == (1010 + 600 + 60 + 1) * 1000
    later = Kept(1671, first.get, True)
    [told] = tell((5, -1), iter([]), later)
    assert told[["msg_ids", "state"]].values.tolist() == [[[i, i + 2], "closed"], [[], "open"]]
    assert later.get[:3] == (1611, -(1 << 63), []) and later.timeout is None
    [told] = tell((5, -1), iter([rows[:1]]), Kept(1671, later.get))
    assert told[["msg_ids", "state"]].values.tolist() == [[[i], "late"], [[], "open"]]
