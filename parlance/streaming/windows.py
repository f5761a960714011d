"""Windows as streaming state: the open window of each chat and topic, closed after its gap and then appended once.

The state of a key is what no closed window has yet, so at most what may still change: the open window, and messages so
fresh that others may still come before them. Arrival is what Spark's watermark follows, not the message's own date: a
message is expected within ``lateness_s`` seconds of its date, and one that comes into a window that is closed
already is not lost but routed out as ``late``. A timer closes a window once no message within its gap can arrive.

A batch leaves a folder of its own, which a repeated batch writes over: closed windows, late messages, and the open
windows of the keys that it touched, which stand for all earlier ones of these keys. Nothing that is there is read or
written again, until ``compact`` puts closed windows together and cuts again what late messages fell into. As a gap
ends a window whatever came before, that is the stretch between two gaps; one that has not ended yet waits.

Defined results: a message that comes again while its window is open counts once, as it came last; after that it is
late, and as it is stored then is how it is cut. A topic that is null is one of its own. An empty stream leaves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance import schema
from parlance.operators import units as un
from parlance.storage import checkpointed, finished

STATES = f"{schema.UNITS}, state string"
_TOLD = [f.split()[0] for f in STATES.split(", ")]
#: The place that all is closed before, and what is held: a column for each part of a message.
_HELD = "done_date long, done_id long, date array<long>, msg_id array<long>, line array<string>, reactions array<long>"
_KEY = ["chat_id", "topic_id"]
_BACKEND = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(rows: list[tuple], gap_s: int, max_msgs: int, max_chars: int) -> list[list[tuple]]:
    """Sorted (date, msg_id, line, reactions) rows as windows, by the rules of ``units.windows``."""
    out: list[list[tuple]] = []
    chars = 0
    for row in rows:
        size = len(row[2] or "")
        if not out or row[0] - out[-1][-1][0] > gap_s or len(out[-1]) >= max_msgs or chars + 1 + size > max_chars:
            out.append([])
            chars = -1
        out[-1].append(row)
        chars += 1 + size
    return out


def open_windows(gap_s: int, max_msgs: int, max_chars: int, lateness_s: int):
    """A function that keeps what is open of a key; it tells windows that close, messages that come too late, and what is open now.

    A key's state comes with its rows and goes back with what it tells, so that no call is made for one key alone.
    """

    def tell(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done_date, done_id, *columns = state.get if state.exists else (None, None, [], [], [], [])
        held = {r[1]: r for r in zip(*columns, strict=True)}
        done = None if done_date is None else (done_date, done_id)
        late = {}
        for part in () if state.hasTimedOut else parts:
            for date, i, line, reactions in zip(part["date"].tolist(), part["msg_id"].tolist(), part["line"].tolist(), part["reactions"].tolist(), strict=True):
                row = (int(date), int(i), line if isinstance(line, str) else None, 0 if pd.isna(reactions) else int(reactions))
                (late if done and row[:2] < done else held)[row[1]] = row
        sure = state.getCurrentWatermarkMs() // 1000 - lateness_s  # what comes from now on has a later date
        windows = cut(sorted(held.values(), key=lambda r: r[:2]), gap_s, max_msgs, max_chars)
        closed = 0
        while closed < len(windows) and (windows[closed + 1][0][0] <= sure if closed + 1 < len(windows) else windows[closed][-1][0] + gap_s < sure):
            closed += 1
        rest = windows[closed:]
        if closed:
            # what comes before this place from now on could have belonged to a window that is closed
            done = rest[0][0][:2] if rest else (windows[-1][-1][0] + gap_s + 1, -(1 << 63))
        still = [r for w in rest for r in w]
        state.update((*(done or (None, None)), *([list(c) for c in zip(*still, strict=True)] or [[], [], [], []])))
        if rest:
            state.setTimeoutTimestamp((rest[-1][-1][0] + gap_s + lateness_s + 1) * 1000)
        told = [("closed", w) for w in windows[:closed]] + [("late", [r]) for r in sorted(late.values(), key=lambda r: r[:2])] + [("open", w) for w in rest or [[]]]
        chat, topic = int(key[0]), int(key[1])
        rows = [_unit(chat, None if topic < 0 else topic, w, name) for name, w in told]
        yield pd.DataFrame(rows, columns=_TOLD, dtype=object)  # as objects, numbers beside nulls stay whole

    return tell


def _unit(chat: int, topic: int | None, rows: list[tuple], state: str) -> tuple:
    if not rows:  # nothing is open any more
        return chat, topic, "window", None, None, [], None, None, "", 0, state
    dates, ids, lines, reactions = zip(*rows, strict=True)
    return chat, topic, "window", min(ids), max(ids), list(ids), min(dates), max(dates), "\n".join(x for x in lines if x is not None), sum(reactions), state


def window_stream(lines: DataFrame, gap_min: int = schema.WINDOW_GAP_MIN, max_msgs: int = schema.WINDOW_MAX_MSGS, max_chars: int = schema.WINDOW_MAX_CHARS, lateness_s: int = 600, slack: str = "10 seconds") -> DataFrame:
    """A stream of closed, open and late windows, in the columns of ``STATES``, from one of rendered messages.

    Those have chat_id, topic_id, date, msg_id, line, reactions and ``arrived``, a timestamp that goes back by
    ``slack`` at most. ``keep_windows`` sets the RocksDB state store, so that what is open need not fit in memory.
    """
    keyed = lines.select("chat_id", F.coalesce("topic_id", F.lit(-1).cast("long")).alias("topic_id"), "date", "msg_id", "line", "reactions", "arrived")
    of = keyed.withWatermark("arrived", slack).groupBy(*_KEY)
    return of.applyInPandasWithState(open_windows(gap_min * 60, max_msgs, max_chars, lateness_s), STATES, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def keep_windows(lines: DataFrame, folder: str, checkpoint: str, **limits: Any) -> StreamingQuery:
    """Start a query that keeps the windows of a stream of messages in a folder; ends when all there is has been read."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").partitionBy("state").parquet(f"{folder}/batches/{number}")

    conf = lines.sparkSession.conf
    before = conf.get(_BACKEND, None)
    conf.set(_BACKEND, _ROCKSDB)  # a query keeps what was set when it started
    try:
        return window_stream(lines, **limits).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_BACKEND, before) if before else conf.unset(_BACKEND)


class WindowLog:
    """What batches of ``keep_windows`` left in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self) -> tuple[DataFrame, int | None]:
        """All rows that count, with the number of their batch: of the last compaction and of the batches after it; and the last number."""
        bases, batches = finished(self.spark, f"{self.folder}/base"), finished(self.spark, f"{self.folder}/batches")
        after = [n for n in batches if not bases or n > bases[-1]]
        paths = [f"{self.folder}/base/{n}" for n in bases[-1:]] + [f"{self.folder}/batches/{n}" for n in after]
        if not paths:
            return self.spark.createDataFrame([], f"{STATES}, number long"), None
        parts = [self.spark.read.schema(STATES).parquet(p).withColumn("number", F.lit(int(p.rsplit("/", 1)[1])).cast("long")) for p in paths]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows, max([*bases[-1:], *after])

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        """The open windows that count: of each key those of its last batch."""
        own = rows.where("state = 'open'")
        last = own.groupBy("chat_id", _topic().alias("_t")).agg(F.max("number").alias("number"))
        return own.withColumn("_t", _topic()).join(last, ["chat_id", "_t", "number"], "left_semi").where("size(msg_ids) > 0")

    def state(self, name: str) -> DataFrame:
        """``closed``, ``open`` or ``late`` rows, as units."""
        rows, _ = self._rows()
        found = self._newest(rows) if name == "open" else rows.where(F.col("state") == name)
        return found.select(*un.UNIT_COLUMNS)

    def settled(self, messages: DataFrame, ended: bool = False, **limits: int) -> DataFrame:
        """All rows of ``STATES`` with the stretches that late messages fell into cut again from ``messages``.

        ``messages`` are all that is stored, rendered, with the topic that windows go by; those of topics with late
        ones are read. A stretch that may still grow keeps its late messages, unless the stream has ``ended``.
        """
        rows, _ = self._rows()
        rows = rows.where("state <> 'open'").select(*un.UNIT_COLUMNS, "state").unionByName(self._newest(rows).select(*un.UNIT_COLUMNS, "state"))
        rows = checkpointed(rows.withColumn("_t", _topic()))
        late = rows.where("state = 'late'").select("chat_id", "_t", F.col("msg_ids")[0].alias("msg_id")).distinct()
        own = messages.withColumn("_t", _topic()).join(late.select("chat_id", "_t").distinct(), ["chat_id", "_t"], "left_semi")
        apart = checkpointed(un.runs(own.select("chat_id", "_t", "topic_id", "date", "msg_id", "line", "reactions"), ["chat_id", "_t"], "date", "msg_id", limits.get("gap_min", schema.WINDOW_GAP_MIN) * 60))
        stretch = ["chat_id", "_t", "run_at", "run_tie"]
        again = apart.join(late, ["chat_id", "_t", "msg_id"], "left_semi").select(*stretch).distinct()
        if not ended:
            growing = rows.where("state = 'open'").select("chat_id", "_t", F.explode("msg_ids").alias("msg_id"))
            again = again.join(apart.join(growing, ["chat_id", "_t", "msg_id"], "left_semi").select(*stretch).distinct(), stretch, "left_anti")
        tail = checkpointed(apart.join(again, stretch, "left_semi"))
        ids = tail.select("chat_id", "_t", "msg_id")
        kept = rows.withColumn("msg_id", F.col("msg_ids")[0]).join(ids, ["chat_id", "_t", "msg_id"], "left_anti")
        fresh = un.windows(tail, **limits).withColumn("state", F.lit("closed"))
        return kept.select(*un.UNIT_COLUMNS, "state").unionByName(fresh.select(*un.UNIT_COLUMNS, "state"))

    def compact(self, messages: DataFrame, **limits: int) -> None:
        """Put all batches so far together into one folder, stretches with late messages that have ended cut again."""
        _, last = self._rows()
        if last is not None:
            self.settled(messages, **limits).write.mode("overwrite").parquet(f"{self.folder}/base/{last}")


def _topic() -> Column:
    return F.coalesce(F.col("topic_id"), F.lit(-1).cast("long"))
