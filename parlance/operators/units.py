"""Units: conversation-sized documents cut from messages.

``windows``  time windows of a chat (of a topic in a forum)
``threads``  a root and all replies below it, in pieces
``posts``    a channel's posts, and each post with its comments in pieces

Messages carry a rendered ``line``; see ``render``. A unit lists its message ids in order, its span of ids and dates,
its text and the reactions of its messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import text as tx
from parlance.operators.ordered import numbered
from parlance.storage import checkpointed, shuffled

UNIT_COLUMNS = ["chat_id", "topic_id", "kind", "msg_id_start", "msg_id_end", "msg_ids", "date_start", "date_end", "text", "reactions"]


def none(like: DataFrame) -> DataFrame:
    """No units."""
    return like.sparkSession.createDataFrame([], schema.UNITS)


def render(messages: DataFrame) -> DataFrame:
    """Messages with the ``line`` that stands for them in a unit's text."""
    what = tx.body(F.col("text"), F.col("media_kind"), F.col("media_filename"), F.col("extracted"))
    return messages.withColumn("line", tx.line(F.col("date"), tx.sender(F.col("from_name"), F.col("from_id")), what))


def window_topic(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages whose topic_id is kept in forums only: other chats are one run of talk."""
    forums = chats.select(F.col("id").alias("chat_id"), F.coalesce("is_forum", F.lit(False)).alias("_forum"))
    return messages.join(forums, "chat_id", "left").withColumn("topic_id", F.when(F.col("_forum"), F.col("topic_id"))).drop("_forum")


def _gather(rows: DataFrame, keys: list[str], kind: str, order: list[str], first: Column | None = None) -> DataFrame:
    """One unit for each key: lines and ids in order, sums and spans."""
    item = F.struct(*order, "msg_id", "line")
    listed = F.array_sort(F.collect_list(item))
    units = rows.groupBy(*keys).agg(
        listed.alias("_items"), F.min("msg_id").alias("msg_id_start"), F.max("msg_id").alias("msg_id_end"),
        F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.sum(F.coalesce("reactions", F.lit(0))).alias("reactions"),
    )
    units = units.withColumn("msg_ids", F.transform("_items", lambda x: x["msg_id"])).withColumn("text", F.array_join(F.transform("_items", lambda x: x["line"]), "\n"))
    if "topic_id" not in keys:
        units = units.withColumn("topic_id", F.lit(None).cast("long"))
    return units.withColumn("kind", F.lit(kind)).select(*UNIT_COLUMNS, *[k for k in keys if k not in UNIT_COLUMNS])


# -------------------------------------------------------------------- windows


def runs(rows: DataFrame, keys: list[str], at: str, tie: str, gap_s: int) -> DataFrame:
    """Rows with ``run_at`` and ``run_tie``: the first row of the stretch each is in, stretches being apart by over ``gap_s``.

    Keys are taken in slices of time of at least a day, so that a busy key is spread over tasks. What crosses a slice
    (the last row before it, the last stretch begun) is carried over by one row for each slice.
    """
    slice_s = max(86_400, gap_s + 1)
    null_keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    cut = rows.select("*", *null_keys, F.floor(F.col(at) / slice_s).alias("_slice"))
    before = Window.partitionBy(*own).orderBy("_slice")
    edges = cut.groupBy(*own, "_slice").agg(F.max(at).alias("_top")).withColumn("_last", F.lag("_top").over(before)).drop("_top")
    inside = Window.partitionBy(*own, "_slice").orderBy(at, tie)
    marked = cut.join(edges, [*own, "_slice"]).withColumn("_prev", F.coalesce(F.lag(at).over(inside), "_last"))
    first = F.when(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") > gap_s), F.struct(F.col(at).alias("a"), F.col(tie).alias("t")))
    marked = marked.withColumn("_start", F.last(first, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*own, "_slice").agg(F.max("_start").alias("_begun"))
    carried = ends.withColumn("_carry", F.last("_begun", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))).drop("_begun")
    found = marked.join(carried, [*own, "_slice"]).withColumn("_start", F.coalesce("_start", "_carry"))
    return found.select(*rows.columns, F.col("_start.a").alias("run_at"), F.col("_start.t").alias("run_tie"))


#: A topic with more messages than this is walked by runs, in several tasks.
BUSY_ROWS = 200_000


def windows(messages: DataFrame, gap_min: int = schema.WINDOW_GAP_MIN, max_msgs: int = schema.WINDOW_MAX_MSGS, max_chars: int = schema.WINDOW_MAX_CHARS) -> DataFrame:
    """``window`` units of rendered messages.

    In order of (date, msg_id) a message begins a window when more than ``gap_min`` minutes lie before it, when the
    open window is full, or when its line and a line feed would not fit any more; a longer line is a window alone.
    Each topic is walked in order, after one shuffle; a task holds no more than the open window. A gap ends a window
    whatever came before, so that the runs between gaps of a busy topic are walked apart from each other. A run
    without a gap depends on its order throughout and is one task's.
    """
    key = ["chat_id", "topic_id"]
    rows = messages.select(*key, "date", "msg_id", "line", "reactions")
    busy = checkpointed(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BUSY_ROWS).drop("n"))
    walk = _window_walk(gap_min * 60, max_msgs, max_chars)
    if busy.isEmpty():
        return rows.repartition(*key).sortWithinPartitions(*key, "date", "msg_id").mapInArrow(walk, schema.UNITS)
    named = busy.select(F.col("chat_id").alias("_chat"), F.col("topic_id").alias("_topic"))
    on = (F.col("chat_id") == F.col("_chat")) & F.col("topic_id").eqNullSafe(F.col("_topic"))
    cool = rows.join(F.broadcast(named) if busy.count() <= 100_000 else named, on, "left_anti").withColumn("run_at", F.lit(0).cast("long")).withColumn("run_tie", F.lit(0).cast("long"))
    hot = runs(rows.join(named, on, "left_semi"), key, "date", "msg_id", gap_min * 60)
    both = cool.unionByName(hot).repartition(*key, "run_at", "run_tie")
    return both.sortWithinPartitions(*key, "date", "msg_id").drop("run_at", "run_tie").mapInArrow(walk, schema.UNITS)


def _window_walk(gap_s: int, max_msgs: int, max_chars: int):
    fields = [f.split()[0] for f in schema.UNITS.split(", ")]
    types = {"kind": pa.string(), "text": pa.string(), "msg_ids": pa.list_(pa.int64())}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, last, chars, held = None, 0, 0, []

        def close() -> None:
            if held:
                dates, ids, lines, reactions = zip(*held, strict=True)
                done.append((*now, "window", min(ids), max(ids), list(ids), min(dates), max(dates), "\n".join(x for x in lines if x is not None), sum(r or 0 for r in reactions)))
                held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(fields)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for c, n in zip(columns, fields, strict=True)], fields)

        for batch in batches:
            for chat, topic, date, i, line, r in zip(*(batch.column(c).to_pylist() for c in ("chat_id", "topic_id", "date", "msg_id", "line", "reactions")), strict=True):
                size = len(line or "")
                if (chat, topic) != now or date - last > gap_s or len(held) >= max_msgs or chars + 1 + size > max_chars:
                    close()
                    now, chars = (chat, topic), -1
                chars += 1 + size
                last = date
                held.append((date, i, line, r))
            yield flush()
        close()
        yield flush()

    return walk


def gap_sessions(events: DataFrame, key: str, at: str, tie: str, gap_s: int) -> DataFrame:
    """Events with ``session``: how many gaps of over ``gap_s`` seconds came before, within a key."""
    apart = runs(events, [key], at, tie, gap_s)
    starts = apart.select(F.col(key).alias("_key"), F.col("run_at").alias("_at")).distinct()
    starts = starts.withColumn("session", (F.row_number().over(Window.partitionBy("_key").orderBy("_at")) - 1).cast("long"))
    return apart.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("run_at") == F.col("_at"))).drop("_key", "_at", "run_at", "run_tie")


# -------------------------------------------------------------------- threads


def reply_roots(messages: DataFrame) -> DataFrame:
    """(chat_id, msg_id, root): the message at the top of each reply chain, for messages that have one.

    A parent counts if it is another stored message of the chat. Pointers double their reach every round, so that
    the rounds grow with the logarithm of the longest chain; members of a cycle have no root and are left out.
    """
    below = _below(messages)
    tops = messages.select("chat_id", "msg_id").join(shuffled(below.select("chat_id", "msg_id")), ["chat_id", "msg_id"], "left_anti")
    return _climbed(below).unionByName(tops.withColumn("root", F.col("msg_id")))


def _below(messages: DataFrame) -> DataFrame:
    """(chat_id, msg_id, up): the messages that reply to another stored one."""
    own = messages.select("chat_id", "msg_id", "reply_to_msg_id")
    up = own.where("reply_to_msg_id <> msg_id").withColumnRenamed("reply_to_msg_id", "up")
    return checkpointed(up.join(shuffled(own.select("chat_id", F.col("msg_id").alias("up"))), ["chat_id", "up"], "left_semi").select("chat_id", "msg_id", "up"))


def _climbed(below: DataFrame) -> DataFrame:
    """(chat_id, msg_id, root) of the messages that ``_below`` gives; ``up`` is the ancestor reached so far while there may be one above it, ``root`` the highest seen."""
    state = below.withColumn("root", F.col("up"))
    for _ in range(64):
        if state.where("up is not null").isEmpty():
            break
        above = shuffled(state.select("chat_id", F.col("msg_id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root")))
        nxt = checkpointed(state.join(above, ["chat_id", "up"], "left").select("chat_id", "msg_id", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root")))
        if nxt.where("up is not null").count() == state.where("up is not null").count():
            state = nxt  # only cycles are left
            break
        state = nxt
    return state.where("up is null").select("chat_id", "msg_id", "root")


def threads(messages: DataFrame, cap: int = schema.THREAD_MAX_MSGS) -> DataFrame:
    """``thread`` units: a root that has replies, and all below it by time, in pieces that repeat the root first."""
    below = _below(messages)
    if below.isEmpty():
        return none(messages)
    roots = _climbed(below)
    replies = shuffled(messages).join(roots, ["chat_id", "msg_id"])
    # a thread of any number of replies is numbered by slices of a day, not sorted by one task
    replies = numbered(replies, ["chat_id", "root"], "date", "_turn", [F.col("msg_id")], 86_400).withColumn("piece", F.floor((F.col("_turn") - 1) / max(cap - 1, 1))).drop("_turn")
    pieces = replies.select("chat_id", "root", "piece").distinct()
    heads = shuffled(messages.withColumnRenamed("msg_id", "root")).join(pieces, ["chat_id", "root"]).withColumn("msg_id", F.col("root"))
    shown = ["chat_id", "root", "piece", "msg_id", "date", "line", "reactions"]
    rows = replies.select(*shown, F.lit(1).alias("later")).unionByName(heads.select(*shown, F.lit(0).alias("later")))
    topics = messages.select("chat_id", F.col("msg_id").alias("root"), F.col("topic_id").alias("_topic"))
    units = _gather(rows, ["chat_id", "root", "piece"], "thread", ["later", "date"]).join(shuffled(topics), ["chat_id", "root"])
    return units.withColumn("topic_id", F.col("_topic")).select(*UNIT_COLUMNS)


# ---------------------------------------------------------------------- posts


def posts(messages: DataFrame) -> DataFrame:
    """One ``post`` unit for each message of a channel."""
    return messages.select(
        "chat_id", F.lit(None).cast("long").alias("topic_id"), F.lit("post").alias("kind"), F.col("msg_id").alias("msg_id_start"), F.col("msg_id").alias("msg_id_end"),
        F.array("msg_id").alias("msg_ids"), F.col("date").alias("date_start"), F.col("date").alias("date_end"), F.col("line").alias("text"), F.coalesce("reactions", F.lit(0)).alias("reactions"),
    )


def post_threads(messages: DataFrame, comments: DataFrame, cap: int = schema.THREAD_MAX_MSGS) -> DataFrame:
    """``thread`` units of a channel's posts and their comments, in pieces that repeat the post.

    A comment names its channel and post; both must agree. A unit lists the post alone and has the post's reactions,
    while its text and end date reach over the comments.
    """
    own = comments.where("comment_of_chat_id is not null and comment_of_msg_id is not null").select(
        F.col("comment_of_chat_id").alias("chat_id"), F.col("comment_of_msg_id").alias("post_id"), F.col("msg_id").alias("comment_id"), F.col("date").alias("c_date"), F.col("line").alias("c_line")
    )
    own = numbered(own, ["chat_id", "post_id"], "c_date", "_turn", [F.col("comment_id")], 86_400)
    pieces = own.withColumn("piece", F.floor((F.col("_turn") - 1) / max(cap - 1, 1))).groupBy("chat_id", "post_id", "piece").agg(F.array_sort(F.collect_list(F.struct("c_date", "comment_id", "c_line"))).alias("c"), F.max("c_date").alias("c_end"))
    joined = posts(messages).withColumn("post_id", F.col("msg_id_start")).join(pieces, ["chat_id", "post_id"])
    lines = F.concat(F.array("text"), F.transform("c", lambda x: x["c_line"]))
    return joined.withColumn("text", F.array_join(lines, "\n")).withColumn("date_end", F.greatest("date_end", "c_end")).withColumn("kind", F.lit("thread")).select(*UNIT_COLUMNS)


def build_units(messages: DataFrame, chats: DataFrame, comments: bool = True, cap: int = schema.THREAD_MAX_MSGS, **limits: int) -> DataFrame:
    """All units: posts and post threads of channels, windows and threads of all other chats."""
    lines = render(messages)
    cast = chats.where(F.coalesce("is_broadcast", F.lit(False))).select(F.col("id").alias("chat_id"))
    channel, talk = lines.join(cast, "chat_id", "left_semi"), lines.join(cast, "chat_id", "left_anti")
    out = windows(window_topic(talk, chats), **limits).unionByName(threads(talk, cap)).unionByName(posts(channel))
    return out.unionByName(post_threads(channel, talk, cap)) if comments else out


# ---------------------------------------------------------------- maintenance


def content_key() -> Column:
    """What makes two units the same: all but reactions, so that new reactions don't cost a new embedding."""
    return F.xxhash64("kind", "topic_id", F.to_json("msg_ids"), "date_start", "date_end", "text")


def unit_delta(stored: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, new): stored units that are no more, and fresh ones that are not stored yet."""
    old, new = stored.withColumn("_key", content_key()), fresh.withColumn("_key", content_key())
    return old.join(new, ["chat_id", "_key"], "left_anti").drop("_key"), new.join(old, ["chat_id", "_key"], "left_anti").drop("_key")


def refresh_reactions(units: DataFrame, messages: DataFrame) -> DataFrame:
    """Units with the sum of the reactions that the messages they list have now."""
    keyed = units.withColumn("_unit", F.xxhash64(content_key(), "chat_id"))
    now = messages.select("chat_id", "msg_id", F.col("reactions").alias("_r"))
    sums = keyed.select("chat_id", "_unit", F.explode("msg_ids").alias("msg_id")).join(now, ["chat_id", "msg_id"]).groupBy("chat_id", "_unit").agg(F.sum("_r").alias("_sum"))
    return keyed.join(sums, ["chat_id", "_unit"], "left").withColumn("reactions", F.coalesce("_sum", F.lit(0))).drop("_unit", "_sum").select(*units.columns)


def uncut(messages: DataFrame, units: DataFrame) -> DataFrame:
    """Messages that no window lists yet."""
    held = units.where("kind = 'window'").select("chat_id", F.explode("msg_ids").alias("msg_id"))
    return messages.join(held, ["chat_id", "msg_id"], "left_anti")
