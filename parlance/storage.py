"""Stored tables: cutting lineage, merging batches, states and clocks of rows, deletions and what they take along."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import links as ln
from parlance.schema import CHATS, DEFAULT_ACCOUNT, IMPORT_PREFIX, MESSAGES, SYNTHETIC_BASE, conform


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own temporary one only where all of Spark is one process."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="parlance-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, so that its lineage ends there.

    For tables that grow with the input: a checkpoint has rows as they lie in memory, which take some times the disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    swept(spark)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are written: Spark deletes them once the driver's heap is collected, which is seldom where it holds little."""
    spark._jvm.System.gc()


def finished(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    """The numbers that name folders below a folder which were written to their end, in order."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath() for s in files.listStatus(path) if files.exists(make(s.getPath(), "_SUCCESS"))]
    return sorted(n for n in (int(p.getName()) for p in names) if below is None or n < below)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows``, never broadcast in the join they go into.

    For tables that grow with the input: of a few columns of a wide one Spark guesses a small part of the compressed
    file, so that millions of rows would go through the driver.
    """
    return rows.hint("merge")


#: Bytes of input that a task is given, and tasks for each core at most. Sizes behind joins are guesses, often far too large: a
#: table of more than ``GUESSED`` bytes counts as of unknown size.
TASK_BYTES, TASKS, GUESSED = 16 << 20, 64, 1 << 50


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, and over more where a task would have over ``TASK_BYTES``.

    Before work that costs far more than moving the rows: a file's row group, however large, is a single task's otherwise.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = min(int(plan.stats().sizeInBytes()), sum(n for n in read if n < GUESSED))
    return rows.repartition(max(cores, min(-(-size // TASK_BYTES), TASKS * cores)))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: one aggregate with map-side combine, so a key with many rows is no burden."""
    payload = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in payload])


def merge(stored: DataFrame, fresh: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Upsert: every row of either table, one for each key; ``fresh`` has at most one.

    ``rules`` says what becomes of a column of a row that both have: ``new`` (the default, also to null), ``keep`` (the
    new value unless null), ``fill`` (the old value unless null), ``max``, ``min`` (null if either is), ``stay`` (the old).
    """
    rules = rules or {}
    columns = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    new = fresh.select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(new, keys, "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col("_old")[c], F.col("_new")[c]
        either = {"new": n, "keep": F.coalesce(n, o), "fill": F.coalesce(o, n), "stay": o}.get(rules.get(c, "new"))
        if either is None:
            pick = F.greatest(o, n) if rules[c] == "max" else F.least(o, n)
            either = F.when(o.isNotNull() & n.isNotNull(), pick)
        return F.when(F.col("_new").isNull(), o).when(F.col("_old").isNull(), n).otherwise(either).alias(c)

    return both.select(*keys, *[merged(c) for c in columns])


# ------------------------------------------------------------------- messages

# States of an attachment's extraction.
PENDING, EXTRACTED, UNSUPPORTED, FAILED, SKIPPED, DISABLED = range(6)


def attachment_replaced(old: Column, new: Column) -> Column:
    """Whether two message rows (structs) carry different attachments; nulls are equal."""
    return ~(old["media_kind"].eqNullSafe(new["media_kind"]) & old["media_filename"].eqNullSafe(new["media_filename"]))


def upsert_messages(stored: DataFrame, batch: DataFrame, tick: int = 0, order: list[str] | None = None) -> DataFrame:
    """All messages after a batch, one row for each (chat_id, msg_id), in the columns of ``schema.MESSAGES``.

    ``order`` names columns of ``batch`` by which the last of several rows of a message wins. A topic, a comment's
    post and links stay where the batch says nothing (null) of them. What was read from an attachment and its state
    stay unless the attachment changed. A row is marked as not indexed. It takes the ``tick`` of the lead clock if it
    is new or its links were read again; rows that the batch does not have stay as they are.
    """
    keys = ["chat_id", "msg_id"]
    if order:
        batch = latest(batch, keys, [F.col(c) for c in order])
    stored, batch = conform(stored, MESSAGES), conform(batch, MESSAGES)
    columns = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    new = batch.select(*keys, F.struct(*columns).alias("_new"))
    o, n = F.col("_old"), F.col("_new")
    fresh, read = o.isNull(), n["links"].isNotNull()
    replaced = attachment_replaced(o, n)
    values = {c: n[c] for c in columns}
    values |= {c: F.coalesce(n[c], o[c]) for c in ("topic_id", "comment_of_chat_id", "comment_of_msg_id", "links")}
    values["extracted"] = F.when(fresh, n["extracted"]).when(~replaced, o["extracted"])
    values["media_state"] = F.when(fresh, F.coalesce(n["media_state"], F.lit(PENDING))).when(replaced, PENDING).otherwise(o["media_state"])
    values["links_read"] = read | F.coalesce(o["links_read"], F.lit(False))
    values["lead_seq"] = F.when(fresh | read, F.lit(tick).cast("long")).otherwise(o["lead_seq"])
    values["indexed"] = F.lit(False)
    both = old.join(new, keys, "full_outer")
    return both.select(*keys, *[F.when(n.isNull(), o[c]).otherwise(v).alias(c) for c, v in values.items()]).select(*stored.columns)


def lead_clock(messages: DataFrame) -> int:
    """The last tick of the lead clock; a batch takes the next."""
    return messages.agg(F.coalesce(F.max("lead_seq"), F.lit(1))).head()[0]


def mark_indexed(messages: DataFrame, rows: DataFrame, indexed: bool = True) -> DataFrame:
    """``messages`` with the flag of those in ``rows`` (chat_id, msg_id) set; other columns stay."""
    named = rows.select("chat_id", "msg_id", F.lit(True).alias("_named")).distinct()
    return messages.join(named, ["chat_id", "msg_id"], "left").withColumn("indexed", F.when(F.col("_named"), F.lit(indexed)).otherwise(F.col("indexed"))).select(*messages.columns)


def set_media_text(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """What was read from attachments, (chat_id, msg_id, read), is stored; their rows are to be indexed again."""
    new = texts.select("chat_id", "msg_id", F.col("read").alias("_read"), F.lit(True).alias("_there"))
    joined = messages.join(new, ["chat_id", "msg_id"], "left")
    values = {"extracted": F.col("_read"), "media_state": F.lit(EXTRACTED), "indexed": F.lit(False)}
    return joined.select(*[F.when(F.col("_there"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in messages.columns])


def set_captured_links(messages: DataFrame, read: DataFrame, tick: int) -> DataFrame:
    """Links and forward origins read again, (chat_id, msg_id, links, fwd_from_id, fwd_msg_id, fwd_date), are stored.

    Nothing else of a row changes, rows that are not stored are not made, and each row takes the tick of the clock.
    """
    taken = ["links", "fwd_from_id", "fwd_msg_id", "fwd_date"]
    new = read.select("chat_id", "msg_id", F.struct(*taken).alias("_new"))
    values = {c: F.coalesce(F.col("_new")[c], F.array().cast("array<struct<kind:string,target:string>>")) if c == "links" else F.col("_new")[c] for c in taken}
    values |= {"links_read": F.lit(True), "lead_seq": F.lit(tick).cast("long")}
    joined = messages.join(new, ["chat_id", "msg_id"], "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in messages.columns])


def page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next ``limit`` rows by ``key`` after a value: keyset paging, whose filter reaches the scan."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def next_pages(rows: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` message ids of every chat after its cursor, (chat_id, after); from the start without one."""
    ahead = rows.join(cursors.select("chat_id", F.col("after").alias("_after")), "chat_id", "left").where(F.col("msg_id") > F.coalesce("_after", F.lit(-1)))
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy("msg_id"))
    return ahead.withColumn("_n", place).where(F.col("_n") <= limit).select(*rows.columns)


def chats_with(messages: DataFrame, what: str) -> DataFrame:
    """(chat_id): chats that hold rows which are ``unindexed``, ``pending`` (of extraction), or ``unread`` (their links)."""
    on = {"unindexed": ~F.coalesce("indexed", F.lit(False)), "pending": (F.col("media_state") == PENDING) & F.col("media_kind").isNotNull(), "unread": ~F.coalesce("links_read", F.lit(False))}[what]
    return messages.where(on).select("chat_id").distinct()


def comment_counts(messages: DataFrame) -> DataFrame:
    """(chat_id, channel_id, post_id, comments): comments stored of each post, by the group that holds them."""
    rows = messages.where("comment_of_chat_id is not null and comment_of_msg_id is not null")
    return rows.groupBy("chat_id", F.col("comment_of_chat_id").alias("channel_id"), F.col("comment_of_msg_id").alias("post_id")).agg(F.count("*").alias("comments"))


def changed(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``batch`` that are new or differ from what is stored, nulls being equal."""
    columns = [c for c in batch.columns if c not in keys]
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    return batch.join(old, keys, "left").where(~F.struct(*columns).eqNullSafe(F.col("_old"))).select(*batch.columns)


def edits(stored: DataFrame, again: DataFrame, newest: int) -> DataFrame:
    """Of rows read again, those among the ``newest`` of their chat that are stored and would change.

    Rows are compared as the upsert would keep them: a topic, a comment's post or links that the batch does not give
    are no change, nor is what was read from an attachment.
    """
    keys = ["chat_id", "msg_id"]
    columns = [c for c in again.columns if c in stored.columns and c not in (*keys, "extracted", "media_state", "links_read", "lead_seq", "indexed")]
    kept = ("topic_id", "comment_of_chat_id", "comment_of_msg_id", "links")
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("msg_id")))
    top = again.withColumn("_n", place).where(F.col("_n") <= newest).drop("_n")
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    would = F.struct(*[F.coalesce(F.col(c), F.col("_old")[c]).alias(c) if c in kept else F.col(c) for c in columns])
    return top.join(old, keys).where(~would.eqNullSafe(F.col("_old"))).select(*again.columns)


# ------------------------------------------------------------------ attachments

#: Endings of documents that a reader exists for.
READABLE = (".pdf", ".docx")


def next_media_state(state: Column, outcome: Column) -> Column:
    """Where an extraction leads from the queue; what is settled stays."""
    to = F.when(outcome.isin("text", "empty"), EXTRACTED).when(outcome == "unsupported", UNSUPPORTED).when(outcome == "error", FAILED).when(outcome == "skipped", SKIPPED)
    return F.when(state == PENDING, F.coalesce(to, F.lit(PENDING))).otherwise(state)


def offline_media_state(state: Column, kind: Column, filename: Column, readers: list[str], off: list[str], retry_failed: bool = False) -> Column:
    """What the kind alone decides of an attachment's state, before any file is read.

    Kinds without a reader are parked as unsupported, those switched off as disabled; what was switched on again goes
    back to the queue, and with ``retry_failed`` what failed or was unsupported too. A document whose name has an
    ending that no reader knows is unsupported; one without a name stays.
    """
    live, unread = kind.isin([k for k in readers if k not in off]), ~kind.isin(readers)
    back = [DISABLED, *([FAILED, UNSUPPORTED] if retry_failed else [])]
    state = F.when((state == PENDING) & unread, UNSUPPORTED).when((state == PENDING) & ~live, DISABLED).when(live & state.isin(back), PENDING).otherwise(state)
    foreign = (kind == "document") & live & filename.isNotNull() & ~F.lower(filename).rlike(f"({'|'.join(r.replace('.', '[.]') for r in READABLE)})$")
    return F.when(kind.isNull(), state).when((state == PENDING) & foreign, UNSUPPORTED).otherwise(state)


# ------------------------------------------------------------------------ units


def set_embedded(units: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Units whose ids are in ``embedded`` are clean and carry the model's name."""
    named = embedded.select("unit_id", F.lit(True).alias("_there")).distinct()
    joined = units.join(named, "unit_id", "left")
    values = {"dirty": F.when(F.col("_there"), False).otherwise(F.col("dirty")), "embedded_model": F.when(F.col("_there"), F.lit(model)).otherwise(F.col("embedded_model"))}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in units.columns])


def reset_embedded(units: DataFrame) -> DataFrame:
    """All units are to be embedded again."""
    return units.withColumn("dirty", F.lit(True)).withColumn("embedded_model", F.lit(None).cast("string"))


# ------------------------------------------------------------------------ chats


def upsert_chats(stored: DataFrame, fresh: DataFrame, account: str = DEFAULT_ACCOUNT, mark: int = SYNTHETIC_BASE) -> DataFrame:
    """All chats after ``fresh`` ones of an account, one row for each (scope, peer_id), in the columns of ``schema.CHATS``.

    The scope is empty for channels and supergroups, which all accounts share, else the account. A stored row keeps
    its id, its progress and its discussion link unless a new one is given. A new row has its peer's id, or, where
    another row holds that, the next synthetic id from ``mark`` on; a shared chat whose id is taken is an error.
    """
    stored, fresh = conform(stored, CHATS), conform(fresh, CHATS)
    fresh = fresh.withColumn("scope", ln.scope(F.col("type"), F.lit(account)))
    keys = ["scope", "peer_id"]
    identity = ["type", "title", "username", "is_forum", "is_broadcast", "source_id"]
    update = fresh.select(*keys, F.struct(*identity, "discussion_of").alias("_new"))
    kept = stored.join(update, keys, "left")
    kept = kept.select(*[F.when(F.col("_new").isNotNull(), F.coalesce(F.col("_new")[c], F.col(c)) if c == "discussion_of" else F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in (*identity, "discussion_of") else F.col(c) for c in stored.columns])
    new = fresh.join(stored.select(*keys), keys, "left_anti")
    held = stored.select(F.col("id").alias("peer_id"), F.lit(True).alias("_held")).distinct()
    new = new.join(held, "peer_id", "left").withColumn("_taken", F.coalesce("_held", F.lit(False)))
    taken = new.where("_taken").select(*keys).distinct()  # only chats that clash are numbered
    turn = F.row_number().over(Window.orderBy(*keys)) - 1
    new = new.join(taken.withColumn("_turn", turn), keys, "left")
    clash = F.raise_error(F.concat(F.lit("chat id is held by another row: "), F.col("peer_id").cast("string"))).cast("long")
    start = F.greatest(F.lit(mark), F.lit(_top_id(stored)))
    new = new.withColumn("id", F.when(~F.col("_taken"), F.col("peer_id")).when(F.col("scope") == "", clash).otherwise(start + F.col("_turn").cast("long")))
    return kept.unionByName(new.select(*stored.columns))


def _top_id(chats: DataFrame) -> int:
    return (chats.where(F.col("id") >= SYNTHETIC_BASE).agg(F.max("id")).head()[0] or SYNTHETIC_BASE - 1) + 1


def move_discussions(chats: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats after channels were linked to groups, (channel_id, group_id), null meaning to none; and what was unlinked.

    The second table is (channel_id, group_id) of the groups that are not the channel's discussion any more.
    """
    told = links.select(F.col("channel_id").alias("discussion_of"), F.col("group_id").alias("_to"), F.lit(True).alias("_told"))
    lost = chats.join(told, "discussion_of").where(~F.col("id").eqNullSafe(F.col("_to"))).select(F.col("discussion_of").alias("channel_id"), F.col("id").alias("group_id"))
    gone = lost.select(F.col("group_id").alias("id"), F.lit(True).alias("_lost"))
    given = links.where("group_id is not null").select(F.col("group_id").alias("id"), F.col("channel_id").alias("_channel"))
    joined = chats.join(gone, "id", "left").join(given, "id", "left")
    link = F.when(F.col("_channel").isNotNull(), F.col("_channel")).when(F.coalesce("_lost", F.lit(False)), None).otherwise(F.col("discussion_of"))
    return joined.withColumn("discussion_of", link).select(*chats.columns), lost


def drop_comments(messages: DataFrame, units: DataFrame, unlinked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left when groups stop being channels' discussions, (channel_id, group_id): messages and units.

    The groups' comments become plain messages, post threads that quote them go, and their posts are to be indexed again.
    """
    pair = unlinked.select(F.col("channel_id").alias("comment_of_chat_id"), F.col("group_id").alias("chat_id")).distinct()
    posts = messages.join(pair, ["chat_id", "comment_of_chat_id"], "left_semi").where("comment_of_msg_id is not null").select(F.col("comment_of_chat_id").alias("chat_id"), F.col("comment_of_msg_id").alias("msg_id")).distinct()
    quoting = units.where("kind = 'thread'").select("unit_id", "chat_id", F.explode("msg_ids").alias("msg_id")).join(posts, ["chat_id", "msg_id"], "left_semi").select("unit_id").distinct()
    marked = mark_indexed(messages, posts, False).join(pair.withColumn("_cut", F.lit(True)), ["chat_id", "comment_of_chat_id"], "left")
    values = {c: F.when(F.col("_cut"), None).otherwise(F.col(c)) for c in ("comment_of_chat_id", "comment_of_msg_id")}
    return marked.select(*[values[c].alias(c) if c in values else F.col(c) for c in messages.columns]), units.join(quoting, "unit_id", "left_anti")


def deleted(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored messages that are gone: missing among those seen of their chat, within the range of ids seen.

    Comments are left alone: it is their post's thread that tells of them.
    """
    span = seen.groupBy("chat_id").agg(F.min("msg_id").alias("_a"), F.max("msg_id").alias("_b"))
    if "comment_of_chat_id" in stored.columns:
        stored = stored.where("comment_of_chat_id is null")
    inside = stored.join(span, "chat_id").where(F.col("msg_id").between(F.col("_a"), F.col("_b")))
    return inside.join(seen.select("chat_id", "msg_id").distinct(), ["chat_id", "msg_id"], "left_anti").select(*stored.columns)


def delete_chats(tables: dict[str, DataFrame], chat_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given chats (chat_id).

    ``tables`` has ``chats``, ``messages``, ``units`` (with unit_id), and any others with a chat_id or a unit_id (the
    latter follow their units). A deleted group's comments leave its channel's post threads; a deleted channel's group
    lives on without the link.
    """
    gone = chat_ids.select("chat_id").distinct()
    chats, messages, units = tables["chats"], tables["messages"], tables["units"]
    of_groups = chats.join(gone.withColumnRenamed("chat_id", "id"), "id", "left_semi").where("discussion_of is not null").select(F.col("discussion_of").alias("channel_id"), F.col("id").alias("group_id"))
    of_channels = chats.join(gone.withColumnRenamed("chat_id", "discussion_of"), "discussion_of", "left_semi").select(F.col("discussion_of").alias("channel_id"), F.col("id").alias("group_id"))
    messages, units = drop_comments(messages, units, of_groups.unionByName(of_channels))
    channels = gone.select(F.col("chat_id").alias("discussion_of"), F.lit(True).alias("_gone"))
    chats = chats.join(channels, "discussion_of", "left").withColumn("discussion_of", F.when(F.col("_gone").isNull(), F.col("discussion_of"))).select(*chats.columns)
    out = {"chats": chats.join(gone.withColumnRenamed("chat_id", "id"), "id", "left_anti"), "messages": messages.join(gone, "chat_id", "left_anti"), "units": units.join(gone, "chat_id", "left_anti")}
    for name, df in tables.items():
        if name not in out:
            out[name] = df.join(gone, "chat_id", "left_anti") if "chat_id" in df.columns else df.join(out["units"].select("unit_id"), "unit_id", "left_semi")
    return out


def refetchable(chats: DataFrame) -> DataFrame:
    """Chats whose messages may be asked for again: neither unavailable nor imported."""
    return chats.where(~F.coalesce("unavailable", F.lit(False)) & ~F.coalesce(F.col("source_id").startswith(IMPORT_PREFIX), F.lit(False)))


def fetchable_by(chats: DataFrame, account: str) -> DataFrame:
    """Chats that an account may fetch: those all accounts share, and its own."""
    return chats.where((F.coalesce("scope", F.lit("")) == "") | (F.col("scope") == account))
