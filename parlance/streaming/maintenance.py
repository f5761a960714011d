"""Messages and units kept up to date from a stream.

State lies in buckets of chats. A batch writes the buckets it touches, as a version of its own number, and last the
table that says which version of each bucket counts: that is the commit. It reads only what batches before it left,
so that a batch which stopped anywhere can be repeated and changes nothing. Rows may come late or again: units are cut
again from the window before a late message on, from the open window otherwise (see ``upkeep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance import schema
from parlance.operators import upkeep
from parlance.operators.units import build_units
from parlance.storage import checkpointed, conform, finished, latest, upsert_messages

UNITS = f"{schema.UNITS}, unit_id long"
#: Buckets that chats are dealt to.
BUCKETS = 64


def bucket(chat: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(chat), F.lit(buckets)).cast("int")


class Store:
    """Versioned buckets of messages and units in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, messages: str = schema.MESSAGES, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.columns = {"messages": messages, "units": UNITS}

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self, below: int | None = None) -> list[int]:
        """Numbers of the batches that were finished, before ``below``."""
        return finished(self.spark, f"{self.folder}/commits", below)

    def versions(self, below: int | None = None) -> dict[int, int]:
        """Bucket: the batch that wrote it last, of the batches before ``below``. There is a row for each bucket."""
        done = self.commits(below)
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.folder}/commits/{done[-1]}").collect()} if done else {}

    def read(self, what: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Messages or units as the batches before ``below`` left them; of some buckets only, if named."""
        paths = [f"{self.folder}/{what}/{v}/bucket={b}" for b, v in self.versions(below).items() if buckets is None or b in buckets]
        paths = [p for p in paths if (lambda at: at[1].exists(at[0]))(self._files(p))]
        reader = self.spark.read.schema(self.columns[what])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.columns[what])

    def write(self, what: str, rows: DataFrame, number: int) -> None:
        placed = rows.withColumn("bucket", bucket(F.col("chat_id"), self.buckets)).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{what}/{number}")

    def commit(self, touched: list[int], number: int) -> None:
        """Make a batch count, and drop what neither it nor the one before it reads."""
        before = self.versions(number)
        now = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{number}")
        for b in touched:
            old = [v for v in {self.versions(n).get(b) for n in self.commits(number)[-3:]} if v is not None and v not in (now[b], before.get(b))]
            for what in self.columns:
                for v in old:
                    path, files = self._files(f"{self.folder}/{what}/{v}/bucket={b}")
                    files.delete(path, True)


def maintain(stream: DataFrame, folder: str, checkpoint: str, chats: DataFrame | None = None, order: list[str] | None = None, buckets: int = BUCKETS, cap: int = schema.THREAD_MAX_MSGS, **limits: int) -> StreamingQuery:
    """Start a query that merges each batch of messages into the store in ``folder`` and brings its units up to date.

    ``order`` names columns by which the last of several rows of a message in a batch wins. ``chats`` says what kind
    each chat is; without it all are plain talk. Ends when all there is has been read.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        store = Store(spark, folder, buckets=buckets)
        extra = [c for c in order or [] if c not in schema.MESSAGES.replace(",", "").split()]
        fresh = conform(rows, schema.MESSAGES) if not extra else rows.select(*[c for c in conform(rows, schema.MESSAGES).columns if c in rows.columns], *extra)
        fresh = checkpointed(conform(latest(fresh, ["chat_id", "msg_id"], [F.col(c) for c in order or ["date"]]), schema.MESSAGES))
        touched = [r.b for r in fresh.select(bucket(F.col("chat_id"), buckets).alias("b")).distinct().collect()]
        if not touched:
            return
        stored = store.read("messages", number, touched)
        merged = upsert_messages(stored, fresh, tick=number + 2).withColumn("indexed", F.lit(True))
        store.write("messages", merged, number)
        paths = f"{store.folder}/messages/{number}"
        now = spark.read.schema(f"{schema.MESSAGES}, bucket int").parquet(paths).drop("bucket")
        units = checkpointed(store.read("units", number, touched))
        kinds = chats if chats is not None else now.select(F.col("chat_id").alias("id"), F.lit(False).alias("is_forum"), F.lit(False).alias("is_broadcast")).distinct()
        if units.isEmpty():  # nothing was cut before
            current = upkeep.with_ids(build_units(now, kinds, cap=cap, **limits)).select(*units.columns)
        else:
            gone, new = upkeep.rebuild(now, units, fresh.select("chat_id", "msg_id"), kinds, cap=cap, **limits)
            current = upkeep.units_with_reactions(upkeep.applied(units, gone, new), now, fresh)
        store.write("units", current, number)
        store.commit(touched, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
