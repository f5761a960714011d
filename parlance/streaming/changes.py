"""Changes that a restart finishes: what is to be changed and cut again is written down before anything is touched.

An intent holds the messages that come or were edited, the ids of those that went, and chats to be cut again as a
whole. It is applied as a batch of the store, whose commit clears it: an intent counts as pending until the store has a
commit of its number. Applying reads what earlier commits left and writes under its own number, so that one which
stopped anywhere is applied again from its start. A store that takes changes has no stream beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import schema
from parlance.budget import Budget
from parlance.operators import upkeep
from parlance.operators.units import build_units
from parlance.schema import conform
from parlance.storage import finished, latest, shuffled, upsert_messages, written
from parlance.streaming.maintenance import Store, bucket

INTENTS = f"{schema.MESSAGES}, what string, recipe string"


class Changes:
    """Pending and finished changes of a store. ``chats`` says what kind each chat is."""

    def __init__(self, store: Store, chats: DataFrame, cap: int = schema.THREAD_MAX_MSGS, **limits: int):
        self.store, self.chats, self.cap, self.limits = store, chats, cap, limits
        self.spark, self.folder = store.spark, f"{store.folder}/intents"

    # -------------------------------------------------------------- the log

    def declare(self, put: DataFrame | None = None, drop: DataFrame | None = None, recut: DataFrame | None = None, recipe: str | None = None) -> int:
        """Write down messages to put, (chat_id, msg_id) to drop and (chat_id) to cut again; the intent's number."""
        number = max([-1, *finished(self.spark, self.folder), *self.store.commits()]) + 1
        rows = self.spark.createDataFrame([], INTENTS)
        for what, given in (("put", put), ("drop", drop), ("recut", recut)):
            if given is not None:
                rows = rows.unionByName(conform(given, schema.MESSAGES).select("*", F.lit(what).alias("what"), F.lit(recipe).alias("recipe")))
        rows.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        return number

    def intent(self, number: int) -> DataFrame:
        return self.spark.read.schema(INTENTS).parquet(f"{self.folder}/{number}")

    def pending(self) -> list[int]:
        """Numbers of intents that no commit has cleared, in the order of writing."""
        done = set(self.store.commits())
        return [n for n in finished(self.spark, self.folder) if n not in done]

    # ------------------------------------------------------------- applying

    def replay(self, budget: Budget | None = None) -> list[int]:
        """Apply what is pending while the budget lasts; the numbers that were applied."""
        done = []
        for number in (budget or Budget(None)).over(self.pending()):
            self.apply(number)
            done.append(number)
        return done

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the chats that an intent names, and of channels and discussion groups linked with them."""
        own = rows.select("chat_id").distinct()
        links = self.chats.where("discussion_of is not null").select("id", "discussion_of") if "discussion_of" in self.chats.columns else None
        if links is not None:
            near = links.join(own.withColumnRenamed("chat_id", "id"), "id", "left_semi").select(F.col("discussion_of").alias("chat_id"))
            groups = links.join(own.withColumnRenamed("chat_id", "discussion_of"), "discussion_of", "left_semi").select(F.col("id").alias("chat_id"))
            own = own.unionByName(near).unionByName(groups)
        return sorted(r.b for r in own.select(bucket(F.col("chat_id"), self.store.buckets).alias("b")).distinct().collect())

    def apply(self, number: int) -> None:
        """Messages, then units, then the commit that clears the intent; a closed window that an edit fell into is cut again."""
        store, rows = self.store, self.intent(number)
        touched = self._touched(rows)
        put = written(conform(latest(rows.where("what = 'put'").drop("what", "recipe"), ["chat_id", "msg_id"], [F.col("date")]), schema.MESSAGES))
        drop = rows.where("what = 'drop'").select("chat_id", "msg_id").distinct()
        recut = rows.where("what = 'recut'").select("chat_id").distinct()
        stored = store.read("messages", number, touched)
        merged = upsert_messages(stored, put, tick=number + 2).withColumn("indexed", F.lit(True)).join(shuffled(drop), ["chat_id", "msg_id"], "left_anti")
        store.write("messages", merged, number)
        now = self.spark.read.schema(f"{schema.MESSAGES}, bucket int").parquet(f"{store.folder}/messages/{number}").drop("bucket")
        units = store.read("units", number, touched)
        if units.isEmpty():  # nothing was cut before
            current = upkeep.with_ids(build_units(now, self.chats, cap=self.cap, **self.limits)).select(*units.columns)
        else:
            ids = put.select("chat_id", "msg_id").unionByName(drop)
            before = written(stored.join(shuffled(ids), ["chat_id", "msg_id"], "left_semi"))  # where they stood when units were cut
            fresh = put.select("chat_id", "msg_id").join(shuffled(before.select("chat_id", "msg_id")), ["chat_id", "msg_id"], "left_anti")
            for step in self._steps(now, before, fresh, recut):
                units = written(upkeep.applied(units, *step(units)))
            current = upkeep.units_with_reactions(units, now, put)
        store.write("units", current, number)
        store.commit(touched, number)

    def _steps(self, now: DataFrame, before: DataFrame, fresh: DataFrame, recut: DataFrame) -> list:
        steps = []
        if not before.isEmpty():
            steps.append(lambda u: upkeep.invalidate(now, u, before, self.chats, self.cap, **self.limits))
        if not fresh.isEmpty():
            steps.append(lambda u: upkeep.rebuild(now, u, fresh, self.chats, self.cap, **self.limits))
        if not recut.isEmpty():
            steps.append(lambda u: upkeep.recut_chats(now, u, recut, self.chats, cap=self.cap, **self.limits))
        return steps

    # --------------------------------------------------------------- recipes

    def marked(self, recipe: str) -> DataFrame:
        """(chat_id) of chats that were cut by a recipe: those that a finished intent of it named."""
        done = set(self.store.commits())
        paths = [f"{self.folder}/{n}" for n in finished(self.spark, self.folder) if n in done]
        if not paths:
            return self.spark.createDataFrame([], "chat_id long")
        return self.spark.read.schema(INTENTS).parquet(*paths).where((F.col("what") == "recut") & (F.col("recipe") == recipe)).select("chat_id").distinct()

    def recut_pending(self, recipe: str, budget: Budget | None = None, limit: int = 1000, size: int = 50) -> int:
        """Cut chats again that were not cut by this recipe yet, the first ``limit`` by id; how many were.

        The chats go in slices of ``size``, each an intent of its own, with a look at the budget between them; the first
        slice is taken even if the budget is spent. What an earlier run left pending is finished before.
        """
        self.replay()
        todo = self.chats.select(F.col("id").alias("chat_id")).join(self.marked(recipe), "chat_id", "left_anti").orderBy("chat_id").limit(limit)
        ids = [r.chat_id for r in todo.collect()]
        done = 0
        for at in (budget or Budget(None)).over(range(0, len(ids), size), at_least=1):
            part = ids[at : at + size]
            self.apply(self.declare(recut=self.spark.createDataFrame([(i,) for i in part], "chat_id long"), recipe=recipe))
            done += len(part)
        return done

    def tidy(self) -> None:
        """Drop finished intents that mark no chat as cut by a recipe."""
        for n in finished(self.spark, self.folder)[:-1]:
            if n not in self.pending() and self.intent(n).where("what = 'recut'").isEmpty():
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
