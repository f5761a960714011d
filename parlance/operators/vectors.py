"""Stored vectors of units, embedded slice by slice under a budget.

Under a budget a slice is written as a folder of its own and counts once it is finished, so that a run which stops
anywhere goes on where it stopped. Without one, slices are written in rounds, each a folder named after its last slice
and twice as long as the round before: a run that stops loses no more than about what it had done, and jobs grow with
the logarithm of the slices. A unit's id follows from its content: what has an id among the slices needs no embedding again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.budget import Budget
from parlance.operators.dense import EMBEDDERS, embed, usable
from parlance.operators.ordered import placed
from parlance.storage import finished, spread

VECTORS = "unit_id long, chat_id long, date_start long, embedding array<float>, model string, slice long, run int"
#: Units of a slice.
SLICE = 256


def _rounds(slices: int, growing: bool) -> Iterator[tuple[int, int]]:
    """From which slice to which each round goes: one after the other, or twice as many each time."""
    a, n = 0, 1
    while a < slices:
        b = min(a + n, slices)
        yield a, b
        a, n = b, 2 * n if growing else 1


class VectorLog:
    """Vectors in a folder that driver and executors share, of one embedder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        """All units that were embedded; those whose vector is zero have none."""
        paths = [f"{self.folder}/slices/{n}" for n in finished(self.spark, f"{self.folder}/slices")]
        reader = self.spark.read.schema(VECTORS)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], VECTORS)

    def vectors(self, units: DataFrame) -> DataFrame:
        """(unit_id, chat_id, date_start, embedding) of the units that are there now."""
        return self.rows().where("embedding is not null").join(units.select("unit_id"), "unit_id", "left_semi").select("unit_id", "chat_id", "date_start", "embedding")

    def _check(self, name: str) -> None:
        other = self.rows().where(F.col("model") != name).select("model").head()
        if other:
            raise ValueError(f"the folder holds vectors of {other[0]}, not of {name}: embed into another")

    def embed(self, units: DataFrame, name: str = "hashed", size: int = SLICE, budget: Budget | None = None) -> int:
        """Embed units (unit_id, chat_id, date_start, text) that have no vector, in order of id; how many were embedded.

        The budget is looked at between slices. What is left is written once, in order, and a round of slices (of one, where
        there is a budget) reads its own rows.
        """
        if name not in EMBEDDERS:
            raise KeyError(f"no embedder named {name}")
        if size <= 0:
            raise ValueError(f"a slice has a unit at least, not {size}")
        self._check(name)
        done = finished(self.spark, f"{self.folder}/slices")
        runs = finished(self.spark, f"{self.folder}/queue")
        first, run = (done[-1] + 1 if done else 0), (runs[-1] + 1 if runs else 1)
        todo = units.select("unit_id", "chat_id", "date_start", "text").dropDuplicates(["unit_id"]).join(self.rows().select("unit_id"), "unit_id", "left_anti")
        queue = f"{self.folder}/queue/{run}"
        placed(todo, [F.col("unit_id")], "place").write.mode("overwrite").parquet(queue)
        rows = self.spark.read.parquet(queue)
        count = rows.agg(F.max("place")).head()[0] or 0
        embedded = 0
        for a, b in (budget or Budget(None)).over(_rounds(-(-count // size), budget is None)):
            part = spread(rows.where(F.col("place").between(a * size + 1, b * size)))
            made = part.select("unit_id", "chat_id", "date_start", "place", embed(F.col("text"), name).alias("embedding"))
            kept = F.when(usable(F.col("embedding")), F.col("embedding"))
            number = F.lit(first) + F.floor((F.col("place") - 1) / size)
            told = made.select("unit_id", "chat_id", "date_start", kept.alias("embedding"), F.lit(name).alias("model"), number.cast("long").alias("slice"), F.lit(run).alias("run"))
            told.write.mode("overwrite").parquet(f"{self.folder}/slices/{first + b - 1}")
            embedded += min(b * size, count) - a * size
        return embedded
