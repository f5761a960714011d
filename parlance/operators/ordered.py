"""Order within busy keys: as-of look-ups and numbers, by slices, so that no key is sorted by a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.storage import checkpointed, shuffled

#: Values of the ordering column that share a slice.
SLICE = 10_000


def _sliced(rows: DataFrame, keys: list[str], at: str, step: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with their keys as strings (null as none) and the slice of ``at``; and the names of those keys."""
    own = [f"_k{i}" for i in range(len(keys))]
    return rows.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, own, strict=True)], F.floor(F.col(at) / step).alias("_slice")), own


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, step: int = SLICE) -> DataFrame:
    """``points`` with the ``value`` of the mark that is last at or before each by ``at``, within equal keys (null equals null).

    Of marks at one place the greatest value counts. Both sides are sorted slice by slice into one sequence; the last
    mark before a slice is carried over by one row for each slice. No pairs are made.
    """
    shown = points.columns
    mark = F.struct(F.col(at).alias("a"), F.col(value).alias("v"))
    null = F.lit(None)
    ask = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), null.cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("_mark"), F.struct(*shown).alias("_row"))
    told = marks.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), mark.alias("_mark"), null.cast(points.select(F.struct(*shown).alias("r")).schema["r"].dataType).alias("_row"))
    both, own = _sliced(ask.unionByName(told), keys, "_at", step)
    inside = Window.partitionBy(*own, "_slice").orderBy("_at", "_side", "_mark")
    tops = both.groupBy(*own, "_slice").agg(F.max("_mark").alias("_top"))
    before = Window.partitionBy(*own).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*own, "_slice", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    found = both.withColumn("_near", F.last("_mark", ignorenulls=True).over(inside)).where("_side = 1").join(shuffled(carried), [*own, "_slice"])
    return found.select("_row.*", F.coalesce("_near", "_carry")["v"].alias(value))


def numbered(rows: DataFrame, keys: list[str], at: str, name: str, ties: list[Column] | None = None, step: int = SLICE) -> DataFrame:
    """``rows`` with ``name``: their places from 1 by ``at`` (then ``ties``) within equal keys, without gaps."""
    cut, own = _sliced(rows, keys, at, step)
    before = Window.partitionBy(*own).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(*own, "_slice").agg(F.count("*").alias("_n")).select(*own, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(*own, "_slice").orderBy(at, *(ties or [])))
    return cut.withColumn("_place", place).join(shuffled(ahead), [*own, "_slice"]).select(*rows.columns, (F.col("_ahead") + F.col("_place")).alias(name))


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their places from 1 by ``order`` over all rows, which are sorted by ranges in many tasks."""
    own = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    ahead = own.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return own.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(ahead), "_part").select(*rows.columns, place.cast("int").alias(name))
