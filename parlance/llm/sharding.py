"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Every node of the tree holds a range of shards. Its rows are split where the weight (bytes) divides as its shards
do, along the dimension with the widest spread of the node's rows; rows that tie there are split by a hash of the row.
A median is found by histograms: each round counts weights in 256 cells of the range at hand for all nodes at
once, and goes on in the cell that holds the median, until that cell is one value or weighs next to nothing. The
driver sees one row for each node; only metadata is shuffled, never text.

Defined results: a null dimension counts as the least value; a null text weighs 1 (its separator) like an empty
one; equal rows are told apart by their row number, so ties and copies are split evenly; an empty table gives no
shard rows; a table with fewer rows than shards leaves some shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import discard, gapless, materialise

#: Cells of a histogram round.
CELLS = 256
#: A median's cell of less than this part of a shard's weight goes to one side whole.
TOLERANCE = 1e-3

_SPLIT = "node long, wide int, phase int, lo double, hi double, at double, below double, want double"
_CUT = "node long, wide int, cut double, tie double, right long"


def kd_tree_shards(rows: DataFrame, dimensions: list[str], weight: str = "size", target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """``rows`` (a written table with a unique ``rid``) plus ``shard`` from 0 on.

    Splits until a leaf reaches ``target_bytes``, or into a given number of shards of equal weight.
    """
    spark = rows.sparkSession
    total, *ends = rows.agg(F.sum(weight), *[f(d) for d in dimensions for f in (F.min, F.max)]).head()
    if total is None:
        return rows.withColumn("shard", F.lit(0))
    count = shards or max(1, math.ceil(total / target_bytes))
    scaled: list[Column] = []
    for d, lo, hi in zip(dimensions, ends[::2], ends[1::2], strict=True):  # to 0..1, null as the least
        scaled.append(F.coalesce((F.col(d) - F.lit(lo)) / F.lit(float(hi - lo) or 1.0), F.lit(0.0)) if lo is not None else F.lit(0.0))
    tie = F.shiftrightunsigned(F.xxhash64("rid"), 11).cast("double")
    points = rows.select("rid", F.col(weight).cast("double").alias("w"), F.array(*scaled).alias("x"), tie.alias("tie"), F.shiftrightunsigned("rid", 63).alias("node"))  # 0; a literal would make the joins below nested loops
    nodes, tables = {0: (count, float(total))}, []
    while any(n > 1 for n, _ in nodes.values()):
        cuts, nodes = _split(points, nodes, len(dimensions), TOLERANCE * total / count)
        cut = F.broadcast(spark.createDataFrame(cuts, _CUT))  # one row for each inner node of this level
        value = F.element_at("x", F.col("wide") + 1)
        right = (value > F.col("cut")) | ((value == F.col("cut")) & (F.col("tie") > F.col("t")))
        points = points.join(cut.withColumnRenamed("tie", "t"), "node", "left").withColumn("node", F.when(right, F.col("right")).otherwise(F.col("node"))).select("rid", "w", "x", "tie", "node")
        points = materialise(points, "kd")
        tables.append(points)
    placed = rows.join(points.select("rid", F.col("node").cast("int").alias("shard")), "rid")
    discard(*tables[:-1])
    return placed


def _split(points: DataFrame, nodes: dict[int, tuple[int, float]], dims: int, slack: float) -> tuple[list[tuple], dict[int, tuple[int, float]]]:
    """The cuts of one level and the nodes below. A node is known by its first shard."""
    spark = points.sparkSession
    spread = points.groupBy("node").agg(F.sum("w").alias("w"), F.array(*[F.max(F.col("x")[i]) - F.min(F.col("x")[i]) for i in range(dims)]).alias("spread"))
    open_, done, below = {}, {}, {}
    for r in spread.collect():
        n = nodes[r.node][0]
        if n > 1:
            wide = max(range(dims), key=lambda i: r.spread[i])
            open_[r.node] = (r.node, wide, 0, -1.0, 2.0, 0.0, 0.0, r.w * (n // 2) / n)
            below[r.node] = r.w
    while open_:
        ask = F.broadcast(spark.createDataFrame(list(open_.values()), _SPLIT))
        value = F.element_at("x", F.col("wide") + 1)
        look = F.when(F.col("phase") == 0, value).otherwise(F.when(value == F.col("at"), F.col("tie")))
        seen = points.join(ask, "node").withColumn("v", look).where("v between lo and hi")
        cell = F.least(F.lit(CELLS - 1), F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)).otherwise(0))
        hist = seen.groupBy("node", cell.alias("cell")).agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("below"), F.first("want").alias("want"))
        so_far = F.sum("w").over(Window.partitionBy("node").orderBy("cell")) + F.col("below")
        reached = hist.withColumn("sum", so_far).withColumn("over", F.col("sum") >= F.col("want"))
        first = Window.partitionBy("node").orderBy(F.desc("over"), F.when(F.col("over"), F.col("cell")).otherwise(-F.col("cell")))
        for r in reached.withColumn("i", F.row_number().over(first)).where("i = 1").collect():
            node, wide, phase, _, _, at, _, want = open_[r.node]
            before = r.sum - r.w
            if r.lo == r.hi and phase == 0 and r.w > slack:
                open_[r.node] = (node, wide, 1, 0.0, 2.0**53, r.lo, before, want)
            elif r.lo == r.hi or r.w <= slack:
                left = want - before >= r.w / 2
                edge = r.hi if left else math.nextafter(r.lo, -math.inf)
                done[node] = (wide, edge, math.inf) if phase == 0 else (wide, at, edge)
                del open_[node]
            else:
                open_[r.node] = (node, wide, phase, r.lo, r.hi, at, before, want)
    cuts, under = [], {}
    for node, (n, w) in nodes.items():
        if node in done:
            cuts.append((node, *done[node], node + n // 2))
            under[node], under[node + n // 2] = (n // 2, w), (n - n // 2, w)
        else:
            under[node] = (1, w)
    return cuts, under


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``docs`` dealt by bytes along doc_id, size, source and language.

    size is the text's bytes plus 1; slot numbers a shard's rows from 0 without gaps. All else stays behind.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            docs["doc_id"].alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            docs["doc_id"].cast("double").alias("d_id"),
            F.log(F.octet_length(text).cast("double") + 1).alias("d_size"),
            F.crc32(docs["source"]).cast("double").alias("d_source"),
            F.crc32(docs["lang"]).cast("double").alias("d_lang"),
        ),
        "shard-rows",
    )
    placed = kd_tree_shards(rows, ["d_id", "d_size", "d_source", "d_lang"], "size", target_bytes, shards)
    return gapless(placed.select("rid", "doc_id", "size", "text_crc32", "shard"), "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
