"""Documents in stored blocks, and questions that blocks put to partitions of a corpus-wide table.

A block is some megabytes of whole rows in one binary value. An operator that must know of each key in a block
whether and where else it occurs sends each partition of the keys the block's distinct keys, and gets an answer for
them; so a key's share of any task is at most one entry for each block. Blocks and partitions grow with the root of
the text's size above ``ROOT_FROM``: a question then keeps its length, though all blocks ask all partitions, and a
task's memory grows with that root. Where answers meet their blocks, the compressed blocks are shuffled once, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialise, slices

#: Bytes of text in a block, and of all text for each partition of keys.
BLOCK_BYTES = 6 << 20
PARTITION_BYTES = 4 << 20
#: Bytes of all text above which both grow with the root.
ROOT_FROM = 64 << 30


def grown(size: int, total: int) -> int:
    """``size``, times the root of how many times ``ROOT_FROM`` the text is, if it is more."""
    return int(size * max(1.0, total / ROOT_FROM) ** 0.5)


def store_blocks(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(block, size, data), written: ``docs`` in order as Arrow data, blocks numbered in the order of the rows; and the text's size."""
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    limit = grown(BLOCK_BYTES, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "data"])

        for batch in slices(batches, text):
            held.append(batch)
            size += int(pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0)
            if size >= limit:
                yield block()
                number, held, size = number + 1, [], 0
        if any(b.num_rows for b in held):
            yield block()

    return materialise(docs.mapInArrow(run, "block long, size long, data binary"), "blocks"), total


def load_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def key_partitions(size: int) -> int:
    """How many partitions the keys go to; follows the size of the text."""
    return max(64, size // grown(PARTITION_BYTES, size))


def meet(told: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, kind, p, data): every block's answers by partition (kind 0), and last the block itself (kind 1)."""
    answers = told.select("block", F.lit(0).alias("kind"), "p", F.col("answer").alias("data"))
    own = blocks.select("block", F.lit(1).alias("kind"), F.lit(0).alias("p"), "data")
    return answers.unionByName(own).repartition("block").sortWithinPartitions("block", "kind", "p")


def with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[tuple[int, bytes]]]]:
    """Each block of ``meet`` with its (partition, answer) pairs."""
    answers: list[tuple[int, bytes]] = []
    for batch in batches:
        for i in range(batch.num_rows):
            block, kind, p, data = (c[i].as_py() for c in batch.columns)
            if kind:
                yield block, load_block(data), answers
                answers = []
            else:
                answers.append((p, data))


def spread(keys: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each 64-bit key (its high bits decide)."""
    return ((keys >> np.uint64(20)) % np.uint64(partitions)).astype(np.int64)


def runs_of(at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    if len(at) == 0:
        return
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist()
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        yield int(at[a]), a, b
