"""A large export read by many tasks: byte ranges of one JSON file, cut into messages wherever a range begins.

Spark's text reader deals out a file in ranges that end at commas. A range alone can't know whether it begins within a
string, nor how deep; so it is scanned for either case, and tells which brackets it closes and leaves open. From these,
range by range, follows where each begins. Then every range is cut into its messages, which go their own ways, and a
skeleton: the file with a mark for each run of messages. The skeletons of all ranges, a small part of the file, are
one JSON text that says whose the runs are. A message that crosses ranges is put together from its pieces.

Defined results: as of ``export.entries``, and in any order. A file that was cut is read up to the cut. A message that
is no JSON in itself gives a note, and the others of its file are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources.export import ENTRIES, _entries, _plain, find_export
from parlance.storage import checkpointed

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\\?$)|[][{}]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*("|\\?$)', re.DOTALL)
_OPEN = {"]": "[", "}": "{"}
#: How deep the messages of an account's export and of a single chat's lie.
ACCOUNT_DEPTH, CHAT_DEPTH = 6, 3
_PIECES = "file string, block long, n long, seq long, text string"


def _tokens(text: str, inside: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(first character, start, end, whether a string is left open) of strings and brackets; a text may begin inside a string."""
    at = 0
    if inside:
        m = _REST.match(text)
        at = m.end()
        yield '"', 0, at, m[1] != '"'
    for m in _TOKEN.finditer(text, at):
        yield m[0][0], m.start(), m.end(), m[1] is not None and m[1] != '"'


class Shape:
    """What a range does to where it begins: how many brackets it closes, those it leaves open, and whether a string is."""

    def __init__(self, inside: bool):
        self.inside, self.closed, self.open = inside, 0, []

    def feed(self, text: str) -> None:
        for c, _, _, left in _tokens(text, self.inside):
            if c == '"':
                self.inside = left
            elif c in "[{":
                self.open.append(c)
            elif self.open:
                self.open.pop()
            else:
                self.closed += 1


#: What stands for seq: a message that began in a range before and ends here; and a piece of one that goes on.
ENDS, GOES_ON = -1, -2


class Cutter:
    """Cuts a range, which begins with these brackets open, into messages and the skeleton around them."""

    def __init__(self, block: int, stack: str, inside: bool, depth: int):
        self.block, self.stack, self.inside, self.depth = int(block), list(stack), inside, depth
        self.message = len(stack) >= depth and stack[depth - 1] == "{"
        self.here, self.between, self.seq, self.run, self.held = False, "", -1, None, []
        self.skeleton: list[str] = []

    def _mark(self) -> None:
        if self.run:
            self.skeleton.append(json.dumps({"@": [self.block, *self.run]}))
        self.run = None

    def _ended(self) -> int:
        """Set a mark for the message that ends, in one with those before it where only commas are between; its seq."""
        if not self.here:
            self.skeleton.append(json.dumps({"@": [self.block, ENDS, 1]}))
            return ENDS
        self.seq += 1
        if self.run and not self.between.strip(" \t\r\n,"):
            self.run[1] += 1
        else:
            self._mark()
            self.skeleton.append(self.between)
            self.run = [self.seq, 1]
        return self.seq

    def feed(self, text: str) -> Iterator[tuple[int, str]]:
        """(seq, text) of the messages that end here."""
        start = 0
        for c, a, b, left in _tokens(text, self.inside):
            if c == '"':
                self.inside = left
            elif c in "[{":
                self.stack.append(c)
                if c == "{" and len(self.stack) == self.depth and not self.message:
                    self.between, start, self.message, self.here = text[start:a], a, True, True
            else:
                if self.message and len(self.stack) == self.depth:
                    yield self._ended(), "".join(self.held) + text[start:b]
                    self.held, start, self.message = [], b, False
                if self.stack:
                    self.stack.pop()
        if self.message:
            self.held.append(text[start:])
        elif text[start:]:
            self._mark()
            self.skeleton.append(text[start:])

    def end(self) -> Iterator[tuple[int | None, str]]:
        """The piece of a message that goes on in the next range, and the skeleton."""
        self._mark()
        if self.message:
            self.skeleton.append(self.between if self.here else "")
            yield GOES_ON, "".join(self.held)
        yield None, "".join(self.skeleton)


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text) in the order of the file within a task: what lies between commas."""
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _by_range(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str | None]]:
    """(file, range, text) with bounded texts; None after the last of a range."""
    now = None
    for part in parts:
        for key, rows in part.groupby(["file", "block"], sort=False):
            if now is not None and key != now:
                yield (*now, None)
            now = key
            yield (*key, ",".join(rows["text"]) + ",")
    if now is not None:
        yield (*now, None)


def _shapes(ranges: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = None
        for file, block, text in _by_range(parts):
            if text is None:
                yield pd.DataFrame([(file, block, s == 1, x.inside, x.closed, "".join(x.open)) for s, x in enumerate(both)], columns=["file", "block", "inside", "after", "closed", "open"])
                both = None
                continue
            both = both or (Shape(False), Shape(True))
            for x in both:
                x.feed(text)

    return ranges.mapInPandas(run, "file string, block long, inside boolean, after boolean, closed long, open string")


def _begins(shapes: DataFrame) -> DataFrame:
    """(file, block, inside, stack): where each range begins; two rows for each range go to a file's task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, stack, inside = [], "", False
        for (file, block), both in rows.sort_values("block").groupby(["file", "block"], sort=False):
            out.append((file, block, inside, stack))
            own = both[both["inside"] == inside].iloc[0]
            stack = stack[: max(0, len(stack) - int(own["closed"]))] + own["open"]
            inside = bool(own["after"])
        return pd.DataFrame(out, columns=["file", "block", "inside", "stack"])

    return shapes.groupBy("file").applyInPandas(run, "file string, block long, inside boolean, stack string")


def _depth(head: str) -> int:
    """How deep messages lie in a file that begins like this."""
    stack, key = 0, None
    for c, a, b, left in _tokens(head, False):
        if c == '"' and not left and stack == 1:
            key = head[a:b]
        elif c in "[{":
            if stack == 1 and key == '"messages"' and c == "[":
                return CHAT_DEPTH
            stack += 1
        elif c in "]}":
            stack -= 1
    return ACCOUNT_DEPTH


def _cut(ranges: DataFrame, begins: DataFrame) -> DataFrame:
    """Messages and pieces of messages, and skeletons (seq is null), as ``_PIECES``."""
    shared = ranges.sparkSession.sparkContext.broadcast({(r.file, r.block): (r.inside, r.stack, r.depth) for r in begins.collect()})  # a row for each range of bytes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, n = None, 0

        def frame(file: str, block: int, found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(file, block, n, *f) for f in found], columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"seq": "Int64"})

        for file, block, text in _by_range(parts):
            if cutter is None:
                inside, stack, depth = shared.value[file, block]
                cutter, n = Cutter(block, stack, inside, depth), 0
            if text is None:
                yield frame(file, block, list(cutter.end()))
                cutter = None
            else:
                yield frame(file, block, list(cutter.feed(text)))
                n += 1

    return ranges.mapInPandas(run, _PIECES)


def _homes(pieces: DataFrame) -> DataFrame:
    """Pieces of messages that cross ranges, with ``home``: the range where each ends, null if the file was cut before."""
    ends = pieces.groupBy("file", "block").agg(F.max(F.when(F.col("seq") == ENDS, F.col("block"))).alias("end"))  # a row for each range
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    nxt = ends.select("file", "block", F.first("end", ignorenulls=True).over(after).alias("next"))
    return pieces.where(F.col("seq") < 0).join(nxt, ["file", "block"]).withColumn("home", F.when(F.col("seq") == ENDS, F.col("block")).otherwise(F.col("next")))


def _whole_messages(pieces: DataFrame) -> DataFrame:
    """(file, block, seq, text): those that lie in one range, and those put together."""
    # the piece that ends comes first in its range, and one that goes on from there is another message's
    joined = _homes(pieces).where("home is not null").groupBy("file", "home").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("ps"))
    put = joined.select("file", F.col("home").alias("block"), F.lit(ENDS).cast("long").alias("seq"), F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("text"))
    return pieces.where(F.col("seq") >= 0).select("file", "block", "seq", "text").unionByName(put)


_RUNS = f"{ENTRIES}, block long, first long, count long"


def _owners(pieces: DataFrame) -> DataFrame:
    """Entries of the skeletons, a message that a cut left unended among them; and of each run of messages, whose it is."""
    rest = _homes(pieces).where("home is null").select("file", F.lit(1).alias("last"), "block", "text")
    parts = pieces.where("seq is null").select("file", F.lit(0).alias("last"), "block", "text").unionByName(rest)
    one = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("last", "block", "text"))).alias("ts"))
    texts = one.select("file", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, text in zip(part["file"], part["text"], strict=True):
                for row in _entries(file, text.removesuffix(","), marks=True):
                    mark = row[4] if isinstance(row[4], list) else (None, None, None)
                    rows.append((*row[:4], None if isinstance(row[4], list) else row[4], row[5], *mark))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RUNS.split(", ")]).astype({c: "Int64" for c in ("chat_id", "block", "first", "count")})

    return texts.mapInPandas(run, _RUNS)


def _parsed(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bodies, notes = [], []
            for text in part["text"]:
                try:
                    bodies.append(json.dumps(_plain(json.loads(text))))
                    notes.append(None)
                except ValueError:
                    bodies.append(None)
                    notes.append("a message is no JSON")
            yield part[["file", "chat_id", "chat_type", "title"]].assign(body=bodies, note=notes)

    return rows.select("file", "chat_id", "chat_type", "title", "text").mapInPandas(run, ENTRIES)


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the export at ``path``, in the columns of ``export.ENTRIES``, each file read by as many tasks as it has ranges."""
    ranges = _ranges(spark, find_export(spark, path))
    begins = checkpointed(_begins(_shapes(ranges)))
    pieces = checkpointed(_cut(ranges, begins.join(_heads(ranges), "file")))
    owners = checkpointed(_owners(pieces))
    bodies = _whole_messages(pieces)
    runs = owners.where("block is not null").select("file", "chat_id", "chat_type", "title", "block", "first", "count")
    mine = bodies.join(runs, ["file", "block"]).where("seq >= first and seq < first + count")
    return owners.where("block is null").select(*[c.split()[0] for c in ENTRIES.split(", ")]).unionByName(_parsed(mine))


def _heads(ranges: DataFrame) -> DataFrame:
    """(file, depth): how deep each file's messages lie, as its first range tells."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: dict[str, list[str]] = {}
        for file, block, text in _by_range(parts):
            if block == 0 and text is not None:
                head.setdefault(file, []).append(text)
        yield pd.DataFrame([(f, _depth("".join(t))) for f, t in head.items()], columns=["file", "depth"])

    return ranges.mapInPandas(run, "file string, depth int")
