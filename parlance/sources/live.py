"""A live feed as a streaming source of its own: its offset is a mark for each chat, and it reads pages of ids above them.

The client that answers is a plug-in, named as ``module:function``: a function of the options that gives an object with
``chats()``, ``newest(chat)``, ``last_before(chat, date)`` and ``page(chat, after, upto)``, the rows of a chat with ids
above one and up to another. It is made anew where it is used, on the driver for offsets and in tasks for pages.

    spark.dataSource.register(ChatFeed)
    spark.readStream.format("chat_feed").option("client", "package.module:client").option("since", 1700000000).load()

Defined results: a chat that is new is read from ``since`` on, or from its beginning; after that only ids above its
mark are, whatever their date. A mark never falls. A page without rows (ids that are gone) is an answer like any other.

Ids are asked for in pages of ``page``. A client that can give more at once may say so by ``deal(chat, after, upto)``: the
ranges of ids that tasks are to read, or none where pages will do.
"""

from __future__ import annotations

import functools
import importlib
import io
import json
import uuid
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Ids that are asked for together.
PAGE = 500
ROWS = "chat_id long, id long, date long, text string"


class FeedClient(Protocol):
    """What answers for a feed."""

    def chats(self) -> list[int]: ...

    def newest(self, chat: int) -> int: ...

    def last_before(self, chat: int, date: int) -> int: ...

    def page(self, chat: int, after: int, upto: int) -> Iterator[tuple]: ...


def client_of(options: dict[str, str]) -> FeedClient:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Page(InputPartition):
    """Ids of a chat that one task reads."""

    def __init__(self, chat: int, after: int, upto: int):
        super().__init__((chat, after, upto))
        self.chat, self.after, self.upto = chat, after, upto


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.size = int(self.options.get("page", PAGE))
        if self.size < 1:
            raise ValueError("a page has an id at least")
        self._last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        """No mark; a chat's first mark is found when it is first read."""
        return {}

    def latestOffset(self) -> dict:
        client = client_of(self.options)
        found = {str(c): int(client.newest(c)) for c in client.chats()}
        self._last = {c: max(n, self._last.get(c, 0)) for c, n in (self._last | found).items()}
        return dict(self._last)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """Pages of ids above the marks of ``start``, up to those of ``end``."""
        client, since, out = client_of(self.options), self.options.get("since"), []
        for chat, upto in end.items():
            after = start.get(chat)
            if after is None:
                after = int(client.last_before(int(chat), int(since))) if since is not None else 0
            deal = getattr(client, "deal", None)
            ranges = deal(int(chat), after, upto) if deal and upto > after else []
            out += [Page(int(chat), a, b) for a, b in ranges or ((a, min(a + self.size, upto)) for a in range(after, upto, self.size))]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from client_of(self.options).page(partition.chat, partition.after, partition.upto)


class ChatFeed(DataSource):
    """The source ``chat_feed``; its schema is that of its client's rows, if one is not given."""

    @classmethod
    def name(cls) -> str:
        return "chat_feed"

    def schema(self) -> str:
        return self.options.get("rows", ROWS)

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)


# ------------------------------------------------------------- files as a client


#: Rows in a file that ``write_feed`` writes at most.
FILE_ROWS = 10_000


def write_feed(rows: DataFrame, folder: str) -> None:
    """Add rows (``ROWS``) to a feed's folder, as files of neighbouring ids of a chat, and a table of what ids and dates each spans.

    The files count once that table is written.
    """
    spark, part = rows.sparkSession, f"parts/{uuid.uuid4().hex}"
    placed = rows.repartitionByRange("chat_id", "id").sortWithinPartitions("chat_id", "id")
    placed.write.partitionBy("chat_id").option("maxRecordsPerFile", FILE_ROWS).json(f"{folder}/{part}")
    found = spark.read.schema(ROWS).json(f"{folder}/{part}").withColumn("path", F.regexp_extract("_metadata.file_path", f"{part}/.*$", 0))
    spans = found.groupBy("chat_id", "path").agg(F.min("id").alias("least"), F.max("id").alias("newest"), F.min("date").alias("first"), F.max("date").alias("last"))
    spans.coalesce(1).write.json(f"{folder}/{part.replace('parts', 'spans')}")


class Folder:
    """JSON lines in a folder that all machines share as a feed: a file ``7.jsonl`` or a folder ``chat_id=7`` for each chat, and what ``write_feed`` adds.

    Of the latter it is known what each file spans, so that marks are found without reading the rows, and a task reads
    each file once; files that somebody else put there are read as a whole for every answer.
    """

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(options["path"])

    def _files(self, place: str) -> list[Any]:
        from pyarrow import fs

        found = self._fs.get_file_info(fs.FileSelector(place, allow_not_found=True))
        return [f for f in found if not f.base_name.startswith(("_", "."))]

    def _lines(self, path: str) -> Iterator[dict[str, Any]]:
        with io.BufferedReader(self._fs.open_input_stream(path)) as lines:
            for line in lines:
                if line.strip():
                    yield json.loads(line)

    def _plain(self, chat: int) -> list[str]:
        """Files of a chat that are not known by their spans."""
        single = self._fs.get_file_info(f"{self._root}/{chat}.jsonl")
        return sorted(f.path for f in self._files(f"{self._root}/chat_id={chat}")) or [single.path] * single.is_file

    def _rows(self, chat: int) -> Iterator[dict[str, Any]]:
        for path in self._plain(chat):
            yield from self._lines(path)

    @functools.cached_property
    def _spans(self) -> dict[int, list[dict[str, Any]]]:
        """What ``write_feed`` tells of the files of each chat, the newest ids first."""
        out: dict[int, list[dict[str, Any]]] = {}
        for part in self._files(f"{self._root}/spans"):
            if self._fs.get_file_info(f"{part.path}/_SUCCESS").is_file:
                for f in self._files(part.path):
                    for span in self._lines(f.path):
                        out.setdefault(span["chat_id"], []).append(span)
        return {c: sorted(spans, key=lambda s: -s["newest"]) for c, spans in out.items()}

    def chats(self) -> list[int]:
        names = [f.base_name.removesuffix(".jsonl").removeprefix("chat_id=") for f in self._files(self._root)]
        return sorted({int(n) for n in names if n.lstrip("-").isdigit()} | set(self._spans))

    def newest(self, chat: int) -> int:
        return max([0, *(s["newest"] for s in self._spans.get(chat, [])[:1]), *(r["id"] for r in self._rows(chat))])

    def last_before(self, chat: int, date: int) -> int:
        best = max((r["id"] for r in self._rows(chat) if r["date"] < date), default=0)
        for s in self._spans.get(chat, []):
            if s["newest"] > best and s["first"] < date:
                older = [s["newest"]] if s["last"] < date else (r["id"] for r in self._lines(f"{self._root}/{s['path']}") if r["date"] < date)
                best = max([best, *older])
        return best

    def deal(self, chat: int, after: int, upto: int) -> list[tuple[int, int]]:
        """Ranges of ids that meet each file once: files whose ids lie among each other's are read together."""
        if self._plain(chat):
            return []
        spans = sorted((s["least"], s["newest"]) for s in self._spans.get(chat, []) if s["newest"] > after and s["least"] <= upto)
        out, top = [], after
        for k, (_, newest) in enumerate(spans):
            top = max(top, newest)
            if k + 1 == len(spans) or spans[k + 1][0] > top:
                out.append((out[-1][1] if out else after, min(top, upto)))
        return out or [(after, upto)]

    def page(self, chat: int, after: int, upto: int) -> Iterator[tuple]:
        paths = [f"{self._root}/{s['path']}" for s in self._spans.get(chat, []) if s["newest"] > after and s["least"] <= upto]
        for path in [*self._plain(chat), *paths]:
            for r in self._lines(path):
                if after < r["id"] <= upto:
                    yield chat, r["id"], r["date"], r.get("text")


def folder_client(options: dict[str, str]) -> Folder:
    return Folder(options)
