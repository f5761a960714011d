"""Chat exports: JSON of an account or of one chat, as chats and messages; and their import beside live chats.

A file is read by one task, which hands on a row for each message; everything after that is columns. ``large_export``
reads one file by many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import links as ln
from parlance.functions import text as tx
from parlance.schema import CHATS, DEFAULT_ACCOUNT, IMPORT_PREFIX, MESSAGES, conform
from parlance.storage import checkpointed, upsert_chats

# Files of an export, chat types, media types and run types.
FILES = ("result.json", "messages.json")
CHAT_TYPES = {
    "personal_chat": "user", "saved_messages": "user", "bot_chat": "bot", "private_group": "group", "private_supergroup": "supergroup",
    "public_supergroup": "supergroup", "private_channel": "channel", "public_channel": "channel",
}
MEDIA_TYPES = {"sticker": "sticker", "animation": "video", "video_file": "video", "video_message": "video_note", "voice_message": "voice", "audio_file": "audio"}
LINK_RUNS = {"link": "link", "text_link": "text_url", "mention": "mention", "mention_name": "mention"}
#: Seconds that a date of the years 1 to 9999 has.
DATES = (-62_135_596_800, 253_402_300_799)

_RUN = "struct<type:string,text:string,href:string,user_id:long>"
_MESSAGE = (
    f"keys array<string>, type string, id long, date string, date_unixtime string, edited string, edited_unixtime string, sender string, from_id string, text string, entities array<{_RUN}>, runs array<{_RUN}>, "
    "reply_to_message_id long, reply_to_peer_id string, file string, file_name string, media_type string, question string, answers array<string>, first_name string, last_name string, "
    "place_name string, address string, counts array<long>, forwarded_from string, forwarded_from_id string"
)
ENTRIES = "file string, chat_id long, chat_type string, title string, body string, note string"


class ExportError(ValueError):
    """A path that holds no export."""


class ImportConflict(ValueError):
    """An import over a chat that is read live."""


def recover(text: str) -> str | None:
    """A cut JSON text up to the last closer that leaves something open, closed; null if nothing can be read. One pass."""
    open_: list[str] = []
    end, still = 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[][{}]', text, re.DOTALL):
        c = m[0]
        if c in "[{":
            open_.append("]" if c == "[" else "}")
        elif c in "]}":
            if not open_ or open_.pop() != c:
                return None
            if open_:
                end, still = m.end(), len(open_)
                closers = "".join(reversed(open_[:still]))
    return text[:end] + closers if end else None


def _loads(text: str) -> tuple[object, bool]:
    try:
        return json.loads(text), False
    except ValueError:
        closed = recover(text)
        if closed is None:
            raise
        return json.loads(closed), True


def _plain(m: dict) -> dict:
    """A message of an export with its fields of several shapes brought to one each."""
    word = lambda v: v if isinstance(v, str) else None
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63 else None
    either = lambda v: word(v) if not isinstance(v, int) or isinstance(v, bool) else str(v)

    def runs(value: object) -> list | None:
        if not isinstance(value, list):
            return None
        return [{"type": "plain", "text": r} if isinstance(r, str) else {"type": word(r.get("type")), "text": word(r.get("text")), "href": word(r.get("href")), "user_id": whole(r.get("user_id"))} for r in value if isinstance(r, str | dict)]

    part = lambda k: m[k] if isinstance(m.get(k), dict) else {}
    answers = part("poll").get("answers")
    return {
        "keys": list(m), "type": word(m.get("type")), "id": whole(m.get("id")), "sender": word(m.get("from")), "text": word(m.get("text")), "entities": runs(m.get("text_entities")), "runs": runs(m.get("text")),
        **{k: either(m.get(k)) for k in ("date", "date_unixtime", "edited", "edited_unixtime", "from_id", "reply_to_peer_id", "forwarded_from_id", "place_name", "address")},
        "reply_to_message_id": whole(m.get("reply_to_message_id")), **{k: word(m.get(k)) for k in ("file", "file_name", "media_type", "forwarded_from")},
        "question": either(part("poll").get("question")), "answers": [either(a.get("text")) for a in answers if isinstance(a, dict)] if isinstance(answers, list) else None,
        **{k: either(part("contact_information").get(k)) for k in ("first_name", "last_name")},
        "counts": [whole(r.get("count")) or 0 for r in m["reactions"] if isinstance(r, dict)] if isinstance(m.get("reactions"), list) else None,
    }


def _entries(name: str, text: str, marks: bool = False) -> Iterator[tuple]:
    """(file, chat_id, chat_type, title, body, note) rows: of each chat, of each of its messages, and of each problem.

    With ``marks`` a message may stand as ``{"@": [...]}``, whose list is then its body (see ``large_export``).
    """
    note = lambda what, chat=(None, None, None): (name, *chat, None, what)
    try:
        data, cut = _loads(text)
    except ValueError:
        yield note("the file is no JSON")
        return
    if cut:
        yield note("the file is cut short")
    if not isinstance(data, dict):
        yield note("the file holds no object")
        return
    listed = data.get("chats")
    if isinstance(listed, dict):
        chats = listed.get("list")
        if not isinstance(chats, list):
            yield note("the file holds no chat list")
            return
    elif isinstance(data.get("messages"), list) or isinstance(data.get("type"), str):
        chats = [data]
    else:
        yield note("the file names neither chats nor messages")
        return
    for chat in chats:
        if not isinstance(chat, dict):
            yield note("a chat is no object")
            continue
        raw, title = chat.get("id"), chat.get("name")
        title = title.strip() or None if isinstance(title, str) else None
        kind = CHAT_TYPES.get(str(chat.get("type")))
        if kind is None or not isinstance(raw, int) or isinstance(raw, bool):
            yield note("a chat of an unknown type" if kind is None else "a chat without an id", (None, None, title))
            continue
        head = (raw, kind, title)
        yield (name, *head, None, None)
        messages = chat.get("messages")
        if messages is not None and not isinstance(messages, list):
            yield note("a message list that is none", head)
            continue
        for m in messages or ():
            if marks and isinstance(m, dict) and isinstance(m.get("@"), list):
                yield (name, *head, m["@"], None)
            elif isinstance(m, dict):
                yield (name, *head, json.dumps(_plain(m)), None)
            else:
                yield note("a message is no object", head)


def find_export(spark: SparkSession, path: str) -> str:
    """The file to read: the path itself, or in a folder an account's export before a single chat's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(p):
        raise ExportError(f"no export at {path}")
    if files.getFileStatus(p).isFile():
        return path
    for name in FILES:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, name)):
            return f"{path.rstrip('/')}/{name}"
    raise ExportError(f"{path} holds no {' or '.join(FILES)}")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the export at ``path``, a file or a folder that holds one; a cut file is read up to the cut."""
    return entries(spark.read.text(find_export(spark, path), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def entries(files: DataFrame) -> DataFrame:
    """Entries of whole export files, (file, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ENTRIES.split(", ")]
        for part in parts:
            for name, text in zip(part["file"], part["text"], strict=True):
                rows: list[tuple] = []
                for row in _entries(name, text):
                    rows.append(row)
                    if len(rows) == 5_000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    return files.select("file", "text").mapInPandas(run, ENTRIES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"chat_id": "Int64"})


def chats(read: DataFrame) -> DataFrame:
    """Chats of entries, in the columns of ``schema.CHATS``: never asked for again, and without progress."""
    rows = read.where("chat_type is not null and body is null and note is null").select("chat_id", "chat_type", "title").dropDuplicates(["chat_id", "chat_type"])
    marked = ln.marked_id(F.col("chat_id"), F.col("chat_type"))
    own = rows.select(marked.alias("id"), marked.alias("peer_id"), F.col("chat_type").alias("type"), "title", (F.col("chat_type") == "channel").alias("is_broadcast"), F.lit(True).alias("unavailable"), F.lit(0).alias("last_msg_id"))
    return conform(own, CHATS)


def _text(m: Column) -> Column:
    flat = lambda runs: tx.filled(F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), ""))
    return F.coalesce(flat(m["entities"]), flat(m["runs"]), tx.filled(m["text"]))


def epoch(unix: Column, iso: Column) -> Column:
    """Seconds of a date pair: the number where it is one, else the ISO date, in UTC if it says nothing; null beyond the years 1 to 9999."""
    number = F.when(unix.rlike(r"^-*\d+$"), unix.try_cast("decimal(38,0)"))
    zoned = F.when(iso.rlike(r"[T ]\d\d.*([zZ]|[+-]\d\d(:?\d\d)?)$") | ~iso.rlike(r"[T ]"), iso).otherwise(F.concat(iso, F.lit("Z")))
    zoned = F.when(~iso.rlike(r"[T ]"), F.concat(iso, F.lit("T00:00:00Z"))).otherwise(zoned)
    seconds = F.when(unix.rlike(r"^-*\d+$"), number).otherwise(F.unix_seconds(zoned.try_cast("timestamp")))
    return F.when(seconds.between(*DATES), seconds.cast("long"))


def _media(m: Column) -> tuple[Column, Column]:
    has = lambda *keys: F.arrays_overlap(m["keys"], F.array(*map(F.lit, keys)))
    known = F.element_at(F.create_map(*[F.lit(x) for p in MEDIA_TYPES.items() for x in p]), m["media_type"])
    kind = F.when(has("photo"), "photo").when(has("poll"), "poll").when(has("contact_information", "contact_vcard"), "contact").when(has("location_information", "place_name"), "location")
    kind = kind.when(has("file", "media_type", "mime_type"), F.coalesce(known, F.lit("document")))
    name = F.coalesce(tx.filled(tx.stripped(m["file_name"])), tx.filled(F.when(m["file"].contains("/"), F.element_at(F.split(m["file"], "/"), -1))))
    return kind, F.when(kind.isin("photo", "poll", "contact", "location"), None).otherwise(name)


def _media_text(m: Column) -> Column:
    poll = F.concat_ws("\n", tx.filled(m["question"]), F.filter(m["answers"], lambda a: a.isNotNull() & (a != "")))
    place = F.concat_ws("\n", tx.filled(m["place_name"]), tx.filled(m["address"]))
    contact = F.concat_ws(" ", tx.filled(m["first_name"]), tx.filled(m["last_name"]))
    return F.when(F.array_contains(m["keys"], "poll"), poll).when(place != "", place).otherwise(contact)


def _links(m: Column) -> Column:
    kind = lambda r: F.element_at(F.create_map(*[F.lit(x) for p in LINK_RUNS.items() for x in p]), r["type"])
    value = lambda r: F.when(r["type"] == "text_link", r["href"]).when(r["type"] == "mention_name", F.concat(F.lit("peer:"), r["user_id"].cast("string"))).otherwise(r["text"])
    named = F.filter(F.coalesce(m["entities"], m["runs"]), lambda r: r["type"].isin(*LINK_RUNS))
    found = F.transform(named, lambda r: F.struct(kind(r).alias("kind"), ln.identity(value(r)).alias("target")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x["target"].isNotNull())))


def _parsed(read: DataFrame) -> DataFrame:
    return read.where("body is not null").select(F.col("chat_id").alias("_raw"), F.col("chat_type").alias("_type"), F.from_json("body", _MESSAGE).alias("m"))


def _problem(m: Column) -> Column:
    """Why a message is not stored; null if it is."""
    return F.when(m["type"] == "service", "service").when(m["type"].isNull() | (m["type"] != "message"), "unknown type").when(m["id"].isNull(), "no id").when(epoch(m["date_unixtime"], m["date"]).isNull(), "no date")


def messages(read: DataFrame) -> DataFrame:
    """Messages of entries, in the columns of ``schema.MESSAGES``: of type message, with an id and a date."""
    m = F.col("m")
    kind, name = _media(m)
    rows = _parsed(read).where(_problem(m).isNull()).withColumn("chat_id", ln.marked_id(F.col("_raw"), F.col("_type")))
    title = lambda c: tx.filled(tx.stripped(c))
    sent = F.array_contains(m["keys"], "forwarded_from")
    links = _links(m)
    out = {
        "chat_id": F.col("chat_id"), "msg_id": m["id"], "date": epoch(m["date_unixtime"], m["date"]), "edit_date": epoch(m["edited_unixtime"], m["edited"]), "from_id": ln.peer_ref(m["from_id"]), "from_name": title(m["sender"]),
        "reply_to_msg_id": F.when(m["reply_to_peer_id"].isNull() | (ln.peer_ref(m["reply_to_peer_id"]) == F.col("chat_id")), m["reply_to_message_id"]),
        "text": F.coalesce(_text(m), _media_text(m), F.lit("")), "media_kind": kind, "media_filename": name, "media_state": F.lit(0),
        "reactions": F.coalesce(F.aggregate(m["counts"], F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r, F.lit(0))), F.lit(0)),
        "fwd_from_id": F.when(sent, ln.peer_ref(m["forwarded_from_id"])), "fwd_from_name": F.when(sent, F.coalesce(title(m["forwarded_from"]), F.lit("unknown"))), "links": links, "links_read": links.isNotNull(), "indexed": F.lit(False),
    }
    fields = T.StructType.fromDDL(MESSAGES).fields
    return rows.select(*[out.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def report(read: DataFrame) -> DataFrame:
    """(reason, n): what is not stored, by reason."""
    told = read.where("note is not null").select(F.col("note").alias("reason"))
    rows = _parsed(read).select(_problem(F.col("m")).alias("reason")).where("reason is not null")
    return told.unionByName(rows).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------- import


def import_ids(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(scope, peer_id, source_id): the ``import:`` source of each chat, after its title, or its id where that gives nothing.

    Chats whose titles clash, in this export or with a stored import, carry their id as well, again if still taken.
    """
    number = F.abs("id").cast("string")
    slug = F.coalesce(tx.filled(tx.slug(F.col("title"))), F.concat(F.lit("chat-"), number))
    held = stored.where(F.col("source_id").startswith(IMPORT_PREFIX)).select("source_id", F.col("scope").alias("_scope"), F.col("peer_id").alias("_peer"))
    rows = fresh.select("id", "scope", "peer_id", F.concat(F.lit(IMPORT_PREFIX), slug).alias("source_id"))
    same = Window.partitionBy("source_id")
    alone = F.count("*").over(same) == 1
    first = F.row_number().over(same.orderBy("id")) == 1
    for free in (alone, first, first, first):  # of equal slugs all are changed; later on only those that come too late
        other = held.join(rows.select("source_id", "scope", "peer_id"), "source_id").where(~((F.col("_scope") == F.col("scope")) & (F.col("_peer") == F.col("peer_id")))).select("source_id", F.lit(True).alias("_other")).distinct()
        taken = rows.withColumn("_free", free).join(other, "source_id", "left").withColumn("_ok", F.col("_free") & F.col("_other").isNull())
        rows = checkpointed(taken.select("id", "scope", "peer_id", F.when(F.col("_ok"), F.col("source_id")).otherwise(F.concat("source_id", F.lit("-"), F.abs("id").cast("string"))).alias("source_id")))
    return rows.select("scope", "peer_id", "source_id")


def import_chats(stored: DataFrame, fresh: DataFrame, found: DataFrame, account: str = DEFAULT_ACCOUNT) -> tuple[DataFrame, DataFrame]:
    """(chats, messages): all chats after an account's export was imported, and its messages under their chats' ids.

    Refused as a whole where a chat of the export is read live. Importing again gives the same ids.
    """
    stored = conform(stored, CHATS)
    fresh = fresh.withColumn("scope", ln.scope(F.col("type"), F.lit(account)))
    keys = ["scope", "peer_id"]
    live = stored.join(fresh.select(*keys), keys, "left_semi").where(~F.coalesce(F.col("source_id").startswith(IMPORT_PREFIX), F.lit(False)))
    clash = live.head()
    if clash:
        raise ImportConflict(f"{clash.title or clash.type} (id {clash.id}) is read live through {clash.source_id or 'no source'}; remove that source first")
    tagged = fresh.drop("source_id").join(import_ids(fresh, stored), keys)
    every = checkpointed(upsert_chats(stored, checkpointed(tagged), account))
    ids = every.join(fresh.select(*keys, F.col("id").alias("_was")), keys).select(F.col("_was").alias("chat_id"), F.col("id").alias("_now"))
    return every, found.join(ids, "chat_id").withColumn("chat_id", F.col("_now")).select(*found.columns)
