"""Hits as JSON or text, with links and snippets; statuses of sources, accounts and candidates; what may be pruned."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import links as ln
from parlance.operators import leads, rank, units


def with_links(hits: DataFrame, chats: DataFrame) -> DataFrame:
    """Hits with their chat's title and the links that open the message to show."""
    c = chats.select(F.col("id").alias("chat_id"), "title", "type", F.col("peer_id").alias("_peer"), F.col("username").alias("_name"), F.coalesce("is_forum", F.lit(False)).alias("_forum"))
    url = ln.message_url(F.col("type"), F.col("_peer"), F.col("_name"), F.col("_forum"), F.col("anchor"), F.col("topic_id"))
    joined = hits.join(c, "chat_id", "left")
    return joined.withColumn("url", url).withColumn("fallback", ln.fallback_url(F.col("type"), F.col("_peer"))).drop("_peer", "_name", "_forum")


def unit_messages(units: DataFrame, messages: DataFrame) -> DataFrame:
    """The stored messages of units in the order their texts have them, with ``unit_id`` and ``pos``."""
    listed = units.select("unit_id", "chat_id", F.posexplode("msg_ids").alias("pos", "msg_id"))
    return listed.join(messages, ["chat_id", "msg_id"])


def hit_documents(hits: DataFrame, query: str, messages: DataFrame | None = None, full: bool = False) -> list[dict]:
    """The hits of one search, some ten of them, as dictionaries in order.

    The snippet is cut from a unit's rendered ``messages`` around the anchor; a post thread's, whose comments are not
    among its messages, from its text around the best line.
    """
    lines_of: dict[int, list[tuple[int, str]]] = {}
    if messages is not None:
        lines = units.render(messages.join(hits.select("chat_id").distinct(), "chat_id", "left_semi"))
        for r in unit_messages(hits, lines).select("unit_id", "pos", "msg_id", "line").orderBy("unit_id", "pos").collect():
            lines_of.setdefault(r.unit_id, []).append((r.msg_id, r.line))
    out = []
    for r in hits.orderBy("place").collect():
        row = r.asDict()
        own = lines_of.get(row.get("unit_id"), [])
        lines = (r.text or "").split("\n")
        if own and not (r.kind == "thread" and len(r.msg_ids) == 1):
            ids, lines = zip(*own, strict=True)
            at = ids.index(r.anchor) if r.anchor in ids else 0
        else:
            at = r.msg_ids.index(r.anchor) if r.anchor in r.msg_ids and len(r.msg_ids) == len(lines) else rank.best_line(lines, query)
        shown = {k: row[k] for k in ("place", "score", "kind", "chat_id", "anchor", "msg_ids", "accounts") if k in row} | {k: row.get(k) for k in ("title", "url", "fallback")}
        out.append(shown | {"since": row["date_start"], "until": row["date_end"], "snippet": "\n".join(rank.snippet_lines(list(lines), at))} | ({"text": r.text} if full else {}))
    return out


def hit_text(documents: list[dict]) -> str:
    """Hits as text: place, score, kind, title and span, then the snippet."""
    day = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).strftime("%Y-%m-%d %H:%M")
    return "\n\n".join(f"{h['place']}. {h['score']:.4f} {h['kind']} {h.get('title') or h['chat_id']} {day(h['since'])} - {day(h['until'])}\n{h['snippet']}" for h in documents)


def index_age(chats: DataFrame, now: int) -> int | None:
    """Minutes since any chat was read last; null if none was."""
    last = chats.agg(F.max("last_sync_at")).head()[0]
    return None if last is None else max(0, (now - last) // 60)


def candidate_report(candidates: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """(chat, corroboration, evidence): each candidate with up to ``most`` of its evidence, an origin once."""
    one = evidence.groupBy("chat", "origin").agg(F.min(F.struct("chat_id", "msg_id", "via", "snippet")).alias("e"))
    told = one.groupBy("chat").agg(F.slice(F.array_sort(F.collect_list("e")), 1, most).alias("evidence"))
    return candidates.join(told, "chat", "left").select("chat", "corroboration", "evidence")


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """(status, n)."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def account_status(accounts: DataFrame, access: DataFrame) -> DataFrame:
    """(account, chats, place): accounts with the chats they reach, the default one first."""
    reached = access.groupBy("account").agg(F.countDistinct("chat_id").alias("chats"))
    joined = accounts.select("account").distinct().join(reached, "account", "left").withColumn("chats", F.coalesce("chats", F.lit(0)))
    return joined.withColumn("place", (F.col("account") != "default").cast("int")).orderBy("place", "account")


def session_report(cands: DataFrame, evidence: DataFrame, cursors: DataFrame, grants: DataFrame, now: int) -> dict:
    """A session as one document: how many candidates there are of each status, chats read, lists among them, evidence and live grants."""
    live = leads.granted(grants, now)
    return {
        "candidates": {r.status: r.n for r in status_counts(cands).collect()}, "chats": cursors.count(), "directories": cursors.where("directory").count(),
        "evidence": evidence.count(), "grants": [r.asDict() for r in live.orderBy("chat").limit(100).collect()],
    }
