from pyspark.sql import functions as F

from parlance.sinks import results


def test_hits(spark):
    hits = spark.createDataFrame([(7, 1, None, "window", [4, 5], 60, 120, "[x] ann: opening\n[x] bob: bank opened", 0.5, 1, 5), (8, 2, None, "thread", [9], 0, 0, "[x] eve: one", 0.25, 2, 9)], "unit_id long, chat_id long, topic_id long, kind string, msg_ids array<long>, date_start long, date_end long, text string, score double, place int, anchor long")
    chats = spark.createDataFrame([(1, -1000000000123, "supergroup", "Room", "room", False), (2, 42, "user", "Eve", None, False)], "id long, peer_id long, type string, title string, username string, is_forum boolean")
    docs = results.hit_documents(results.with_links(hits, chats), "bank")
    assert [(d["url"], d["fallback"]) for d in docs] == [("https://t.me/room/5", None), ("tg://openmessage?user_id=42&message_id=9", "tg://user?id=42")]
    assert docs[0]["snippet"].split("\n") == ["[x] bob: bank opened", "[x] ann: opening"]
    assert results.hit_text(docs).startswith("1. 0.5000 window Room 1970-01-01 00:01 - 1970-01-01 00:02\n[x] bob")


def test_reports(spark):
    chats = spark.createDataFrame([(1, None, "folder:a", 100), (2, 1, None, None), (3, None, "import:x", None), (4, None, None, 700), (5, None, None, None)], "id long, discussion_of long, source_id string, last_sync_at long")
    assert results.index_age(chats, 1000) == 5 and results.index_age(chats.where("id = 2"), 1000) is None
    accounts = spark.createDataFrame([("b",), ("default",), ("a",)], "account string")
    access = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "account string, chat_id long")
    assert [(r.account, r.chats) for r in results.account_status(accounts, access).collect()] == [("default", 0), ("a", 2), ("b", 0)]
    ev = spark.createDataFrame([("@x", "o1", 1, 2, "link", "s"), ("@x", "o1", 1, 1, "link", "s"), ("@x", "o2", 3, 1, "mention", "t")], "chat string, origin string, chat_id long, msg_id long, via string, snippet string")
    got = results.candidate_report(spark.createDataFrame([("@x", 2), ("@y", 0)], "chat string, corroboration long"), ev, 1).collect()
    assert {r.chat: r.evidence and [e.msg_id for e in r.evidence] for r in got} == {"@x": [1], "@y": None}
    rows = spark.range(2)
    assert {r.status: r.n for r in results.status_counts(rows.select(F.lit("new").alias("status"))).collect()} == {"new": 2}
