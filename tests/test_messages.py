import json
import random

from pyspark.sql import functions as F

import pytest

from parlance import schema, storage
from parlance.operators import chats as ch
from parlance.operators import leads, readers, units, upkeep
from parlance.sources import export
from parlance.streaming.maintenance import Store, maintain

COLUMNS = "chat_id long, msg_id long, topic_id long, date long, line string, reactions long, reply_to_msg_id long"


def greedy(rows, gap, most, chars):
    out = []
    for m in sorted(rows, key=lambda m: (m[3], m[1])):
        w = out[-1] if out else None
        if w is None or m[3] - w[-1][3] > gap * 60 or len(w) >= most or sum(len(x[4]) for x in w) + len(w) - 1 + 1 + len(m[4]) > chars:
            out.append([m])
        else:
            w.append(m)
    return [[m[1] for m in w] for w in out]


def test_windows_are_cut_greedily(spark):
    random.seed(1)
    rows, date = [], 0
    for i in range(400):
        date += random.choice([0, 5, 60, 1800, 1801])
        rows.append((1 + i % 3, i, None if i % 3 else i % 2, date, "é" * random.choice([1, 5, 20, 90]), i % 4, None))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {}
    for r in units.windows(df, gap_min=30, max_msgs=4, max_chars=60).collect():
        got.setdefault((r.chat_id, r.topic_id), []).append(r)
    for key, found in got.items():
        mine = [m for m in rows if (m[0], m[2]) == key]
        found.sort(key=lambda r: (r.date_start, r.msg_ids[0]))
        assert [r.msg_ids for r in found] == greedy(mine, 30, 4, 60)
        by = {m[1]: m for m in mine}
        for r in found:
            assert r.text == "\n".join(by[i][4] for i in r.msg_ids) and r.reactions == sum(by[i][5] for i in r.msg_ids)
    assert sum(len(r.msg_ids) for f in got.values() for r in f) == 400


def test_threads(spark):
    # 1 <- 2 <- 4, 1 <- 3; 5 replies to a message that is gone, 6 to 5; 7 and 8 to each other; 9 to itself; 10 alone
    links = [(1, None), (2, 1), (3, 1), (4, 2), (5, 99), (6, 5), (7, 8), (8, 7), (9, 9), (10, None)]
    rows = [(1, i, None, 1000 - i if i == 1 else i, f"l{i}", 1, up) for i, up in links]
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted((r.msg_ids, r.text, r.reactions) for r in units.threads(df, 3).collect())
    assert got == [([1, 2, 3], "l1\nl2\nl3", 3), ([1, 4], "l1\nl4", 2), ([5, 6], "l5\nl6", 2)]
    assert sorted(r.msg_ids for r in units.threads(df, 1).collect()) == [[1, 2], [1, 3], [1, 4], [5, 6]]
    assert [r.msg_id for r in readers.thread(df, 1, 4).collect()] == [2, 3, 4, 1]
    assert {r.msg_id for r in readers.thread(df, 1, 7).collect()} == {7, 8} and readers.thread(df, 1, 50).count() == 0
    chain = spark.createDataFrame([(1, i, None, i, "x", 0, i - 1) for i in range(1, 200)], COLUMNS)
    assert {r.root for r in units.reply_roots(chain).collect()} == {1}


def test_units_of_all_chats(spark):
    m = "chat_id long, msg_id long, date long, from_id long, from_name string, reply_to_msg_id long, topic_id long, text string, media_kind string, media_filename string, extracted string, reactions long, comment_of_chat_id long, comment_of_msg_id long"
    rows = [(1, 1, 10, None, "a", None, 7, "talk", None, None, None, 1, None, None), (1, 2, 20, None, "b", 1, 8, "reply", None, None, None, 2, None, None), (2, 1, 10, None, "c", None, 1, "post", None, None, None, 5, None, None), (3, 9, 30, None, "d", None, 1, "comment", None, None, None, 1, 2, 1), (3, 10, 31, None, "d", None, 2, "other", None, None, None, 1, 99, 1)]
    chats = spark.createDataFrame([(1, False, False), (2, False, True), (3, True, False)], "id long, is_forum boolean, is_broadcast boolean")
    got = {(r.chat_id, r.kind, tuple(r.msg_ids), r.topic_id, r.reactions, r.date_end) for r in units.build_units(spark.createDataFrame(rows, m), chats).collect()}
    assert got == {(1, "window", (1, 2), None, 3, 20), (1, "thread", (1, 2), 7, 3, 20), (2, "post", (1,), None, 5, 10), (2, "thread", (1,), None, 5, 30), (3, "window", (9,), 1, 1, 30), (3, "window", (10,), 2, 1, 31)}


FEW = {"gap_min": 30, "max_msgs": 4, "max_chars": 80}


def shown(found):
    return sorted((r.chat_id, r.kind, tuple(r.msg_ids), r.text, r.reactions) for r in found.collect())


def talk(n, chats=3):
    random.seed(5)
    return [(1 + i % chats, i, i * random.choice([10, 700]), f"line {i}", i - random.choice([3, 6]) if i % 4 == 0 else None, i % 3) for i in range(1, n)]


TALK = "chat_id long, msg_id long, date long, text string, reply_to_msg_id long, reactions long"


def test_stream_survives_repeated_batches(spark, tmp_path):
    """Rows come late and again, edits win by their date, and a batch that stopped anywhere is repeated without a trace."""
    rows = [(*r, 0) for r in talk(40)]
    edited = [(c, i, d, f"{t} edited", up, n + 5, 1) for c, i, d, t, up, n, _ in rows[::9]]
    shuffled = [*rows, *rows[:5], *edited]
    random.shuffle(shuffled)
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    stream = lambda: spark.readStream.schema(f"{TALK}, version int").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: maintain(stream(), out, cp, order=["version"], buckets=2, **FEW).awaitTermination()
    feed = lambda part: spark.createDataFrame(part, f"{TALK}, version int").coalesce(1).write.mode("append").parquet(source)
    feed([r for r in shuffled if r[-1] == 0][::2])
    run()
    feed([r for r in shuffled if r[-1] == 0][1::2])
    feed([r for r in shuffled if r[-1] == 1])
    run()
    latest = {r[1]: r for r in sorted(shuffled, key=lambda r: r[-1])}
    m = schema.conform(spark.createDataFrame([r[:-1] for r in latest.values()], TALK), schema.MESSAGES)
    want = shown(units.windows(units.render(m), **FEW).unionByName(units.threads(units.render(m))))
    store = Store(spark, out, buckets=2)
    assert shown(store.read("units")) == want and store.read("messages").count() == 39
    last = store.commits()[-1]
    for lost in ([f"out/commits/{last}"], [f"out/commits/{last}", f"out/units/{last}", f"out/messages/{last}"]):
        for path in [*lost, f"cp/commits/{last}", f"cp/commits/.{last}.crc"]:
            (tmp_path / path).rename(tmp_path / f"gone-{len(list(tmp_path.iterdir()))}")
        run()
        assert shown(store.read("units")) == want and store.commits()[-1] == last


def test_chunks_in_any_order_equal_one_cut(spark):
    rows = talk(60, 2)
    m = schema.conform(spark.createDataFrame(rows, TALK), schema.MESSAGES)
    chats = spark.createDataFrame([(1, False, False), (2, False, False)], "id long, is_forum boolean, is_broadcast boolean")
    random.shuffle(rows)
    have = upkeep.with_ids(units.windows(units.render(m).limit(0)))
    for k in range(3):
        so_far = m.join(spark.createDataFrame([(r[0], r[1]) for r in rows[: 20 * (k + 1)]], "chat_id long, msg_id long"), ["chat_id", "msg_id"])
        fresh = spark.createDataFrame([(r[0], r[1]) for r in rows[20 * k : 20 * (k + 1)]], "chat_id long, msg_id long")
        gone, new = upkeep.rebuild(so_far, have, fresh, chats, **FEW)
        have = storage.checkpointed(upkeep.applied(have, gone, new))
    whole = units.windows(units.render(m), **FEW).unionByName(units.threads(units.render(m)))
    assert shown(have) == shown(whole)
    same = upkeep.rebuild(m, have, m.select("chat_id", "msg_id"), chats, **FEW)
    assert same[0].count() == same[1].count() == 0  # what is cut to the same content keeps its id


def test_an_edit_in_a_closed_window_waits_for_invalidation(spark):
    rows = [(1, i, i * 10_000, f"line {i}", None, 0) for i in range(1, 6)]
    m = schema.conform(spark.createDataFrame(rows, TALK), schema.MESSAGES)
    chats = spark.createDataFrame([(1, False, False)], "id long, is_forum boolean, is_broadcast boolean")
    have = storage.checkpointed(upkeep.with_ids(units.windows(units.render(m))))
    now = m.withColumn("text", F.when(F.col("msg_id") == 2, "new").otherwise(F.col("text")))
    edited = m.where("msg_id = 2")
    assert upkeep.rebuild(now, have, edited, chats)[1].count() == 0
    gone, new = upkeep.invalidate(now, have, edited, chats)
    assert [tuple(r.msg_ids) for r in gone.collect()] == [tuple(r.msg_ids) for r in new.collect()] == [(2,)]
    gone, new = upkeep.invalidate(m.where("msg_id <> 3"), have, m.where("msg_id = 3"), chats)
    assert [tuple(r.msg_ids) for r in gone.collect()] == [(3,)] and new.count() == 0


def test_a_busy_chat_is_walked_by_runs(spark, monkeypatch):
    monkeypatch.setattr(units, "BUSY_ROWS", 20)
    rows = [(*r[:2], None if r[0] == 1 else r[1] % 2, *r[2:]) for r in talk(120, 2)] + [(9, 1, None, 5, "alone", None, 0)]
    m = schema.conform(spark.createDataFrame(rows, "chat_id long, msg_id long, topic_id long, date long, text string, reply_to_msg_id long, reactions long"), schema.MESSAGES)
    busy = shown(units.windows(units.render(m), **FEW))
    monkeypatch.setattr(units, "BUSY_ROWS", 10**6)
    assert busy == shown(units.windows(units.render(m), **FEW)) and len(busy) > 30


def test_upsert_of_messages(spark):
    cols = "chat_id long, msg_id long, text string, topic_id long, comment_of_chat_id long, comment_of_msg_id long, media_kind string, media_filename string, extracted string, links array<struct<kind:string,target:string>>"
    old = [(1, 1, "a", 7, None, None, "photo", None, "read", [("link", "@x")]), (1, 2, "b", None, None, None, "document", "a.pdf", "read", None), (1, 3, "c", None, 1, 2, None, None, None, None)]
    new = [(1, 1, "A", None, None, None, "photo", None, None, None), (1, 2, "B", 9, None, None, "document", "b.pdf", None, []), (1, 4, "d", None, None, None, "photo", None, None, None)]
    got = {r.msg_id: r for r in storage.upsert_messages(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    assert (got[1].text, got[1].topic_id, got[1].extracted, [tuple(x) for x in got[1].links]) == ("A", 7, "read", [("link", "@x")])
    assert (got[2].text, got[2].topic_id, got[2].extracted, got[2].links) == ("B", 9, None, [])
    assert (got[3].text, got[3].comment_of_chat_id) == ("c", 1) and got[4].text == "d" and len(got) == 4


def test_export(spark, tmp_path):
    message = lambda i, **k: {"id": i, "type": "message", "date_unixtime": str(100 + i), "from": "Ann", "from_id": "user5", "text": "hi"} | k
    chat = {"name": "Room", "type": "public_supergroup", "id": 77, "messages": [
        message(1), message(2, text=["a ", {"type": "bold", "text": "b"}, "!"]), message(3, text="", text_entities=[{"type": "plain", "text": "see "}, {"type": "text_link", "text": "this", "href": "https://t.me/Name/4"}, {"type": "mention_name", "text": "Bo", "user_id": 9}]),
        message(4, text="", photo="p/x.jpg"), message(5, text="", file="f/y z.pdf", media_type="voice_message"), message(6, text="", poll={"question": "Q?", "answers": [{"text": "A"}, {"text": "B"}]}),
        message(7, reactions=[{"type": "emoji", "count": 2, "emoji": "x"}, {"type": "emoji", "count": 3, "emoji": "y"}], forwarded_from="Old", forwarded_from_id="channel8"), message(8, reply_to_message_id=1), message(9, reply_to_message_id=1, reply_to_peer_id="channel5"),
        {"id": 10, "type": "service", "date_unixtime": "1"}, {"type": "message", "date_unixtime": "1", "text": "no id"}, message(12, date_unixtime=None), message(13, date_unixtime=None, date="1970-01-01T00:01:00"),
    ]}
    whole = json.dumps({"about": "x", "chats": {"list": [chat, {"name": "?", "type": "unheard_of", "id": 3, "messages": []}]}})
    (tmp_path / "result.json").write_text(whole)
    read = export.read_entries(spark, str(tmp_path))
    assert [(r.id, r.type, r.title, r.unavailable) for r in export.chats(read).collect()] == [(-1000000000077, "supergroup", "Room", True)]
    got = {r.msg_id: r for r in export.messages(read).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 13] and got[2].text == "a b!" and got[3].text == "see thisBo" and got[13].date == 60 and got[1].date == 101
    assert [tuple(x) for x in got[3].links] == [("mention", "peer:9"), ("text_url", "@name/4")] and got[1].links is None
    assert [(got[i].media_kind, got[i].media_filename) for i in (1, 4, 5, 6)] == [(None, None), ("photo", None), ("voice", "y z.pdf"), ("poll", None)]
    assert got[6].text == "Q?\nA\nB" and got[7].reactions == 5 and (got[7].fwd_from_name, got[7].fwd_from_id) == ("Old", -1000000000008)
    assert (got[8].reply_to_msg_id, got[9].reply_to_msg_id, got[1].from_id) == (1, None, 5)
    assert {r.reason: r.n for r in export.report(read).collect()} == {"service": 1, "no id": 1, "no date": 1, "a chat of an unknown type": 1}
    cut = whole[: whole.index('"id": 5')]
    (tmp_path / "cut.json").write_text(cut)
    found = export.messages(export.read_entries(spark, str(tmp_path / "cut.json"))).collect()
    assert {1, 2, 3, 4} >= {r.msg_id for r in found} >= {1, 2, 3}
    (tmp_path / "one.json").write_text(json.dumps(chat))
    assert export.messages(export.read_entries(spark, str(tmp_path / "one.json"))).count() == 10
    with pytest.raises(export.ExportError):
        export.read_entries(spark, str(tmp_path / "none.json"))
    assert export.recover("no json") is None and export.recover("[1, [2, 3], {") == "[1, [2, 3]]" and export.recover("[1]}") is None
    odd = export.entries(spark.createDataFrame([("a", json.dumps({"type": "bot_chat", "id": 1, "messages": [message(1, text="[1, 2]"), message(2, date_unixtime="999999999999"), message(3, date_unixtime=None, date="2024-01-01T00:00:00+02:00"), 5, message(4, forwarded_from=None)]})), ("b", "[]"), ("c", "nothing")], "file string, text string"))
    got = {r.msg_id: r for r in export.messages(odd).collect()}
    assert got[1].text == "[1, 2]" and got[3].date == 1704060000 and got[4].fwd_from_name == "unknown" and got[1].fwd_from_name is None
    assert {r.reason: r.n for r in export.report(odd).collect()} == {"a message is no object": 1, "no date": 1, "the file holds no object": 1, "the file is no JSON": 1}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # what has no zone is UTC whatever the session's is
    try:
        assert export.messages(read).where("msg_id = 13").head().date == 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_import_beside_live_chats(spark):
    chat = lambda *rows: schema.conform(spark.createDataFrame(rows, "id long, peer_id long, type string, title string, source_id string, scope string"), schema.CHATS)
    stored = chat((5, 5, "user", "Bo", "import:bo", "home"), (-1000000000009, -1000000000009, "channel", "News", "folder:x", ""), (7, 7, "user", "Al", "chat:@al", "home"))
    fresh = chat((5, 5, "user", "Bo", None, None), (8, 8, "user", "Bo", None, None), (9, 9, "user", "🙂", None, None))
    none = schema.conform(spark.createDataFrame([(5, 1), (8, 2)], "chat_id long, msg_id long"), schema.MESSAGES)
    every, found = export.import_chats(stored, fresh, none, "work")
    got = {(r.scope, r.peer_id): (r.id, r.source_id) for r in every.collect()}
    assert got["work", 5] == (schema.SYNTHETIC_BASE, "import:bo-5") and got["work", 8] == (8, "import:bo-8") and got["work", 9] == (9, "import:chat-9") and got["home", 5] == (5, "import:bo")
    assert sorted((r.chat_id, r.msg_id) for r in found.collect()) == [(8, 2), (schema.SYNTHETIC_BASE, 1)]
    again, _ = export.import_chats(every, fresh, none, "work")
    assert {(r.scope, r.peer_id): (r.id, r.source_id) for r in again.collect()} == got
    with pytest.raises(export.ImportConflict):
        export.import_chats(stored, chat((7, 7, "user", "Al", None, None)), none, "home")


def test_origins(spark):
    """A post and its forwards are one origin, an author and a time are one, hidden authors and plain messages are each their own."""
    m = "chat_id long, msg_id long, text string, fwd_from_id long, fwd_msg_id long, fwd_from_name string, fwd_date long"
    post = -1000000000050
    rows = [(1, 7, "@target_x", None, None, None, None), (2, 1, "@target_x", post, 7, "n", 9), (3, 1, "@target_x", post, None, "n", None), (2, 2, "@target_x", post, None, "n", None), (2, 3, "@target_x", None, None, "hidden", 5), (3, 3, "@target_x", None, None, "hidden", 5)]
    chats = spark.createDataFrame([(1, post, "channel", ""), (2, 12, "user", "work"), (3, 13, "user", "work")], "id long, peer_id long, type string, scope string")
    found = {(r.chat_id, r.msg_id): r.origin for r in leads.message_leads(spark.createDataFrame(rows, m), chats).where("chat = '@target_x'").collect()}
    assert found[1, 7] == found[2, 1] == f"post:{post}/7" and found[3, 1] == found[2, 2] == f"fwd:{post}@0"
    assert found[2, 3] == "msg:work:12/3" and found[3, 3] == "msg:work:13/3"


def test_discovery(spark):
    m = "chat_id long, msg_id long, text string, links array<struct<kind:string,target:string>>, fwd_from_id long, fwd_from_name string, fwd_date long, lead_seq long"
    rows = [(1, 1, "t.me/aaaa and @self_name", None, None, None, None, 1), (1, 2, "t.me/bbbb", [], None, None, None, 2), (2, 1, "x", [("link", "https://t.me/AAAA/5")], None, None, None, 3), (2, 2, "x", [("link", "t.me/aaaa")], -100, "n", 9, 4), (3, 1, "x", [("link", "t.me/aaaa")], -100, "n", 9, 5), (3, 2, "tg://user?id=4", None, None, None, None, 6)]
    chats = spark.createDataFrame([(1, 11, "Self_Name", "user", "a", None), (2, 12, None, "user", "a", None), (3, 13, None, "user", "a", None)], "id long, peer_id long, username string, type string, scope string, discussion_of long")
    messages = spark.createDataFrame(rows, m)
    found = storage.checkpointed(leads.collect_leads(messages, chats))
    assert {(r.chat, r.corroboration, r.chats) for r in leads.candidates(found).collect()} == {("@aaaa", 3, 3), ("peer:-100", 1, 2)}
    after = spark.createDataFrame([(1, 1), (2, 9), (3, 9)], "chat_id long, after long")
    assert leads.collect_leads(messages, chats, after).count() == 0
    ranked = leads.ranked(leads.candidates(found), found, "see aaaa 12").collect()
    assert [r.chat for r in sorted(ranked, key=lambda r: r.rank)] == ["@aaaa", "peer:-100"]
    assert leads.question_terms("see the 123 ox walking") == ["see", "the", "walk"]
    columns = leads.EVIDENCE.replace(" string", "").replace(" long", "").split(", ")
    stored = found.select(*columns).where("chat_id = 1")
    assert leads.evidence(stored, found.unionByName(found)).count() == found.count()
    ids = spark.createDataFrame([(1, 5, None, None), (2, None, "Name", None), (3, 5, "name", None), (4, None, None, "h"), (5, 6, None, "h"), (6, None, None, None), (7, 8, "NAME", None), (8, None, "name", "k")], "id long, peer_id long, username string, invite string")
    assert {r.id: r.group for r in leads.same_chats(ids).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 1}  # 3 and 7 share a name and are not one
    cands = leads.candidates(found).select("chat").unionByName(spark.createDataFrame([("@self_name",)], "chat string"))
    assert {(r.chat, r.chat_id) for r in leads.held(cands, chats).collect()} == {("@self_name", 1)}


def test_choosing_chats(spark):
    cols = "id long, peer_id long, username string, title string, source_id string, type string, scope string"
    chats = spark.createDataFrame([(1, 101, "Name", "Visa and residence", "folder:a", "supergroup", ""), (2, 102, None, "Bank talk", "work/folder:a", "user", "work"), (3, 103, None, "Weather", "folder:b", "user", "home"), (4, 104, None, "Old", "import:old", "user", "home")], cols)
    pick = lambda *s: ch.select_chats(chats, list(s))
    assert pick("101") == {1} and pick("@name") == {1} and pick("bank") == {2} and pick("folder:a", "3") == {1, 2, 3} and pick("wether") == {3} and ch.one_chat(chats, "BANK") == 2
    assert pick("work/folder:a") == {2} and pick("import:old") == {4} and pick("https://t.me/Name/5") == {1} and pick("chat:@name") == {1} and pick("work/chat:102") == {2}
    with pytest.raises(ch.UnknownChat):
        pick("nothing like it")
    with pytest.raises(ch.UnknownChat):
        pick("home/chat:102")
    with pytest.raises(ch.UnknownChat):
        ch.one_chat(chats, "folder:a")
    assert ch.parse_target("Work/folder:x") == ("work", "folder", "x") and ch.split_source_id("work/chat:@x") == ("work", "chat:@x") and ch.split_source_id("import:x") == ("default", "import:x")
    assert ch.same_target("@Name", "chat:@name") and not ch.same_target("some words", "some words") and [ch.parse_target(x)[1] for x in ("-100", "t.me/x", "some words")] == ["id", "link", "words"]
    assert ch.title_score("visa", "Visa and residence") == pytest.approx(0.8 + 0.2 * 4 / 18) and ch.title_score("", "x") == 0
    dialogs = spark.createDataFrame([(1, "group", True, False, False), (2, "group", False, False, False), (3, "channel", False, False, False), (4, "bot", False, False, False)], "id long, kind string, muted boolean, read boolean, archived boolean")
    assert {r.id for r in ch.folder_members(dialogs, [4], [1], [3], ["group", "channel"], no_muted=True).collect()} == {1, 2, 4}
    media = spark.range(1).select(storage.next_media_state(F.lit(0), F.lit("error")), storage.next_media_state(F.lit(0), F.lit("empty")), storage.next_media_state(F.lit(1), F.lit("error"))).head()
    assert tuple(media) == (storage.FAILED, storage.EXTRACTED, 1)


def test_pruned_only_if_unchanged(spark):
    offered = spark.createDataFrame([(1, "folder:a"), (2, "folder:a"), (3, "folder:a"), (4, "folder:a")], "id long, source_id string")
    now = spark.createDataFrame([(1, "folder:a", None), (2, "import:x", None), (3, "folder:b", None), (4, "folder:a", 1)], "id long, source_id string, discussion_of long")
    assert [r.id for r in ch.still_prunable(offered, now).collect()] == [1]


def test_every_cut_of_an_export(spark):
    """Wherever a file ends, within a string, an escape or between brackets, whole messages before that are kept."""
    whole = '{"chats":{"list":[{"id":1,"type":"x","messages":[{"id":1,"t":"a]}[{\\\\"},{"id":2,"t":"q\\"}]\\\\\\"b\\n"},{"id":3}]}]}}'
    data = json.loads(whole)["chats"]["list"][0]["messages"]
    ends = [whole.index('"},{"id":2') + 2, whole.index('"},{"id":3') + 2, whole.index('{"id":3}') + 8]
    for at in range(1, len(whole) + 1):
        closed = export.recover(whole[:at])
        kept = sum(e <= at for e in ends)
        if closed is None:
            assert kept == 0
        else:
            chats = json.loads(closed).get("chats", {}).get("list", [{}])
            assert [m["id"] for m in (chats[0].get("messages", []) if chats else [])][:kept] == [m["id"] for m in data[:kept]]


def test_slugs_fold_case(spark):
    from parlance.functions import text as tx

    cases = {"Größe ΣΑΣ": "grösse-σασ", "  Чат № 5!": "чат-5", "ﬁ x": "fi-x", "?!": "", "A" * 50: "a" * 40, "a" * 39 + " b": "a" * 39}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.s for r in df.select("v", tx.slug(F.col("v")).alias("s")).collect()} == cases


def test_titles_that_may_be_near_lose_none(spark):
    """What the bound lets through has every title with a score, and little else."""
    rng = random.Random(12)
    words = ["steel", "stele", "rod", "rods", "brass", "Street", "road", "red", "Größe", "ＳＴＥＥＬ", "x"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) + rng.choice(["", "  ", "\t!"]) for _ in range(400)] + [None]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    for query in ("steel rod", "stel", "GRÖSSE", "r", "", "roads and rails to the north"):
        got = {r.id: r.score for r in ch.title_scores(df, query).collect()}
        want = {i: s for i, t in enumerate(titles) if (s := ch.title_score(query, t or "")) > 0}
        assert got == want
    passed = df.where(ch._may_be_near(F.col("title"), "steel rod")).where("title rlike '^[ -~]*$'").count()
    assert passed < 0.9 * sum(t is not None and t.isascii() for t in titles)
