import json

import pytest

from parlance.sources import live
from parlance.sources.live import ChatFeed, FeedReader


@pytest.fixture
def feed(spark, tmp_path):
    """A feed's files, and a run over what is new in them."""
    spark.dataSource.register(ChatFeed)
    (tmp_path / "feed").mkdir()

    def write(chat, ids, gone=()):
        with open(tmp_path / "feed" / f"{chat}.jsonl", "a") as f:
            for i in ids:
                if i not in gone:
                    f.write(json.dumps({"id": i, "date": 1000 + i, "text": f"t{chat}-{i}"}) + "\n")

    def run(**options):
        reader = spark.readStream.format("chat_feed").options(client="parlance.sources.live:folder_client", path=f"file://{tmp_path}/feed", page=10, **options)
        reader.load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return write, run


def test_only_what_is_above_the_marks(feed):
    write, run = feed
    write(1, range(1, 36), gone=(5, *range(11, 21)))
    write(2, range(1, 4))
    rows = run(since=1003)
    want = [(1, i, 1000 + i, f"t1-{i}") for i in range(3, 36) if i != 5 and not 11 <= i <= 20] + [(2, 3, 1003, "t2-3")]
    assert rows == want
    assert run(since=1003) == want
    write(1, range(36, 39))
    write(3, range(1, 6))  # a chat that is new, from since on
    assert run(since=1003) == sorted(want + [(1, i, 1000 + i, f"t1-{i}") for i in range(36, 39)] + [(3, i, 1000 + i, f"t3-{i}") for i in range(3, 6)])


def test_pages_and_marks(tmp_path):
    (tmp_path / "7.jsonl").write_text("".join(json.dumps({"id": i, "date": i}) + "\n" for i in (1, 2, 1300)))
    reader = FeedReader({"client": "parlance.sources.live:folder_client", "path": f"file://{tmp_path}"})
    assert reader.latestOffset() == {"7": 1300}
    assert [(p.after, p.upto) for p in reader.partitions({}, {"7": 1300})] == [(0, 500), (500, 1000), (1000, 1300)]
    assert [r[1] for p in reader.partitions({"7": 1}, {"7": 1300}) for r in reader.read(p)] == [2, 1300]
    (tmp_path / "7.jsonl").write_text("")
    assert reader.latestOffset() == {"7": 1300} and reader.partitions({"7": 1300}, {"7": 1300}) == []
    with pytest.raises(ValueError):
        FeedReader({"page": "0"})


def test_files_with_known_spans_are_read_once(spark, tmp_path, monkeypatch):
    """Tasks follow the files and not the ids, marks are found without reading all rows, and the answers are a plain folder's."""
    monkeypatch.setattr(live, "FILE_ROWS", 10)
    rows = [(c, i * 1000 + c, 5000 + (i * 37 % 100 if c == 2 else i), f"t{i}" if i % 3 else None) for c in (1, 2, -3) for i in range(1, 101)]
    (tmp_path / "plain").mkdir()
    for c in (1, 2, -3):
        (tmp_path / f"plain/{c}.jsonl").write_text("".join(json.dumps(dict(zip(("id", "date", "text"), r[1:], strict=True))) + "\n" for r in rows if r[0] == c))
    parts = [[r for r in rows if r[1] <= 50_000], [r for r in rows if r[1] > 50_000]]
    for part in parts:
        live.write_feed(spark.createDataFrame(part, live.ROWS), f"file://{tmp_path}/feed")
    of = lambda name: live.Folder({"path": f"file://{tmp_path}/{name}"})
    read = []
    plain_lines = live.Folder._lines
    monkeypatch.setattr(live.Folder, "_lines", lambda self, path: read.append(path) or plain_lines(self, path))
    got, want = of("feed"), of("plain")
    assert got.chats() == want.chats() == [-3, 1, 2]
    assert [got.newest(c) for c in (1, 2, -3)] == [want.newest(c) for c in (1, 2, -3)]
    assert [got.last_before(1, d) for d in (0, 5001, 5050, 9000)] == [want.last_before(1, d) for d in (0, 5001, 5050, 9000)]
    assert sum("/feed/parts/" in p for p in read) <= 2
    assert [got.last_before(2, d) for d in range(5000, 5101, 7)] == [want.last_before(2, d) for d in range(5000, 5101, 7)]
    for after, upto in ((0, 100_002), (1, 3), (20_500, 61_002), (99_999, 200_000), (200_000, 300_000)):
        assert sorted(got.page(2, after, upto)) == sorted(want.page(2, after, upto))
    reader = live.FeedReader({"client": "parlance.sources.live:folder_client", "path": f"file://{tmp_path}/feed", "page": "10", "since": "5004"})
    read.clear()
    pages = reader.partitions({}, reader.latestOffset())
    assert len(pages) <= 3 * 20 and sorted(r for p in pages for r in reader.read(p)) == sorted(r for r in rows if r[1] > want.last_before(r[0], 5004))
    files = [p for p in read if "/feed/parts/" in p]
    assert max(map(files.count, files)) <= 2  # once for the first mark, once by a task
