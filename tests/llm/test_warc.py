import base64
import hashlib
import os

import duckdb
import pytest
import zstandard

from parlance.llm import warc
from parlance.llm.queries import ORACLES, op6_warc_zstd
from parlance.llm.warc import archive_head, parse_record, read_archive, read_archives, record_bytes, write_archives

PAGES = "page_id long, url string, html string"


def expected(rows):
    out = []
    for k, (i, _, h) in enumerate(rows):
        same = [(j is not None, j or 0, -n) for n, (j, _, g) in enumerate(rows) if (g or "") == (h or "")]
        top = max(same)
        p = (h or "").encode()
        own = top == (i is not None, i or 0, -k)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else (top[1] if top[0] else None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive", [64 << 20, 200])
def test_round_trip(spark, tmp_path, monkeypatch, archive):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    rows = [(i, f"http://x/{i}?a b\r\nEvil: é", "<html>" + "word " * (i % 7) + "é</html>") for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (7, "twice", "<p>7"), (7, "twice", "<p>7"), (None, "n", "<p>none"), (None, "n", "<p>none"), (None, "n", "<p>7"), (60, "long", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1).selectExpr("*", "1 as place", "2 as digest", "3 as frame")
    folder = str(tmp_path / "out")
    listed = write_archives(pages, folder).collect()
    assert sum(r.records for r in listed) == len(rows) and sorted(os.path.basename(r.path) for r in listed) == sorted(f for f in os.listdir(folder) if not f.startswith("."))
    assert sorted((tuple(r) for r in read_archives(spark, folder).collect()), key=str) == expected(rows)
    payloads = sorted(b for r in listed for h, b in read_archive(open(r.path, "rb").read()) if h["warc-type"] == "response")
    assert payloads == sorted({(h or "").encode() for _, _, h in rows})


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS FROM '/root/testdata/sf0.01/pages.parquet'")
    rel = con.execute(ORACLES["op6_warc_zstd"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=str)
    got = op6_warc_zstd(spark, "/root/testdata/sf0.01").select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    folder = str(tmp_path / "none")
    os.makedirs(folder)
    assert write_archives(empty, folder).count() == 0 and read_archives(spark, folder).count() == 0


def broken():
    good = record_bytes(1, "u", b"abc", 3, warc.payload_digest(b"abc"), False)
    yield good.replace(b"WARC/1.1", b"WARC/9"), "version"
    yield good.replace(b"Content-Length: 3", b"Content-Length: 4"), "Content-Length"
    yield good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), "digest"
    yield good.replace(b"WARC-Date", b"WARC-Datum"), "warc-date"
    yield good.replace(b"WARC-Type: response", b"WARC-Type: other"), "neither"
    yield good[:-2], "Content-Length"
    yield b"WARC/1.1\r\nno end", "end"


@pytest.mark.parametrize("data,what", list(broken()))
def test_broken_records(data, what):
    with pytest.raises(ValueError, match=f"(?i){what}"):
        parse_record(data, "here")


def test_broken_archives():
    d = b"some dictionary text"
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    frame = c.compress(record_bytes(1, "u", b"abc", 3, warc.payload_digest(b"abc"), False))
    good = archive_head(d) + frame + frame
    assert [b for _, b in read_archive(good)] == [b"abc", b"abc"] and list(read_archive(archive_head(d))) == []
    packed = archive_head(zstandard.ZstdCompressor().compress(d)) + frame
    assert [b for _, b in read_archive(packed)] == [b"abc"]
    for bad, what in ((frame, "skippable"), (good[:20], "dictionary is cut"), (good[:-3], "cut short|frame"), (good + b"tail", "no frame"), (b"", "skippable")):
        with pytest.raises(ValueError, match=what):
            list(read_archive(bad))


def many(records):
    d = b"some dictionary text"
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    body = os.urandom(1500)
    return archive_head(d) + c.compress(record_bytes(1, "u", body, 1500, warc.payload_digest(body), False)) * records


def test_time_grows_with_the_archive():
    import time

    took = []
    for n in (2_000, 16_000):
        data = many(n)
        began = time.process_time()
        assert sum(1 for _ in read_archive(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * 2.5 * took[0]


def test_pieces_are_bounded():
    import io

    class Watched(io.BytesIO):
        def read(self, n=-1):
            assert 0 < n <= warc.PIECE_BYTES
            return super().read(n)

    assert sum(1 for _ in read_archive(Watched(many(100)))) == 100


@pytest.mark.parametrize("length,of,digest", [(3, 1, b"abd"), (4, 1, b"abc"), (3, 2, b"abc"), (3, None, b"abc")])
def test_revisits_are_held_against_their_responses(spark, tmp_path, length, of, digest):
    d = b"some dictionary text"
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    response = record_bytes(1, "u", b"abc", 3, warc.payload_digest(b"abc"), False)
    good, bad = (record_bytes(0, "u", b"", n, warc.payload_digest(x), i) for n, x, i in ((3, b"abc", 1), (length, digest, of)))
    for name, revisit in (("good", good), ("bad", bad)):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "a.warc.zst").write_bytes(archive_head(d) + c.compress(revisit))
        (tmp_path / name / "b.warc.zst").write_bytes(archive_head(d) + c.compress(response))
    assert read_archives(spark, str(tmp_path / "good")).count() == 2
    with pytest.raises(Exception, match="no response"):
        read_archives(spark, str(tmp_path / "bad")).collect()
