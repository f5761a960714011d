import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.snowball import english, russian


def test_stems():
    # published samples of the algorithms
    pairs = {"opening": "open", "opened": "open", "consistency": "consist", "knavish": "knavish", "hopping": "hop", "hoping": "hope", "generously": "generous", "dying": "die", "skies": "sky", "news": "news", "inning": "inning", "relational": "relat", "electricity": "electr", "sky": "sky", "is": "is"}
    assert {w: english(w) for w in pairs} == pairs
    pairs = {"счёт": "счет", "счета": "счет", "счетов": "счет", "красивая": "красив", "важный": "важн", "важнейшие": "важн", "бегавшая": "бега", "вечером": "вечер", "вл": "вл"}
    assert {w: russian(w) for w in pairs} == pairs
    assert tx.query_terms("Openings of ACCOUNTS, счета 42_x") == ["open", "of", "account", "счет", "42_x"]


def test_tokens_are_word_characters(spark):
    import re

    texts = ["Ünïcode naïve_x 42²", "ﬁne ｄｎｉ", "éa", "", "a-b c'd", "Привет, мир!"]

    @settings(max_examples=100, deadline=None)
    @given(st.text(alphabet="aZ_9 é-'я漢½ﬁ\n", max_size=10))
    def gather(t):
        texts.append(t)

    gather()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tokens(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == re.findall(r"\w+", unicodedata.normalize("NFKC", r.t).lower())


def test_lines(spark):
    rows = [(1717243200, "Ann", 5, "  hi\n", None, None, None), (0, "", 7, "", "photo", None, None), (0, None, None, "", "document", "a.pdf", " read  this\n"), (0, "B", 1, "cap", "voice", "", None), (0, "B", 1, "", None, None, None)]
    df = spark.createDataFrame(rows, "d long, n string, i long, t string, k string, f string, e string")
    got = [r.l for r in df.select(tx.line(F.col("d"), tx.sender(F.col("n"), F.col("i")), tx.body(F.col("t"), F.col("k"), F.col("f"), F.col("e"))).alias("l")).collect()]
    assert got == ["[2024-06-01 12:00] Ann: hi", "[1970-01-01 00:00] id7: [photo]", "[1970-01-01 00:00] unknown: [document: a.pdf] read this", "[1970-01-01 00:00] B: cap", "[1970-01-01 00:00] B: [empty]"]


def test_small_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).head().v
    assert val(tx.clip(F.lit("abcdef"), 4)) == "abc…" and val(tx.clip(F.lit("abcd"), 4)) == "abcd"
    assert val(tx.slug(F.lit("  My Chat! №1 "))) == "my-chat-1"
    assert val(tx.overlap_ratio(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 0.5
    assert val(tx.language(F.lit("Bonjour мир"))) == "russian" and val(tx.language(F.lit("42"))) is None
    flat = "a" * 300 + " needle " + "b" * 300
    cut = val(tx.evidence_snippet(F.lit(flat), F.lit("needle")))
    assert cut[0] == cut[-1] == "…" and len(cut) == 242 and cut.index("needle") == 81
    assert val(tx.evidence_snippet(F.lit("  short\n text "), F.lit("x"))) == "short text" and val(tx.evidence_snippet(F.lit(" "), F.lit("x"))) is None


@pytest.mark.parametrize("bad", ["2024-13", "yesterday", "2024-02-30", "5", "9999999y"])
def test_dates_that_cannot_be_read(bad):
    from parlance.functions.dates import InvalidDate, parse_when

    with pytest.raises(InvalidDate):
        parse_when(bad)


def test_dates():
    from parlance.functions.dates import InvalidDate, date_range, parse_when

    now = parse_when("2024-03-31T12:00")
    assert parse_when("2024-02", end=True) == parse_when("2024-03-01") - 1 and parse_when("2024-02-29", end=True) == parse_when("2024-03-01") - 1
    assert parse_when("1m", now) == parse_when("2024-02-29T12:00") and parse_when("7d", now) == now - 7 * 86400 and parse_when("1y", now) == parse_when("2023-03-31T12:00")
    assert parse_when("2024-03-31T14:00+02:00") == now == parse_when("2024-03-31t12:00z")
    assert date_range(" ", None) == (None, None)
    with pytest.raises(InvalidDate):
        date_range("2024-02", "2024-01")
