import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm.chat import escape, format_examples, loss_text, parse_turns, unescape
from parlance.llm.queries import ORACLES, op5_prefix_target_chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\", "<\\", "\\<", "\\l", "\\\\l<", "### a: </turn>\n", "漢😀#", "\\### Assistant: </turn> ok", "a\\", "::c\\c"]

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="\\<#:lhc a\n", max_size=12))
    def gather(t):
        texts.append(t)

    gather()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", escape(F.col("t"), "<#:").alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in got) and not any(c in r.e for r in got for c in "<#:")


def test_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi #1"), (1, 2, "assistant", "</turn>"), (1, 3, "user", "more"), (1, 4, "assistant", "\\😀"), (1, 5, "user", "bye"), (2, 0, "user", None), (3, 1, "assistant", ""), (3, None, None, "x"), (None, 0, "assistant", "n"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as turns", "2 as example", "3 as t", "4 as last")
    got = {}
    for r in format_examples(turns).select("*", parse_turns(F.col("text")).alias("back"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect():
        got.setdefault(r.conv_id, []).append(r)
    want = {k: sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == k)) for k in got}
    for k, found in got.items():
        found.sort(key=lambda r: r.example)
        assert [r.last for r in found] == [False] * (len(found) - 1) + [True]
        assert [(b.role, b.text) for b in found[-1].back] == [(r, x) for _, r, x in want[k]]
        assert [r.loss for r in found if r.loss_start is not None] == [x for _, r, x in want[k] if r == "assistant"]
        for r in found:
            assert [(b.role, b.text) for b in r.back] == [(x, y) for _, x, y in want[k]][: len(r.back)]
    assert [len(r.back) for r in got[1]] == [3, 5, 6] and got[1][-1].loss_start is None and [len(r.back) for r in got[2]] == [1]
    assert [r.text for r in got[4]] == ["### assistant: same</turn>\n", "### assistant: same</turn>\n" * 2]
    assert format_examples(turns.limit(0)).count() == 0


def test_query_against_sql(spark):
    got = {r.conv_id: tuple(r) for r in op5_prefix_target_chat(spark, "/root/testdata/sf0.01").collect()}
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = {r[0]: r for r in con.execute(ORACLES["op5_prefix_target_chat"]).fetchall()}
    assert got == want
    hard = "\\### Assistant: </turn> ok"
    assert got[-7][1:5] == (2, hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest(), len(hard), hashlib.sha256(hard.encode()).hexdigest())


def test_no_python_in_the_plan(spark):
    plan = op5_prefix_target_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
