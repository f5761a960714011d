"""Chat formatting with prefix-target expansion: every assistant turn becomes an example of its own.

An example is all turns up to its target; only the target's text is under the loss. A turn is written as
``### role: text</turn>`` and a line feed. Texts and roles are escaped reversibly with a backslash, so that neither
``#`` nor ``<`` occurs in them (nor ``:`` in a role), and with that no control string. All of it is DataFrame
functions.

Defined results: turns are ordered by turn (null first), then role and text, so repeated turns stay, side by side; a
null text or role counts as empty; only the role ``assistant`` is trained on; turns after the last assistant turn go
to a closing row without a target, which is also all there is for a conversation without an assistant; rows of a
null conv_id are one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
#: A control character and what follows the backslash in its place.
ESCAPES = {"<": "l", "#": "h", ":": "c"}


def escape(text: Column, controls: str = "<#") -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit("\\" + ESCAPES[c]))
    return out


def unescape(text: Column) -> Column:
    """Undoes ``escape``. Two backslashes in a row are one of the text, from the left."""

    def plain(part: Column) -> Column:
        for c, mark in ESCAPES.items():
            part = F.replace(part, F.lit("\\" + mark), F.lit(c))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last) from (conv_id, turn, role, text) rows.

    ``loss_start`` and ``loss_end`` bound the trained code points of ``text`` (null in a closing row). ``last`` marks
    the conversation's longest row, which has all of its turns.
    """
    rows = turns.select(turns["conv_id"], F.struct(turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(F.lit("### "), escape(t["role"], "<#:"), F.lit(": "), escape(t["text"]), F.lit(TURN_END)))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    ends = F.array_distinct(F.concat(replies, F.array(F.size("turns"))))
    talks = talks.select("conv_id", "turns", lines.alias("lines"), ends.alias("ends"))
    each = talks.select("conv_id", "turns", "lines", F.posexplode("ends").alias("example", "end"))
    target = F.element_at("turns", F.col("end"))
    text = F.array_join(F.slice("lines", F.lit(1), F.col("end")), "")
    each = each.select("conv_id", "example", text.alias("text"), target.alias("target"), (F.col("end") == F.size("turns")).alias("last"))
    loss_end = F.when(F.col("target")["role"] == "assistant", F.length("text") - len(TURN_END))
    loss_start = loss_end - F.length(escape(F.col("target")["text"]))
    return each.select("conv_id", "example", "text", loss_start.alias("loss_start"), loss_end.alias("loss_end"), "last")


def parse_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    lines = F.split(text, TURN_END)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)
    colon = lambda line: F.locate(":", line)
    return F.transform(lines, lambda x: F.struct(unescape(F.substring(x, F.lit(5), colon(x) - 5)).alias("role"), unescape(F.substring(x, colon(x) + 2, F.length(x))).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What is under the loss, as it was before formatting; empty in a closing row."""
    return F.coalesce(unescape(F.substring(text, start + 1, end - start)), F.lit(""))
