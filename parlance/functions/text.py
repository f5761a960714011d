"""Text of messages as columns: tokens, stems, rendered lines, placeholders, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.snowball import english, russian

#: A token is a run of letters, digits and underscores; nothing is dropped.
TOKEN = r"([\p{L}\p{N}_]+)"
# Which script decides a word's stemmer.
CYRILLIC = "[\u0400-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f]"
LATIN = "[a-z\u00c0-\u024f]"
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Fixed value: the characters that are white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def nfkc(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in text:
        yield part.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: A character outside of those that NFKC leaves alone whatever stands beside them: ASCII, most of Latin, Cyrillic, dashes and quotes.
_UNSURE = "[^\\x00-\\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u2010\u2012-\u2016\u2018-\u2023\u20ac]"


def normal(text: Column) -> Column:
    """Text in NFKC; Python is sent only what may not be."""
    unsure = text.rlike(_UNSURE)
    return F.coalesce(F.when(~unsure, text), nfkc(F.when(unsure, text)))


@F.pandas_udf(T.StringType())
def folded(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, case folding, white space runs to one space, ends trimmed (null stays)."""
    for part in text:
        yield part.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def casefolded(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Case folding alone, which lower-casing is not: a sharp s becomes two letters, and a sigma is one whatever its place."""
    for part in text:
        yield part.map(lambda t: t if t is None else t.casefold())


def tokens(text: Column, normalised: bool = False) -> Column:
    """Lower-case tokens in order. Say ``normalised`` where the text is known to be NFKC already: no Python then."""
    return F.regexp_extract_all(F.lower(text if normalised else normal(text)), F.lit(TOKEN), F.lit(1))


def language(text: Column) -> Column:
    """``russian`` if there is a Cyrillic letter, else ``english`` if a Latin one, else null."""
    return F.when(F.lower(text).rlike(CYRILLIC), "russian").when(F.lower(text).rlike(LATIN), "english")


def stem_token(token: str) -> str:
    if re.search(CYRILLIC, token):
        return russian(token)
    return english(token) if re.search(LATIN, token) else token


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(token_lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stem of each token; a task remembers those it has met."""
    known: dict[str, str] = {}

    def stem(token: str) -> str:
        found = known.get(token)
        if found is None:
            if len(known) > 200_000:
                known.clear()
            found = known[token] = stem_token(token)
        return found

    for part in token_lists:
        yield part.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def token_list(text: str | None) -> list[str]:
    """``tokens`` of one text."""
    text = text or ""
    return re.findall(r"\w+", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def query_terms(text: str) -> list[str]:
    """Distinct stems of a query, first seen first (on the driver)."""
    return list(dict.fromkeys(map(stem_token, token_list(text))))


# ---------------------------------------------------------------------- lines


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def one_line(text: Column) -> Column:
    """White space runs to single spaces."""
    return stripped(F.regexp_replace(text, _SPACE, " "))


def filled(text: Column) -> Column:
    """Null where the text is empty."""
    return F.when(text != "", text)


def sender(from_name: Column, from_id: Column) -> Column:
    return F.coalesce(filled(from_name), F.concat(F.lit("id"), from_id.cast("string")), F.lit("unknown"))


def placeholder(kind: Column, filename: Column) -> Column:
    inner = F.when(filled(filename).isNotNull(), F.concat(kind, F.lit(": "), filename)).otherwise(kind)
    return F.when(kind.isNull(), F.lit("[empty]")).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def body(text: Column, kind: Column, filename: Column, extracted: Column) -> Column:
    """The caption, else the attachment's placeholder; with what was read from the attachment after it."""
    caption = filled(stripped(text))
    marker = placeholder(kind, filename)
    read = F.when(kind.isNotNull(), filled(one_line(extracted)))  # what was read belongs to an attachment
    return F.when(read.isNotNull(), F.concat_ws(" ", caption, marker, read)).otherwise(F.coalesce(caption, marker))


def line(date: Column, who: Column, what: Column) -> Column:
    """``[YYYY-MM-DD HH:MM] sender: body``, in UTC (the session's time zone must be)."""
    return F.concat(F.lit("["), F.date_format(F.timestamp_seconds(date), "yyyy-MM-dd HH:mm"), F.lit("] "), who, F.lit(": "), what)


def index_text(text: Column, extracted: Column) -> Column:
    """What is indexed of a message; null if there is nothing."""
    return filled(F.concat_ws(" ", filled(stripped(text)), filled(one_line(extracted))))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def evidence_snippet(text: Column, needle: Column, limit: int = 240) -> Column:
    """At most ``limit`` characters of the flattened text, from a third of that before the needle; null for no text."""
    return flat_snippet(one_line(text), needle, limit)


def flat_snippet(flat: Column, needle: Column, limit: int = 240) -> Column:
    """``evidence_snippet`` of a text that is flattened already."""
    found = F.coalesce(F.instr(F.lower(flat), F.lower(needle)), F.lit(0))
    start = F.when(found > 0, F.greatest(F.lit(0), F.least(found - 1 - limit // 3, F.length(flat) - limit))).otherwise(0)
    head = F.when(start > 0, "…").otherwise("")
    tail = F.when(start + limit < F.length(flat), "…").otherwise("")
    return F.when(F.length(flat) <= limit, filled(flat)).otherwise(F.concat(head, F.substring(flat, start + 1, F.lit(limit)), tail))


def slug(name: Column, limit: int = 40) -> Column:
    """Case-folded words of letters and digits joined by dashes."""
    dashed = F.regexp_replace(casefolded(name), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), "^-+|-+$", "")


def reaction_share(reactions: Column) -> Column:
    """log1p(n) / (1 + log1p(n)), and 0 for none."""
    n = F.log1p(F.greatest(reactions, F.lit(0)))
    return F.when(reactions > 0, n / (1 + n)).otherwise(F.lit(0.0))


def overlap_ratio(mine: Column, other: Column) -> Column:
    """Share of my distinct ids that are in the other list; 0 for an empty list."""
    size = F.size(F.array_distinct(mine))
    return F.when(size > 0, F.size(F.array_intersect(mine, other)) / size).otherwise(F.lit(0.0))
