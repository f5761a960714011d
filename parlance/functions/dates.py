"""Date bounds of a query, resolved to seconds on the driver."""

from __future__ import annotations

import calendar
import datetime as dt
import re
import time

GRAMMAR = "YYYY-MM-DD, YYYY-MM, an ISO date and time, or an age like 7d, 3w, 6m, 1y"


class InvalidDate(ValueError):
    """A bound that cannot be read, or bounds that exclude each other."""


def months_away(moment: dt.datetime, months: int) -> dt.datetime:
    """So many calendar months on; the day is cut to the month's last."""
    year, month = divmod(moment.year * 12 + moment.month - 1 + months, 12)
    return moment.replace(year=year, month=month + 1, day=min(moment.day, calendar.monthrange(year, month + 1)[1]))


def parse_when(text: str, now: int | None = None, end: bool = False) -> int:
    """Seconds since 1970 (UTC) of a bound; with ``end``, a day or month means its last second."""
    word = text.strip()
    second = dt.timedelta(seconds=1)
    try:
        if re.fullmatch(r"\d{4}-\d{2}", word):
            start = dt.datetime(int(word[:4]), int(word[5:]), 1, tzinfo=dt.UTC)
            moment = months_away(start, 1) - second if end else start
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", word):
            start = dt.datetime.combine(dt.date.fromisoformat(word), dt.time(), dt.UTC)
            moment = start + dt.timedelta(days=1) - second if end else start
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?", word):
            moment = dt.datetime.fromisoformat(word.upper())
            moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.UTC)
        elif age := re.fullmatch(r"(\d+)([dwmy])", word.lower()):
            n, unit = int(age[1]), age[2]
            base = dt.datetime.fromtimestamp(time.time() if now is None else now, dt.UTC)
            moment = base - dt.timedelta(days=n * {"d": 1, "w": 7}[unit]) if unit in "dw" else months_away(base, -n * {"m": 1, "y": 12}[unit])
        else:
            raise ValueError(word)
    except (ValueError, OverflowError) as e:
        raise InvalidDate(f"cannot read the date {text!r}: {GRAMMAR}") from e
    return int(moment.timestamp())


def date_range(since: str | None, until: str | None, now: int | None = None) -> tuple[int | None, int | None]:
    """Both bounds, blank meaning none."""
    a = parse_when(since, now) if since and since.strip() else None
    b = parse_when(until, now, end=True) if until and until.strip() else None
    if a is not None and b is not None and a > b:
        raise InvalidDate(f"{since!r} is after {until!r}")
    return a, b
