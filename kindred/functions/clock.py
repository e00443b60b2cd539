"""Times of day as columns: windows that open and close, and whether a nightly job is due."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def parse_hhmm(text: str) -> int:
    """Seconds of the day of ``HH:MM``; raises ValueError where it isn't one."""
    parts = str(text).split(":")
    if len(parts) != 2 or not all(re.fullmatch(r"\s*[+-]?\d+\s*", p) for p in parts):
        raise ValueError(f"not HH:MM: {text!r}")
    hour, minute = map(int, parts)
    if not (0 <= hour < 24 and 0 <= minute < 60):
        raise ValueError(f"not a time of day: {text!r}")
    return hour * 3600 + minute * 60


def hhmm(text: Column) -> Column:
    """Minutes of the day of ``HH:MM``, null where it isn't one."""
    return F.when(text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$"), F.split(text, ":")[0].cast("int") * 60 + F.split(text, ":")[1].cast("int"))


def second_of_day(now: Column) -> Column:
    return F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)


def in_window(now: Column, start: str, end: str) -> Column:
    """Whether ``now`` is in [start, end); a window past midnight wraps, an empty one holds nothing."""
    a, b, t = parse_hhmm(start), parse_hhmm(end), second_of_day(now)
    if a == b:
        return F.lit(False)
    return (t >= a) & (t < b) if a < b else (t >= a) | (t < b)


def _at(now: Column, seconds: int) -> Column:
    return F.date_trunc("day", now) + F.make_dt_interval(secs=F.lit(seconds))


_ONE = lambda: F.make_dt_interval(days=F.lit(1))


def next_transition(now: Column, start: str, end: str) -> Column:
    """When the window next closes (if open) or opens."""
    target = F.when(in_window(now, start, end), _at(now, parse_hhmm(end))).otherwise(_at(now, parse_hhmm(start)))
    return F.when(target <= now, target + _ONE()).otherwise(target)


def last_window_end(now: Column, end: str) -> Column:
    today = _at(now, parse_hhmm(end))
    return F.when(today > now, today - _ONE()).otherwise(today)


def analysis_due(now: Column, last: Column, end: str) -> Column:
    """Never done, or last done before the window closed most recently."""
    return last.isNull() | (last < last_window_end(now, end))
