"""Time literals of queries, parsed in the driver to nanoseconds since the epoch."""

from __future__ import annotations

import datetime as dt
import re
import time

from .model import LONG_MAX

SECOND = 1_000_000_000
#: Nanoseconds of the units of a duration (fixed values).
UNITS = {
    **dict.fromkeys(["nsec", "ns", "nanos"], 1),
    **dict.fromkeys(["usec", "us", "micros"], 1_000),
    **dict.fromkeys(["msec", "ms", "millis"], 1_000_000),
    **dict.fromkeys(["seconds", "second", "secs", "sec", "s"], SECOND),
    **dict.fromkeys(["minutes", "minute", "mins", "min", "m"], 60 * SECOND),
    **dict.fromkeys(["hours", "hour", "hrs", "hr", "h"], 3_600 * SECOND),
    **dict.fromkeys(["days", "day", "d"], 86_400 * SECOND),
    **dict.fromkeys(["weeks", "week", "wks", "wk", "w"], 604_800 * SECOND),
    **dict.fromkeys(["months", "month", "M"], 2_630_016 * SECOND),
    **dict.fromkeys(["years", "year", "yrs", "yr", "y"], 31_557_600 * SECOND),
}
_PART = re.compile(r"\s*(\d+)\s*([A-Za-z]+)\s*")
_INSTANT = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?Z?", re.ASCII)
_EPOCH = dt.datetime(1970, 1, 1)


def parse_duration(text: str) -> int | None:
    """Nanoseconds of `1h30m` and the like, None where the text is no duration."""
    at, total = 0, 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m[2] not in UNITS:
            return None
        total += int(m[1]) * UNITS[m[2]]
        at = m.end()
    return total if at else None


def parse_instant(text: str) -> int | None:
    """Nanoseconds of `YYYY-MM-DD hh:mm:ss`, with T or a blank, a fraction and a Z if wanted; always UTC."""
    m = _INSTANT.fullmatch(text)
    if not m:
        return None
    try:
        t = dt.datetime(*map(int, m.groups()[:6]))
    except ValueError:
        return None
    delta = t - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * SECOND + int((m[7] or "").ljust(9, "0"))


def parse_time(text: str, now_ns: int | None = None) -> int:
    """A duration before now, an instant, or a date (its midnight); ValueError for anything else and before 1970."""
    text = text.strip()
    if not text:
        raise ValueError("empty time")
    if (back := parse_duration(text)) is not None:
        at = (time.time_ns() if now_ns is None else now_ns) - back
    else:
        at = parse_instant(text)
        if at is None:
            at = parse_instant(f"{text} 00:00:00")
        if at is None:
            raise ValueError(f"{text!r} is no duration, date or time")
    if at < 0:
        raise ValueError(f"{text!r} is before 1970")
    return at


def upper_bound(ns: int) -> int:
    """An upper bound on a whole second means all of that second; a lower bound is never widened."""
    return min(ns + SECOND - 1, LONG_MAX) if ns % SECOND == 0 else ns


def parse_range(start: str | None, end: str | None, now_ns: int | None = None) -> tuple[int | None, int | None]:
    """Bounds of a query, both inclusive."""
    low = None if start is None else parse_time(start, now_ns)
    high = None if end is None else upper_bound(parse_time(end, now_ns))
    check_range(low, high)
    return low, high


def check_range(low: int | None, high: int | None) -> None:
    if low is not None and high is not None and low > high:
        raise ValueError(f"the range ends ({high}) before it begins ({low})")
