"""Time notations of log lines, and levels: what a slot of a template can hold."""

from __future__ import annotations

import datetime as dt
import re

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_MONTH = "|".join(MONTHS)
_DAY = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
_FRACTION = r"(?:[.,](?P<f>\d{1,9}))?"
_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d\d):(?P<S>\d\d)" + _FRACTION
_ZONE = r"(?:\ ?(?P<z>Z|UTC|GMT|[+-]\d\d(?::?\d\d)?)(?!\w))?"
#: Notations by name (fixed formats).  Groups: Y m d H M S f z, b a month's name, p AM/PM, l a level's letter, e seconds.
NOTATIONS = {
    "iso": r"(?P<Y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)T" + _CLOCK + _ZONE,
    "spaced": r"(?P<Y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)\ " + _CLOCK + _ZONE,
    "slashed": r"(?P<Y>\d{4})/(?P<m>\d\d)/(?P<d>\d\d)\ " + _CLOCK + _ZONE,
    "dayfirst": r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<Y>\d{4})\ " + _CLOCK + _ZONE,
    "ctime": rf"(?:{_DAY})\ (?P<b>{_MONTH})\ +(?P<d>\d{{1,2}})\ " + _CLOCK + r"\ (?P<Y>\d{4})",
    "american": rf"(?P<b>{_MONTH})\ (?P<d>\d{{1,2}}),\ (?P<Y>\d{{4}}),?\ " + _CLOCK + r"\ (?P<p>AM|PM)",
    "syslog": rf"(?P<b>{_MONTH})\ +(?P<d>\d{{1,2}})\ " + _CLOCK + r"(?!\d)",
    "letter": r"(?P<l>[TDIWEFC])(?P<m>\d\d)(?P<d>\d\d)\ " + _CLOCK,
    "epoch": r"(?P<e>\d{10})(?:\.(?P<f>\d{1,9}))?(?![\w.])",
    "millis": r"(?P<e>\d{10})(?P<f>\d{3})(?!\w)",
}
PATTERNS = {name: re.compile(p, re.ASCII | re.VERBOSE) for name, p in NOTATIONS.items()}

#: Spellings of levels (fixed values).
LEVELS = {
    "trace": "TRACE", "trc": "TRACE", "finest": "TRACE", "finer": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "dbg": "DEBUG", "fine": "DEBUG",
    "info": "INFO", "inf": "INFO", "information": "INFO", "informational": "INFO", "notice": "INFO", "note": "INFO", "config": "INFO",
    "warn": "WARN", "wrn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "ftl": "FATAL", "critical": "FATAL", "crit": "FATAL", "crt": "FATAL", "panic": "FATAL", "alert": "FATAL", "emergency": "FATAL", "emerg": "FATAL",
}
LETTERS = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
SYSLOG = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
NUMBERED = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}

_EPOCH = dt.datetime(1970, 1, 1)
#: What a notation can end with: a digit, or the last letter of a zone or of AM and PM.
_TIME_ENDS = frozenset("0123456789ZCTM")


def level_of(word: object) -> str:
    """The level a word or number names, '' if none."""
    if isinstance(word, bool):
        return ""
    if isinstance(word, (int, float)):
        return NUMBERED.get(int(word), "") if word == int(word) else ""
    text = str(word).strip()
    return LEVELS.get(text.lower()) or (NUMBERED.get(int(text), "") if text.isascii() and text.isdigit() else "")


def _micros(t: dt.datetime, fraction: str | None) -> int:
    delta = t - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + int((fraction or "0").ljust(6, "0")[:6])


def event_micros(match: re.Match, near_ns: int | None) -> int | None:
    """Microseconds since the epoch of a matched notation, or None where there is no such time.

    Without a zone it is UTC; without a year, the year that brings it nearest to ``near_ns``.
    """
    g = match.groupdict()
    if g.get("e"):
        return int(g["e"]) * 1_000_000 + int((g["f"] or "0").ljust(6, "0")[:6])
    month = MONTHS.index(g["b"]) + 1 if g.get("b") else int(g["m"])
    hour = int(g["H"])
    if g.get("p"):
        hour = hour % 12 + (12 if g["p"] == "PM" else 0)
    shift = 0
    if (zone := g.get("z")) and zone[0] in "+-":
        digits = zone[1:].replace(":", "").ljust(4, "0")
        shift = (int(digits[:2]) * 60 + int(digits[2:])) * (1 if zone[0] == "+" else -1) * 60_000_000
    second = int(g["S"])
    leap = second == 60

    def at(year: int) -> int | None:
        try:
            t = dt.datetime(year, month, int(g["d"]), hour, int(g["M"]), 59 if leap else second)
        except ValueError:
            return None
        return _micros(t, g["f"]) + leap * 1_000_000 - shift

    if g.get("Y"):
        return at(int(g["Y"]))
    if near_ns is None:
        return None
    near = near_ns // 1000
    year = (_EPOCH + dt.timedelta(microseconds=near)).year
    for around in (1, 8):  # 29 February needs a leap year, which can be some years off
        known = [t for y in range(max(1, year - around), min(9999, year + around) + 1) if (t := at(y)) is not None]
        if known:
            break
    return min(known, key=lambda t: (abs(t - near), t), default=None)


def time_of(value: object, near_ns: int | None = None) -> int | None:
    """The time that a whole value (text or number of a structured line) gives, or None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        return round(value * 1_000_000) if 1e9 <= value < 1e10 else None
    text = str(value).strip()
    if len(text) < 10 or text[-1] not in _TIME_ENDS:
        return None
    for p in PATTERNS.values():
        if m := p.fullmatch(text):
            return event_micros(m, near_ns)
    return None
