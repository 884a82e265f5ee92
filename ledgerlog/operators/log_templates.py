"""Templates of log lines, mined by longest common subsequences, and the heads compiled from them.

A line becomes a sequence of symbols: a time (by notation), a level, a word, a number, blanks, or a character of
punctuation.  Lines that have a time near their beginning are clustered; a cluster's template is the longest common
subsequence of its lines, so what varies between messages drops out and the head stays, with gaps where some lines
have more (a process id, say).  Partitions' templates are merged the same way.  JSON objects and key=value lines have
no order; their keys are classified by the values they hold.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from .log_times import LEVELS, LETTERS, PATTERNS, SYSLOG, event_micros, level_of, time_of

#: So many symbols of a line are looked at in any case, and more as long as no free text has come ...
HEAD_SYMBOLS = 40
#: ... up to this bound of a head's length; the lines themselves are of any length.
MOST_SYMBOLS = 400
#: So many words one after the other are free text.
FREE_WORDS = 3
#: Before a time that is further behind than this stands a head only if it begins with a level, a priority or a bracket.
TIME_WITHIN = 4
#: Share of a key's values that must be of a kind for the key to be of it.
PURE = 0.9

WORD_PATTERN = r"[^\W\d][\w.\-/$@]*(?:::[\w.\-/$@]+)*"
_UNNAMED = {name: re.sub(r"\?P<\w+>", "?:", p.pattern) for name, p in PATTERNS.items()}
_TIMES = "|".join(f"(?P<T_{n}>{p})" for n, p in _UNNAMED.items())
_LEXER = re.compile("|".join([rf"(?=[0-9A-Z])(?<![\w.])(?:{_TIMES})", rf"(?P<WORD>{WORD_PATTERN})", r"(?P<NUM>\d+)", r"(?P<SP>[\ \t]+)", r"(?P<P>.)"]), re.VERBOSE | re.DOTALL)
_PRIORITY = re.compile(r"<(\d{1,3})>")
_PAIR = re.compile(r'([A-Za-z_@][\w.@\-]*)=("(?:\\.|[^"\\])*"|[^\s"]*)(?:[ \t]+|$)')


def symbols(line: str, least: int = HEAD_SYMBOLS) -> list[str]:
    """The symbols of a line's first physical line, as far as a head can reach: until after ``least`` free text has come."""
    out: list[str] = []
    line = line.split("\n", 1)[0]
    at, words = 0, 0  # words that stand one after the other
    if m := _PRIORITY.match(line):
        out.append("PRI")
        at = m.end()
    for m in _LEXER.finditer(line, at):
        kind = m.lastgroup
        if kind == "WORD":
            if m[0].lower() in LEVELS:
                kind = "LEVEL"
            words += 1
        elif kind == "P":
            kind = m[0]
            words = 0
        elif kind != "SP":
            words = 0
        out.append(kind)
        if len(out) >= least and (words >= FREE_WORDS or len(out) >= MOST_SYMBOLS):
            break
    return out


def time_at(sequence: list[str]) -> int | None:
    """Where the time of a head stands in its symbols, or None where there is none that could be of a head."""
    at = next((i for i, s in enumerate(sequence) if s.startswith("T_")), None)
    return at if at is None or at < TIME_WITHIN or sequence[0] in ("LEVEL", "PRI", "[", "(", "<", "{") else None


@dataclass
class Template:
    """Symbols common to all lines of a cluster; ``gaps[i]`` are the symbols seen between items i - 1 and i."""

    items: list[str]
    gaps: list[set[str]]
    count: int = 0

    def dumps(self) -> str:
        return json.dumps([self.items, [sorted(g) for g in self.gaps]])

    @staticmethod
    def loads(text: str, count: int) -> Template:
        items, gaps = json.loads(text)
        return Template(items, [set(g) for g in gaps], count)

    @property
    def anchor(self) -> str:
        at = time_at(self.items)
        return json.dumps(self.items[: at + 1]) if at is not None else ""


def common(a: Template, b: Template) -> Template:
    """The longest common subsequence of two templates, aligned from the left, with what lies between."""
    same = next((i for i, (x, y) in enumerate(zip(a.items, b.items)) if x != y), min(len(a.items), len(b.items)))
    if same:  # what both begin with is common
        rest = common(Template(a.items[same:], a.gaps[same:]), Template(b.items[same:], b.gaps[same:]))
        return Template(a.items[:same] + rest.items, [x | y for x, y in zip(a.gaps[:same], b.gaps[:same])] + rest.gaps, a.count + b.count)
    n, m = len(a.items), len(b.items)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        x = a.items[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b.items[j] else max(below[j], row[j + 1])
    items, gaps, skipped, i, j = [], [], set(), 0, 0
    while i < n and j < m:
        if a.items[i] == b.items[j]:
            items.append(a.items[i])
            gaps.append(skipped | a.gaps[i] | b.gaps[j])
            skipped, i, j = set(), i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            skipped |= {a.items[i]} | a.gaps[i]
            i += 1
        else:
            skipped |= {b.items[j]} | b.gaps[j]
            j += 1
    return Template(items, gaps, a.count + b.count)


def _marks(sequence: Iterable[str]) -> int:
    """How much structure is left: levels and punctuation."""
    return sum(s not in ("WORD", "NUM", "SP") for s in sequence)


def head(t: Template) -> Template:
    """The template as far as it is a head: up to the last punctuation or level before free text, with the blanks after."""
    at = time_at(t.items)
    end = at + 1
    for i in range(at + 1, len(t.items)):
        if t.gaps[i] and not all(s in "[](){}<>NUM" for s in t.gaps[i]):
            break  # what lies in this gap varies: the message has begun
        if t.items[i] not in ("WORD", "NUM", "SP"):
            end = i + 1
    if end < len(t.items) and t.items[end] == "SP" and not t.gaps[end]:
        end += 1
    return Template(t.items[:end], t.gaps[:end], t.count)


def cluster(templates: Iterable[Template]) -> list[Template]:
    """Merges templates, the most frequent first, while their common subsequence keeps the structure of a head."""
    found: dict[str, list[Template]] = {}
    for t in sorted(templates, key=lambda t: (-t.count, t.dumps())):
        anchor = t.anchor
        if not anchor:
            continue
        group = found.setdefault(anchor, [])
        at = time_at(t.items) + 1
        choice, kept = None, None
        for k, known in enumerate(group):
            both = common(known, t)
            h = head(both)
            if _marks(h.items[at:]) >= 1 and (kept is None or len(h.items) > len(head(kept).items)):
                choice, kept = k, both
        if choice is None:
            group.append(t)
        else:
            group[choice] = kept
    return [t for group in found.values() for t in group]


@dataclass
class Keys:
    """What the keys of structured lines hold, in order of preference."""

    time: list[str] = field(default_factory=list)
    level: list[str] = field(default_factory=list)
    component: list[str] = field(default_factory=list)
    message: list[str] = field(default_factory=list)


def parse_pairs(text: str) -> dict[str, str] | None:
    """The pairs of a key=value line, values unquoted; None where the line is anything else."""
    out, at = {}, 0
    text = text.rstrip()
    while at < len(text):
        m = _PAIR.match(text, at)
        if not m:
            return None
        value = m[2]
        if value[:1] == '"':
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), value[1:-1], flags=re.DOTALL)
        out.setdefault(m[1], value)
        at = m.end()
    return out or None


def structured(text: str) -> tuple[str, dict] | None:
    """('json' or 'pairs', fields) of a structured line."""
    if text[:1] == "{":
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        return ("json", value) if isinstance(value, dict) else None
    if re.match(r"[A-Za-z_@][\w.@\-]*=", text):
        pairs = parse_pairs(text)
        return ("pairs", pairs) if pairs else None
    return None


def key_features(form: str, fields: dict) -> list[tuple[str, str]]:
    """(key, feature) counts of a structured line that holds a time; none of others."""
    times = {k for k, v in fields.items() if time_of(v, 0) is not None}
    if not times:
        return []
    out = [("", "n")]
    for k, v in fields.items():
        if v is None or isinstance(v, (dict, list)):
            continue
        out.append((k, "n"))
        if k in times:
            out.append((k, "time"))
        elif level_of(v):
            out.append((k, "level"))
        elif isinstance(v, str) and re.fullmatch(WORD_PATTERN, v):
            out.append((k, "word"))
        if isinstance(v, str) and k not in times:
            out.append((k, "text"))
            if not re.fullmatch(WORD_PATTERN + r"|[\d.]*", v):
                out.append((k, "free"))
    return out


#: Usual names, which only decide between keys whose values are of one kind (fixed values).
_COMPONENTS = ["component", "logger", "name", "module", "program", "service", "app", "source", "unit", "target"]
_MESSAGES = ["msg", "message", "text", "event", "log"]


def key_kind(counts: dict[str, int]) -> str | None:
    """What one key holds, from the counts of its features; None where it is nothing a record needs."""
    n = counts.get("n", 0)
    pure = lambda kind: n and counts.get(kind, 0) >= PURE * n
    if pure("time"):
        return "time"
    if pure("level"):
        return "level"
    if pure("text") and counts.get("free", 0) > 0.3 * n:
        return "message"
    return "component" if pure("word") else None


def arranged(kinds: Iterable[tuple[str, str, int]]) -> Keys:
    """Keys of one form, given as (key, kind, lines), in order of preference."""
    total: dict[str, dict[str, int]] = {"time": {}, "level": {}, "component": {}, "message": {}}
    for key, kind, n in kinds:
        total[kind][key] = n

    def ranked(kind: str, usual: Iterable[str] = ()) -> list[str]:
        place = {name: i for i, name in enumerate(usual)}
        return sorted(total[kind], key=lambda k: (place.get(k.lower(), len(place)), -total[kind][k], k))

    return Keys(ranked("time"), ranked("level"), ranked("component", _COMPONENTS), ranked("message", _MESSAGES))


def classify(counts: dict[tuple[str, str], int]) -> Keys:
    """Keys of one form by kind, from summed key_features."""
    by: dict[str, dict[str, int]] = {}
    for (k, f), n in counts.items():
        if k:
            by.setdefault(k, {})[f] = n
    return arranged((k, kind, c["n"]) for k, c in by.items() if (kind := key_kind(c)))


@dataclass
class Head:
    event_us: int | None
    level: str
    component: str
    message: str


class Parser:
    """Recognises heads by templates and classified keys."""

    def __init__(self, templates: list[Template], keys: dict[str, Keys]):
        self.keys = keys
        self.compiled = [self._compile(head(t)) for t in sorted(templates, key=lambda t: (-t.count, t.dumps())) if _marks(head(t).items[time_at(t.items) + 1 :]) or time_at(t.items)]

    @staticmethod
    def _compile(t: Template) -> tuple[re.Pattern, re.Pattern, int | None]:
        """(pattern, time pattern, number of the component's word); levels and words are groups."""
        parts: list[str] = []
        words = 0
        single = {"WORD": WORD_PATTERN, "NUM": r"\d+", "SP": r"[ \t]+", "LEVEL": r"[^\W\d]+", "PRI": r"<\d{1,3}>"}
        notation = ""
        for i, s in enumerate(t.items):
            if t.gaps[i]:
                inner = "|".join(sorted(single.get(g, _UNNAMED.get(g[2:], re.escape(g)) if g.startswith("T_") else re.escape(g)) for g in t.gaps[i]))
                parts.append(f"(?:{inner})*?")
            if s.startswith("T_"):
                notation = s[2:]
                parts.append(f"(?P<time>{re.sub(r'\\ ', '[ ]', _UNNAMED[notation])})")
            elif s == "WORD":
                words += 1
                parts.append(f"(?P<w{words}>{WORD_PATTERN})")
            elif s == "LEVEL":
                parts.append(r"(?P<level>[^\W\d]+)" if "(?P<level>" not in "".join(parts) else r"[^\W\d]+")
            elif s == "PRI":
                parts.append(r"<(?P<pri>\d{1,3})>")
            elif s == "SP" and i == len(t.items) - 1:
                parts.append(r"(?:[ ]|\t|$)")  # one blank: further ones belong to the message
            else:
                parts.append(single.get(s, re.escape(s)))
        return re.compile("".join(parts)), PATTERNS[notation], words or None

    def parse(self, text: str, near_ns: int | None) -> Head | None:
        """The head of a payload, with the rest as its message, or None for a line that continues another."""
        if found := structured(text):
            if (keys := self.keys.get(found[0])) and (h := self._fields(keys, found[1], near_ns)):
                return h
        for pattern, time, component in self.compiled:
            if (m := pattern.match(text)) and (t := time.fullmatch(m["time"])):
                at = event_micros(t, near_ns)
                if at is None and near_ns is not None:
                    continue
                g = m.groupdict()
                level = ""
                if g.get("level"):
                    level = LEVELS.get(g["level"].lower(), "")
                    if not level:
                        continue
                elif t.groupdict().get("l"):
                    level = LETTERS[t["l"]]
                elif g.get("pri"):
                    level = SYSLOG[int(g["pri"]) % 8]
                return Head(at, level, g.get(f"w{component}") or "" if component else "", text[m.end() :])
        return None

    @staticmethod
    def _fields(keys: Keys, fields: dict, near_ns: int | None) -> Head | None:
        at = next((t for k in keys.time if k in fields and (t := time_of(fields[k], near_ns)) is not None), None)
        if at is None:
            return None
        level = next((x for k in keys.level if (x := level_of(fields[k]) if fields.get(k) is not None else "")), "")
        component = next((str(fields[k]) for k in keys.component if fields.get(k) not in (None, "")), "")
        message = next((k for k in keys.message if k in fields), None)
        if message is None and not level and not component:
            return None
        value = fields.get(message)
        return Head(at, level, component, "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
