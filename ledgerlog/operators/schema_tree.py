"""Tree edit distance between nested schemas, with profiles of the values the fields hold.

A schema is an unordered tree: fields below the object, nested fields below their field.  The minimum-cost script
adds, deletes, renames, retypes and moves fields.  What differs below matched nodes is assigned to each other at
minimum cost, renames and moves in one table (constrained edit distance of unordered trees; the assignment is exact in
each round, and each round matches what lies below the last one's pairs), and every pair's cost holds the distance of
their subtrees and of their values.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from zlib import crc32

ADD, DELETE, RETYPE, MOVE = 1.0, 1.0, 0.6, 0.5
#: Two fields hold the same kind of values if the distance of their profiles is at most this.
SAME_VALUES = 0.5
#: Buckets of a hashed histogram of values: a profile has a bounded size whatever the field holds.
BUCKETS = 512


@dataclass
class Node:
    name: str
    kind: str
    profile: dict[str, int] = field(default_factory=dict)
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


@dataclass(frozen=True)
class Edit:
    op: str  # added, removed, renamed, retyped, moved
    old: tuple[str, ...]
    new: tuple[str, ...]


def value_features(value: object) -> Iterable[str]:
    """What a field's profile counts of one value: `n`, its shape `s:…`, its length `l:…`, buckets of its words `w:…`
    and of itself `v:…`, its size `m:…`."""
    yield "n"
    if isinstance(value, bool):
        yield "s:bool"
    elif isinstance(value, (int, float)):
        yield "m:" + ("-" if value < 0 else "") + (str(int(2 * math.log10(abs(value) + 1))) if math.isfinite(value) else "x")
        yield f"v:{crc32(repr(value).encode()) % BUCKETS}"
    elif isinstance(value, str):
        yield "s:" + _shape(value)
        yield f"l:{min(len(value), 32)}"
        for word in re.findall(r"[^\W\d_]+", value):
            yield f"w:{crc32(word.encode('utf-8', 'surrogatepass')) % BUCKETS}"
        yield f"v:{crc32(value.encode('utf-8', 'surrogatepass')) % BUCKETS}"
    elif isinstance(value, list):
        for x in value[:1]:
            yield "e:" + type(x).__name__
        for x in value:
            if isinstance(x, str):
                yield "s:" + _shape(x)
            yield f"v:{crc32(repr(x).encode('utf-8', 'surrogatepass')) % BUCKETS}"
    elif isinstance(value, dict):
        for k, x in value.items():
            yield f"s:{k}:{type(x).__name__}"


def _shape(text: str) -> str:
    """Runs of digits, of letters and of blanks collapse; digits keep the length of their run; long ones end in a hash."""
    out = re.sub(r"[^\W\d_]+", "a", text)
    out = re.sub(r"\d+", lambda m: "9" * min(4, len(m[0])), out)
    out = re.sub(r"a(?:[ _]a)+", "a a", re.sub(r"\s+", " ", out))
    return out if len(out) <= 24 else f"{out[:16]}#{crc32(out.encode()) % BUCKETS}"


def _part(profile: dict[str, int], kind: str) -> dict[str, float]:
    some = {k: v for k, v in profile.items() if k.startswith(kind)}
    total = sum(some.values())
    return {k: v / total for k, v in some.items()} if total else {}


def _overlap(a: dict[str, float], b: dict[str, float]) -> float:
    return sum(min(v, b.get(k, 0.0)) for k, v in a.items())


def _repeats(profile: dict[str, int], kind: str = "v:") -> float:
    """How concentrated the values are: 0 where all differ, towards 1 where few recur (by chance of two being equal)."""
    values = [v for k, v in profile.items() if k.startswith(kind)]
    n = sum(values)
    if n < 2:
        return 0.0
    same = sum(v * (v - 1) for v in values) / (n * (n - 1))
    return max(0.0, (same - 1 / BUCKETS) / (1 - 1 / BUCKETS))


def value_distance(a: Node, b: Node) -> float:
    """0 (the same kind of values) to 1.  Values of another JSON kind are as far as can be."""
    if a.kind != b.kind:
        return 1.0
    if not a.profile or not b.profile:
        return 1.0  # values that nobody looked at tell nothing
    shapes, values, sizes = (_overlap(_part(a.profile, k), _part(b.profile, k)) for k in ("s:", "v:", "m:"))
    ra, rb = _repeats(a.profile), _repeats(b.profile)
    if a.kind in ("integer", "number"):
        near = _overlap(_blurred(a.profile), _blurred(b.profile))
        return 1 - max(near * (1 - abs(ra - rb)), values * (ra > 0.1 and rb > 0.1), min(sizes, near))
    if a.kind in ("string", "array"):
        words = {k for p in (a.profile, b.profile) for k in p if re.fullmatch(r"s:(a( a)*)?", k)}
        if all(k in words for p in (a.profile, b.profile) for k in p if k.startswith("s:")):
            # only words: they tell by which words recur, and by whether any do
            lengths = _overlap(_part(a.profile, "l:"), _part(b.profile, "l:"))
            return 1 - max(values, shapes * lengths * (1 - min(1.0, 4 * abs(ra - rb))) * (ra < 0.1 and rb < 0.1))
        known = values if ra > 0.03 and rb > 0.03 else 0.0
        if min(_repeats(a.profile, "w:"), _repeats(b.profile, "w:")) > 0.03:
            known = max(known, _overlap(_part(a.profile, "w:"), _part(b.profile, "w:")))
        sa, sb = _part(a.profile, "s:"), _part(b.profile, "s:")
        telling = sum(min(n, sb.get(k, 0.0)) for k, n in sa.items() if k not in words)
        # words beside other shapes are alike only as far as the same ones recur
        return (1 - known) * (1 - telling - (shapes - telling) * known)
    return 1 - shapes


def _blurred(profile: dict[str, int]) -> dict[str, float]:
    """Sizes spread over their neighbours, since few values fill few of them."""
    out: dict[str, float] = {}
    for k, v in _part(profile, "m:").items():
        at = k[2:]
        if not at.lstrip("-").isdigit():
            out[k] = out.get(k, 0) + v
            continue
        for step, part in ((-1, 0.25), (0, 0.5), (1, 0.25)):
            key = f"m:{int(at) + step}"
            out[key] = out.get(key, 0) + v * part
    return out


def _assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost column of each row (rows at most columns), by shortest augmenting paths."""
    rows, columns = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1)
    for row in range(1, rows + 1):
        match[0], at = row, 0
        least, way, used = [math.inf] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while True:
            used[at] = True
            i, delta, to = match[at], math.inf, 0
            for j in range(1, columns + 1):
                if not used[j]:
                    now = cost[i - 1][j - 1] - u[i] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < delta:
                        delta, to = least[j], j
            for j in range(columns + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = to
            if not match[at]:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [0] * rows
    for j in range(1, columns + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _rename_cost(a: Node, b: Node) -> float:
    """Below ADD + DELETE only where the values are of one kind; names and fill rates only break ties."""
    far = value_distance(a, b)
    if far > SAME_VALUES:
        return math.inf
    name = 1 - SequenceMatcher(None, a.name.lower(), b.name.lower()).ratio()
    na, nb = a.profile.get("n", 0), b.profile.get("n", 0)
    fa, fb = na / max(1, a.profile.get("of", na)), nb / max(1, b.profile.get("of", nb))
    return 0.3 + far + 0.2 * abs(fa - fb) + 0.1 * name + 0.1 * script(a, b)[0]


@dataclass(eq=False)
class _Loose:
    """A field that only one of two matched parents has; ``parents`` is the number of that pair, -1 inside such a field.

    ``share`` is 0 below a rename or a move, whose cost holds it already.
    """

    node: Node
    path: tuple[str, ...]
    parents: int
    share: int


def _pair_cost(a: _Loose, b: _Loose) -> float:
    """A rename between matched parents, a move between others."""
    if a.parents == b.parents:
        return _rename_cost(a.node, b.node)
    if a.node.name != b.node.name or a.node.kind != b.node.kind:
        return math.inf
    return MOVE + script(a.node, b.node)[0]


def _matched(gone: list[_Loose], come: list[_Loose]) -> list[tuple[_Loose, _Loose, float]]:
    """The renames and moves of the cheapest assignment, all parents at once, with their costs."""
    if not gone or not come:
        return []
    big = 1e6
    drop, put = [DELETE * g.node.size() for g in gone], [ADD * c.node.size() for c in come]
    costs = [[_pair_cost(g, c) for c in come] for g in gone]
    table = [[min(big, x - put[j]) for j, x in enumerate(line)] + [drop[i] if k == i else big for k in range(len(gone))] for i, line in enumerate(costs)]
    return [(gone[i], come[j], costs[i][j]) for i, j in enumerate(_assign(table)) if j < len(come) and table[i][j] < drop[i]]


def _below(x: _Loose) -> list[_Loose]:
    """A field and all below it, each before those below it."""
    return [x] + [y for name in sorted(x.node.children) for y in _below(_Loose(x.node.children[name], (*x.path, name), -1, x.share))]


def script(old: Node, new: Node, path: tuple[str, ...] = ()) -> tuple[float, list[Edit]]:
    """Cost and edits that turn the fields below ``old`` into those below ``new``.

    Fields of one name and place are matched; all others, of every depth, are assigned to each other in one table of
    renames, moves, removes and adds.  What lies below a rename or a move joins the next round, and last the fields
    inside removed ones are moved into their place in added ones.  Below a renamed field paths have its new name.
    """
    cost, edits = 0.0, []
    gone: list[_Loose] = []
    come: list[_Loose] = []
    parents = 0

    def walk(a: Node, b: Node, path: tuple[str, ...], share: int) -> None:
        nonlocal cost, parents
        parents += 1
        for side, x, y in ((gone, a, b), (come, b, a)):
            side.extend(_Loose(x.children[name], (*path, name), parents, share) for name in sorted(x.children.keys() - y.children.keys()))
        for name in sorted(a.children.keys() & b.children.keys()):
            x, y = a.children[name], b.children[name]
            if x.kind != y.kind:
                cost += RETYPE * share
                edits.append(Edit("retyped", (*path, name), (*path, name)))
            else:
                walk(x, y, (*path, name), share)

    walk(old, new, path, 1)
    while pairs := _matched(gone, come):
        for g, c, x in pairs:
            gone.remove(g)
            come.remove(c)
            cost += x
            edits.append(Edit("renamed" if g.parents == c.parents else "moved", g.path, c.path))
        for g, c, _ in pairs:
            walk(g.node, c.node, c.path, 0)
    drop = lambda g: DELETE * g.node.size() * g.share
    put = lambda c: ADD * c.node.size() * c.share
    cost += sum(map(drop, gone)) + sum(map(put, come))
    edits += [Edit("removed", g.path, ()) for g in gone] + [Edit("added", (), c.path) for c in come]
    targets = [y for c in come for y in _below(c)]
    within = lambda path, above: path[: len(above)] == above
    out: tuple[str, ...] | None = None
    for g in [y for x in gone for y in _below(x)]:
        if out is not None and within(g.path, out):
            continue  # it goes along
        twin = next((c for c in targets if c.node.name == g.node.name and c.node.kind == g.node.kind and (g.parents < 0 or c.parents < 0)), None)
        if twin is None:
            continue
        rest, deeper = script(g.node, twin.node, twin.path)
        if MOVE + rest >= DELETE * g.node.size() + ADD * twin.node.size():
            continue
        out = g.path
        targets = [c for c in targets if not within(c.path, twin.path) and not within(twin.path, c.path)]
        cost += MOVE + rest - drop(g) - put(twin)
        edits = [e for e in edits if e not in (Edit("removed", g.path, ()), Edit("added", (), twin.path))] + [Edit("moved", g.path, twin.path), *deeper]
    return cost, edits


def with_moves(edits: list[Edit], old: Node, new: Node) -> list[Edit]:
    """Fields that go in one place and come, under the same name and kind, in another are moved."""

    def at(node: Node, path: tuple[str, ...]) -> Node | None:
        for p in path:
            if (node := node.children.get(p)) is None:
                return None
        return node

    out, taken = [], set()
    come = [e for e in edits if e.op == "added"]
    for e in edits:
        if e.op == "removed":
            twin = next((c for c in come if c not in taken and c.new[-1] == e.old[-1] and c.new != e.old and (x := at(old, e.old)) and (y := at(new, c.new)) and x.kind == y.kind), None)
            if twin:
                taken.add(twin)
                out.append(Edit("moved", e.old, twin.new))
                continue
        out.append(e)
    return [e for e in out if e not in taken]
