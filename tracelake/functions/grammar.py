"""Small languages of the query surface: index ranges, points in time, label selectors. Pure Python, at planning time."""

from __future__ import annotations

import re
import re._constants as sre
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Inclusive bounds of positions from 0; negative ones count from the end; None is open."""

    first: int | None
    last: int | None

    def holds(self, index: Column, size: Column) -> Column:
        """Whether an index is inside, for a sequence of the given size."""
        place = lambda k: F.lit(k) if k >= 0 else size + k
        ok = F.lit(True)
        if self.first is not None:
            ok = ok & (index >= place(self.first))
        if self.last is not None:
            ok = ok & (index <= place(self.last))
        return ok


def parse_range(spec: str) -> Range:
    """`N`, `A..B`, `N..`, `..N`, `-k` (the k-th from the end)."""
    m = re.fullmatch(r"(-?\d+)?(\.\.)?(-?\d+)?", spec.strip())
    if not m or spec.strip() in ("", ".."):
        raise ValueError(f"not a range: {spec!r}")
    a, dots, b = m.groups()
    if not dots:
        if a is None or b is not None:
            raise ValueError(f"not a range: {spec!r}")
        return Range(int(a), int(a))
    lo, hi = (int(a) if a else None), (int(b) if b else None)
    if lo is not None and hi is not None and (lo < 0) == (hi < 0) and lo > hi:
        raise ValueError(f"the range ends before it begins: {spec!r}")
    return Range(lo, hi)


#: Months and years are fixed spans, not calendar ones.
SPANS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}


def parse_when(spec: str, now: datetime, zone: timezone = timezone.utc) -> datetime:
    """`now`, a span back from now (`2h`, `3d`, `2mo`), an ISO instant, or a date (local midnight)."""
    spec = spec.strip()
    if spec == "now":
        return now
    if m := re.fullmatch(r"(\d+)(s|mo|m|h|d|w|y)", spec):
        return now - timedelta(seconds=int(m[1]) * SPANS[m[2]])
    if re.fullmatch(r"\d{4}-\d\d-\d\d", spec):
        return datetime.fromisoformat(spec).replace(tzinfo=zone)
    got = datetime.fromisoformat(spec.replace("Z", "+00:00"))
    return got if got.tzinfo else got.replace(tzinfo=zone)


def window(ts: Column, since: datetime | None, until: datetime | None) -> Column:
    """Inclusive; a bounded window never holds a row without a time, an unbounded one holds all."""
    if since is not None and until is not None and until < since:
        raise ValueError("the window ends before it begins")
    ok = F.lit(True)
    if since is not None:
        ok = ok & F.coalesce(ts >= F.lit(since), F.lit(False))
    if until is not None:
        ok = ok & F.coalesce(ts <= F.lit(until), F.lit(False))
    return ok


@dataclass(frozen=True)
class Selector:
    """A bare role or category (`user`: what the model sees of it), `x.*` (all below), or one leaf."""

    face: str
    glob: bool

    def matches(self, label: Column, visible: Column) -> Column:
        below = label.startswith(self.face + ".")
        if self.glob:
            return below
        return (label == self.face) | (below & visible)


def parse_selector(spec: str) -> Selector:
    if not re.fullmatch(r"[a-z][a-z-]*(\.[a-z][a-z-]*)*(\.\*)?", spec):
        raise ValueError(f"not a label selector: {spec!r}")
    return Selector(spec.removesuffix(".*"), spec.endswith(".*"))


def selected(label: Column, visible: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include selector, and no exclude selector, matches. Without includes: what is visible."""
    some = F.lit(False)
    for s in include:
        some = some | parse_selector(s).matches(label, visible)
    if not include:
        some = visible
    for s in exclude:
        some = some & ~parse_selector(s).matches(label, visible)
    return some


def smart_case(pattern: str, ignore: bool = False) -> str:
    """A pattern that ignores case unless it spells an upper-case letter (escapes like \\W don't count)."""
    literal = re.sub(r"\\(?:[pP]\{[^}]*\}|[pPxu]|.)", "", pattern)
    return "(?i)" + pattern if ignore or not any(c.isupper() for c in literal) else pattern


#: Most needles of a filter, and the fewest characters of one.
NEEDLES, NEEDLE = 8, 3


def _needles(parsed) -> list[str] | None:
    """Strings of which every match of a parsed pattern holds one as it is; None where there is no such set."""
    best: list[str] | None = None
    run = ""

    def offer(some: list[str] | None) -> None:
        nonlocal best
        # a long shortest needle first, then few of them
        if some and (best is None or (min(map(len, some)), -len(some)) > (min(map(len, best)), -len(best))):
            best = some

    for op, arg in [*parsed, (None, None)]:
        if op is sre.LITERAL and chr(arg).isascii() and not chr(arg).isspace() and chr(arg).isprintable() and chr(arg) not in '"\\':
            run += chr(arg)
            continue
        if len(run) >= NEEDLE:
            offer([run])
        run = ""
        if op is sre.SUBPATTERN:
            offer(_needles(arg[3]))
        elif op is sre.BRANCH:
            each = [_needles(x) for x in arg[1]]
            offer(list(dict.fromkeys(n for x in each for n in x)) if all(each) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            offer(_needles(arg[2]))
    return best


def needles(pattern: str) -> list[str]:
    """Literals of which every match holds one in the raw line as it is (no white space, nothing that JSON escapes): a
    filter before anything is parsed. Empty where a match may hold none."""
    if re.search(r"\(\?[a-zA-Z-]*[ix]", pattern):  # flags of its own
        return []
    try:
        found = _needles(re._parser.parse(pattern))
    except (re.error, OverflowError):
        return []
    return found if found and len(found) <= NEEDLES else []


def may_match(raw: Column, pattern: str, ignore: bool = False) -> Column:
    """Whether a raw line can hold a match: it has one of the pattern's needles. True where the pattern has none."""
    some = needles(pattern)
    folded = smart_case(pattern, ignore) != pattern
    hay = F.lower(raw) if folded else raw
    out = F.lit(not some)
    for n in some:
        out = out | hay.contains(n.lower() if folded else n)
    return out


def intersects(first: Column, last: Column, since: Column | None, until: Column | None) -> Column:
    """Whether the span from first to last meets the window; an open side holds all, a missing time is outside a bound."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & F.coalesce(last >= since, F.lit(False))
    if until is not None:
        ok = ok & F.coalesce(first <= until, F.lit(False))
    return ok


def faces(labels: list[str]) -> list[str]:
    """All selectors that name something: every beginning of every label, once, in order."""
    return list(dict.fromkeys(".".join(x.split(".")[:k]) for x in labels for k in range(1, x.count(".") + 2)))


def statically_empty(include: list[str], exclude: list[str], labels: list[str], invisible: list[str]) -> bool:
    """Whether no label can pass the selectors."""

    def hit(spec: str, label: str) -> bool:
        s = parse_selector(spec)
        below = label.startswith(s.face + ".")
        return below if s.glob else label == s.face or (below and label not in invisible)

    return not any((any(hit(s, x) for s in include) if include else x not in invisible) and not any(hit(s, x) for s in exclude) for x in labels)
