"""What a text must hold before a pattern can match in it: literals, derived from the pattern once on the driver.

A search for a few literals reads the text's bytes; a search for a pattern tries it at every place.  So a scan of many
patterns first asks for their literals, and runs a pattern only where one of its own is there.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST_STRINGS, _MOST_LITERALS, _SHORTEST = 200, 60, 2


def _strings(op, arg) -> set[str] | None:
    """All strings that an element of a parsed pattern can match, where they are few; None where they are not."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:  # takes up nothing
        return {""}
    if op is C.IN:
        return {chr(v).lower() for _, v in arg} if all(kind is C.LITERAL for kind, v in arg) else None
    if op is C.SUBPATTERN:
        return _all(arg[3])
    if op is C.BRANCH:
        return _union([_all(x) for x in arg[1]])
    if op is C.MAX_REPEAT and arg[1] == 1:
        inner = _all(arg[2])
        return inner if arg[0] == 1 or inner is None else inner | {""}
    return None


def _union(sets: list[set[str] | None]) -> set[str] | None:
    if any(s is None for s in sets):
        return None
    out = set().union(*sets)
    return out if len(out) <= _MOST_STRINGS else None


def _joined(a: set[str], b: set[str] | None) -> set[str] | None:
    return None if b is None or len(a) * len(b) > _MOST_STRINGS else {x + y for x in a for y in b}


def _all(parsed) -> set[str] | None:
    out: set[str] | None = {""}
    for op, arg in parsed:
        out = None if out is None else _joined(out, _strings(op, arg))
    return out


def _rank(literals: frozenset[str]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _inner(op, arg) -> frozenset[str] | None:
    """Literals of which an element's match holds one."""
    if op is C.SUBPATTERN:
        return _needed(arg[3])
    if op is C.MAX_REPEAT and arg[0] >= 1:
        return _needed(arg[2])
    if op is C.BRANCH:
        each = [_needed(x) for x in arg[1]]
        return None if any(x is None for x in each) else frozenset().union(*each)
    return None


def _needed(parsed) -> frozenset[str] | None:
    found, now = [], {""}
    for op, arg in [*parsed, (None, None)]:
        more = None if op is None else _joined(now, _strings(op, arg))
        if more is not None:
            now = more
            continue
        found.append(frozenset(now))
        own = None if op is None else _strings(op, arg)
        now = own if own is not None else {""}
        if op is not None and own is None and (inner := _inner(op, arg)):
            found.append(inner)
    good = [x for x in found if all(x) and len(x) <= _MOST_LITERALS]
    return max(good, key=_rank, default=None)


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of a pattern holds one, whatever its case; none where no good ones are found.

    Of literals that hold one another only the shorter is given.
    """
    try:
        found = _needed(P.parse(pattern))
    except re.error:  # what only the JVM's patterns know
        return ()
    if not found or _rank(found)[0] < _SHORTEST or not all(x.isascii() for x in found):
        return ()
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def may_match(text: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Whether a text holds a literal that the pattern needs; true where none is known.

    lowered: the text in lower case, where it is at hand; else it is lowered for each literal.
    """
    literals = required(pattern)
    if not literals:
        return F.lit(True)
    lowered = F.lower(text) if lowered is None else lowered
    return reduce(Column.__or__, [F.contains(lowered, F.lit(x)) for x in literals])
