"""Literals that a pattern cannot match without: a line that holds none of them needs no regular expression."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser

#: Shortest literal that is worth a search.
LEAST = 2


def _better(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether a filters more: a longer shortest literal, then fewer of them."""
    return not b or (min(map(len, a)), -len(a)) > (min(map(len, b)), -len(b))


def _of(tokens) -> tuple[str, ...]:
    best: tuple[str, ...] = ()
    run = ""
    for kind, value in [*tokens, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        found: list[tuple[str, ...]] = [(run,)] if len(run) >= LEAST else []
        run = ""
        if kind is op.SUBPATTERN:
            found.append(_of(value[3]))
        elif kind is op.BRANCH:
            parts = [_of(x) for x in value[1]]
            found.append(tuple(dict.fromkeys(x for p in parts for x in p)) if all(parts) else ())
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_of(value[2]))
        for f in found:
            if f and _better(f, best):
                best = f
    return best


@lru_cache(None)
def literals(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(literals, whether case does not matter): every match of the pattern holds one of the literals at least. None, where nothing is
    certain: a pattern that Python does not read, parts that may be absent, alternatives without literals. Literals with letters beyond
    ASCII are not used where case does not matter."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return (), False
    folded = bool(parsed.state.flags & re.IGNORECASE)
    found = _of(parsed)
    if folded:
        found = tuple(x.lower() for x in found) if all(x.isascii() for x in found) else ()
    return found, folded
