"""What a text must hold for a pattern to match it: groups of literals, one of each group."""

from __future__ import annotations

import functools
import re

#: Literals of a group, and characters of a class that are told apart, at most.
MOST, WIDE = 40, 8


@functools.cache
def needs(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case literals; every match, lower-cased, holds a literal of each group. None if that can't be told.

    Literals are of ASCII and of characters without case, which no flag of a pattern changes.

    A sequence needs what each of its parts needs; small classes of characters are spelt out. Of alternatives
    one group is made, if each of them has one. What may be left out, and look-around, needs nothing.
    """
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return ()
    found = _groups(tree)
    long = [g for g in found if min(map(_bytes, g)) > 2]  # pairs of letters stand in most texts
    return tuple(sorted({tuple(sorted(g)) for g in long or found}))


@functools.cache
def formula(pattern: str) -> tuple:
    """What ``needs`` tells, told sharper: all of the parts of a tuple, a part being a set of literals of which one must stand there, or a list of such tuples of which one must hold.

    So each alternative of a pattern keeps all that it needs, where ``needs`` has one literal of any of them.
    """
    try:
        return _parts(re._parser.parse(pattern))
    except re.error:
        return ()


@functools.cache
def plain(pattern: str) -> bool:
    """Whether a pattern is nothing but ASCII literals without regard to case, so that a text that holds what it needs matches it."""
    words = pattern.removeprefix("(?i)").split("|")
    # what all alternatives begin with is a part of its own to the parser, which then tells less
    apart = len(words) == 1 or len({w[:1].lower() for w in words}) > 1
    return pattern.startswith("(?i)") and apart and all(len(w) > 2 and re.fullmatch(r"[A-Za-z0-9_ /:=@,-]+", w) for w in words)


def _shortest(part) -> int:
    return min(map(_bytes, part)) if isinstance(part, frozenset) else min(max(map(_shortest, one)) for one in part)


def _parts(tree) -> tuple:
    out = list(_sequence(tree, lambda arms: [list(arms)] if all(arms) else [], _parts, frozenset))
    return tuple([p for p in out if _shortest(p) > 2] or out)  # pairs of letters stand in most texts


def _letters(op: str, arg) -> set[str] | None:
    if op == "LITERAL" and _plain(arg):
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) == "LITERAL" and _plain(a) for o, a in arg) and len(arg) <= WIDE:
        return {chr(a).lower() for _, a in arg}
    return None


def _plain(code: int) -> bool:
    return code < 128 or chr(code).lower() == chr(code) == chr(code).upper()


def _bytes(word: str) -> int:
    return len(word.encode())


def _groups(tree) -> list[set[str]]:
    def merged(parts: list) -> list[set[str]]:
        if not all(parts):
            return []
        best = set().union(*[max(p, key=lambda g: (min(map(len, g)), -len(g))) for p in parts])
        return [best] if len(best) <= MOST else []

    return _sequence(tree, merged, _groups, set)


def _sequence(tree, branch, inner, group) -> list:
    """What each part of a sequence needs: ``group`` of literals, and what ``branch`` makes of alternatives."""
    out = []
    run = {""}

    def close() -> None:
        if min(map(_bytes, run)) > 1:
            out.append(group(run))

    for op, arg in tree:
        kind = str(op)
        if letters := _letters(kind, arg):
            if len(run) * len(letters) > MOST:
                close()
                run = {""}
            run = {a + b for a in run for b in letters}
            continue
        close()
        run = {""}
        if kind == "SUBPATTERN":
            out += inner(arg[-1])
        elif kind == "BRANCH":
            out += branch([inner(x) for x in arg[1]])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += inner(arg[2])
    close()
    return out
