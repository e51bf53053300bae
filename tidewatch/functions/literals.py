"""Literals that every match of a pattern holds, so that most texts need no pattern at all."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a pattern without case takes for s, k or i, though they do not become these in lower case.
FOLDED = ("\u017f\u212a\u0130\u0131", "skii")


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern holds one at least; None if none are known.

    Of the parts that follow one another the one with the longest shortest literal is taken, of alternatives all.
    """
    return _of(_parser.parse(pattern))


def _better(one: frozenset[str] | None, two: frozenset[str] | None) -> frozenset[str] | None:
    if one is None or two is None:
        return one if two is None else two
    worth = lambda s: (min(map(len, s)), -len(s))
    return max(one, two, key=worth)


def _of(parts) -> frozenset[str] | None:
    best, run = None, ""

    def ended() -> None:
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run.lower()]))
        run = ""

    for op, value in parts:
        if op is c.LITERAL and len(chr(value).lower()) == 1:
            run += chr(value)
            continue
        ended()
        if op is c.SUBPATTERN:
            best = _better(best, _of(value[3]))
        elif op is c.BRANCH:
            each = [_of(p) for p in value[1]]
            if all(each):
                best = _better(best, frozenset().union(*each))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _of(value[2]))
        elif op is c.ATOMIC_GROUP:
            best = _better(best, _of(value))
    ended()
    return best


def folded(text: Column) -> Column:
    """text as literals() looks at it; plain ASCII has none of the letters to translate."""
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, *FOLDED)))


def any_of(literals: Iterable[str]) -> str:
    """A pattern that finds, at every place of a folded text, the longest of the literals that begins there."""
    first: dict[str, list[str]] = {}
    for x in sorted(literals, key=lambda x: (-len(x), x)):
        first.setdefault(x[0], []).append(x[1:])
    return "(?=(" + _halved([(quoted(c), quoted(c) + "(?:" + "|".join(map(quoted, rest)) + ")") for c, rest in sorted(first.items())]) + "))"


def _halved(each: list[tuple[str, str]]) -> str:
    """Alternatives (first sign, pattern), halved by first sign again and again: few of them are tried at a place."""
    if len(each) < 4:
        return "|".join(p for _, p in each)
    halves = each[: len(each) // 2], each[len(each) // 2 :]
    return "|".join("(?=[" + "".join(c for c, _ in half) + "])(?:" + _halved(half) + ")" for half in halves)


def quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def rules_to_try(text: Column, needed: list[frozenset[str] | None]) -> Column:
    """Numbers of the patterns (with the literals that they need) that a text can meet: one scan for all literals."""
    literals = frozenset().union(*filter(None, needed))
    always = [i for i, own in enumerate(needed) if own is None]
    if not literals:
        return F.array(*map(F.lit, always)).cast("array<int>")
    meant = {x: sorted(i for i, own in enumerate(needed) if own and any(y in x for y in own)) for x in literals}  # a literal holds its parts, too
    table = F.create_map(*[c for x, numbers in sorted(meant.items()) for c in (F.lit(x), F.array(*map(F.lit, numbers)))])
    found = F.regexp_extract_all(folded(text), F.lit(any_of(literals)), F.lit(1))
    tried = F.flatten(F.transform(F.array_distinct(found), lambda x: table[x]))
    return F.array_distinct(F.concat(tried, F.array(*map(F.lit, always)).cast("array<int>")) if always else tried)


def can_match(text: Column, needed: list[frozenset[str] | None]) -> Column:
    """Whether a text of any length holds a literal that one of the patterns needs."""
    if None in needed:
        return F.lit(True)
    return folded(text).rlike(any_of(frozenset().union(*needed)))
