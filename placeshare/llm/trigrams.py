"""Boolean trigram queries that every match of a regular expression satisfies.

A query says which trigrams a text must hold to be able to match: a set of trigrams (all of them), an
``And`` or an ``Or`` of queries. ``ANY`` holds for every text, so it is the query of an expression without mandatory trigrams.
Trigrams are of the lower-cased text, so a query holds for both cases of an expression.

Each part of an expression has the strings it can match, as long as they are few; else the strings that it
begins and ends with, and what it demands inside. Parts that follow each other are joined string by string,
so trigrams across their border are demanded, too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

FEW = 64


@dataclass(frozen=True)
class And:
    parts: frozenset


@dataclass(frozen=True)
class Or:
    parts: frozenset


ANY = And(frozenset())


def all_of(*queries):
    parts = set()
    for q in queries:
        parts |= q.parts if isinstance(q, And) else {q}
    return next(iter(parts)) if len(parts) == 1 else And(frozenset(parts))


def any_of(*queries):
    parts = set()
    for q in queries:
        if q == ANY:
            return ANY
        parts |= q.parts if isinstance(q, Or) else {q}
    parts = {q for q in parts if not any(_asks_less(o, q) for o in parts if o != q)}
    return next(iter(parts)) if len(parts) == 1 else Or(frozenset(parts))


def _asks_less(a, b) -> bool:
    """Whether a conjunction has some of the parts of another only, so that the other adds nothing to ``a or b``."""
    x, y = (q.parts if isinstance(q, And) else frozenset([q]) for q in (a, b))
    return x < y


def trigrams_of(query) -> set[str]:
    """The trigrams that a query asks for."""
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query.parts))


def holds(query, trigrams: set[str]) -> bool:
    if isinstance(query, str):
        return query in trigrams
    return (all if isinstance(query, And) else any)(holds(p, trigrams) for p in query.parts)


def demanded(strings: frozenset[str]):
    """What a text holds that has one of these strings in it."""
    if not strings:
        return ANY
    return any_of(*(all_of(*(s[i: i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class Part:
    """What is known of a part: all its strings, or else how it begins and ends, and what it demands."""

    exact: frozenset[str] | None
    first: frozenset[str] = frozenset([""])
    last: frozenset[str] = frozenset([""])
    inside: And | Or | str = ANY

    def opened(self) -> Part:
        """The same with its strings forgotten but for two signs at each end."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), demanded(self.exact))


EMPTY, UNKNOWN = Part(frozenset([""])), Part(None)


def joined(strings, others) -> frozenset[str]:
    return frozenset(a + b for a, b in product(strings, others))


def followed(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        both = joined(a.exact, b.exact)
        if len(both) <= FEW:
            return Part(both)
    border = joined(a.exact if a.exact is not None else a.last, b.exact if b.exact is not None else b.first)
    x, y = a.opened(), b.opened()
    border_query = demanded(border) if len(border) <= FEW else ANY
    first = x.first if a.exact is None else frozenset(s[:2] for s in joined(a.exact, y.first))
    last = y.last if b.exact is None else frozenset(s[-2:] for s in joined(x.last, b.exact))
    return Part(None, _few(first), _few(last), all_of(x.inside, y.inside, border_query))


def _few(strings: frozenset[str]) -> frozenset[str]:
    return strings if len(strings) <= FEW else frozenset([""])


def either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= FEW:
        return Part(a.exact | b.exact)
    x, y = a.opened(), b.opened()
    return Part(None, _few(x.first | y.first), _few(x.last | y.last), any_of(x.inside, y.inside))


def _signs(members) -> frozenset[str] | None:
    """The signs of a class of few, lower-cased; none for larger, negated and named ones."""
    signs: set[str] = set()
    for kind, value in members:
        if str(kind) == "LITERAL":
            signs.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < FEW:
            signs |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(signs) if len(signs) <= 12 and all(len(s) == 1 for s in signs) else None


def _part(node) -> Part:
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return Part(frozenset([chr(value).lower()]))
    if kind == "IN":
        signs = _signs(value)
        return UNKNOWN if signs is None else Part(signs)
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "ATOMIC_GROUP":
        return _sequence(value)
    if kind == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        out = parts[0]
        for p in parts[1:]:
            out = either(out, p)
        return out
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        once = _sequence(body)
        if least == 0:
            return either(EMPTY, once) if most == 1 else UNKNOWN
        out = once
        for _ in range(min(least, 8) - 1):
            out = followed(out, once)
        if least == most <= 8:
            return out
        if least > 8 or once.exact is None:
            return followed(out, UNKNOWN)
        begun = out.opened()
        return Part(None, begun.first, once.opened().last, begun.inside)
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return EMPTY  # takes no sign; what it looks at is not demanded
    return UNKNOWN


def _sequence(nodes) -> Part:
    out = EMPTY
    for node in nodes:
        out = followed(out, _part(node))
    return out


def query_of(pattern: str):
    """The trigrams that each match of ``pattern`` holds, lower-cased, as a Boolean query."""
    return _sequence(re._parser.parse(pattern)).opened().inside
