"""What a regular expression says about the pieces of text that must be there.

An expression gives a formula over n-grams of the folded text: all that match it satisfy the formula, so an index of n-grams can
leave out the rest.  Constructs that are not understood (look-around, back references, flags, classes by name) say nothing,
which is always safe.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

#: Alternatives that are followed letter by letter, members of a class that count as alternatives, and repeats written out.
ALTERNATIVES, MEMBERS, REPEATS = 32, 8, 8


@dataclass(frozen=True)
class All:
    """All of ``parts`` hold: grams (strings) and formulas; no parts at all means that nothing is sure."""

    parts: frozenset = field(default_factory=frozenset)


@dataclass(frozen=True)
class Any:
    """At least one of ``parts`` holds."""

    parts: frozenset


NOTHING_SURE = All()


def both(*formulas) -> All:
    parts: set = set()
    for f in formulas:
        parts |= f.parts if isinstance(f, All) else {f}
    return All(frozenset(parts))


def either(formulas) -> All:
    """One of the formulas; what one of them alone requires is not sure."""
    options = frozenset(formulas)
    if NOTHING_SURE in options or not options:
        return NOTHING_SURE
    return next(iter(options)) if len(options) == 1 else All(frozenset({Any(options)}))


@dataclass(frozen=True)
class _Part:
    """What is known of the texts that a part matches.

    ``exact``: all of them, or None if there are too many; ``heads`` and ``tails``: beginnings and endings of which each text has
    one; ``rest``: what holds beside these.
    """

    exact: frozenset | None
    heads: frozenset
    tails: frozenset
    rest: All = NOTHING_SURE


_EMPTY = _Part(frozenset({""}), frozenset({""}), frozenset({""}))
_UNKNOWN = _Part(None, frozenset({""}), frozenset({""}))


class _Grams:
    def __init__(self, n: int):
        self.n = n

    def within(self, text: str) -> All:
        return All(frozenset(text[i:i + self.n] for i in range(len(text) - self.n + 1)))

    def of(self, texts) -> All:
        return either({self.within(t) for t in texts})

    def words(self, texts) -> _Part:
        texts = frozenset(texts)
        return self.short(_Part(texts, texts, texts))

    def short(self, p: _Part) -> _Part:
        """The same with few alternatives: long lists become formulas and n - 1 letters at both ends."""
        exact, heads, tails, rest = p.exact, p.heads, p.tails, p.rest
        if exact is not None and (len(exact) > ALTERNATIVES or any(len(t) > 64 for t in exact)):
            rest, heads, tails, exact = both(rest, self.of(exact)), exact, exact, None
        if exact is None:
            rest = both(rest, self.of(heads), self.of(tails))
            heads = frozenset(t[:self.n - 1] for t in heads)
            tails = frozenset(t[len(t) - min(len(t), self.n - 1):] for t in tails)
            while len(heads) > ALTERNATIVES:
                heads = frozenset(t[:max(map(len, heads)) - 1] for t in heads)
            while len(tails) > ALTERNATIVES:
                longest = max(map(len, tails)) - 1
                tails = frozenset(t[len(t) - min(len(t), longest):] for t in tails)
        return _Part(exact, heads, tails, rest)

    def after(self, a: _Part, b: _Part) -> _Part:
        if a.exact is not None and b.exact is not None:
            return self.words(x + y for x, y in product(a.exact, b.exact)) if len(a.exact) * len(b.exact) <= 4 * ALTERNATIVES else self.after(
                self.short(_Part(None, a.exact, a.exact, self.of(a.exact))), b)
        across = self.of({x + y for x, y in product(a.tails, b.heads)})
        heads = {x + y for x, y in product(a.exact, b.heads)} if a.exact is not None else a.heads
        tails = {x + y for x, y in product(a.tails, b.exact)} if b.exact is not None else b.tails
        return self.short(_Part(None, frozenset(heads), frozenset(tails), both(a.rest, b.rest, across)))

    def choice(self, parts: list[_Part]) -> _Part:
        if all(p.exact is not None for p in parts):
            return self.words(t for p in parts for t in p.exact)
        heads = frozenset(t for p in parts for t in p.heads)
        tails = frozenset(t for p in parts for t in p.tails)
        return self.short(_Part(None, heads, tails, either({self.formula(p) for p in parts})))

    def formula(self, p: _Part) -> All:
        if p.exact is not None:
            return both(p.rest, self.of(p.exact))
        return both(p.rest, self.of(p.heads), self.of(p.tails))

    def repeat(self, p: _Part, least: int, most: int | None) -> _Part:
        if most == 0:
            return _EMPTY
        if least == 0:
            return self.choice([_EMPTY, self.repeat(p, 1, most)]) if most == 1 else _UNKNOWN
        out = p
        for _ in range(min(least, REPEATS) - 1):
            out = self.after(out, p)
        return out if least == most and least <= REPEATS else self.after(out, _UNKNOWN)


class _Unclear(Exception):
    """The expression has a construct that changes what its letters mean."""


class _Reader:
    """Reads an expression from the left."""

    def __init__(self, text: str, n: int):
        self.text, self.at, self.g = text, 0, _Grams(n)

    def peek(self, ahead: int = 1) -> str:
        return self.text[self.at:self.at + ahead]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise _Unclear
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> _Part:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return self.g.choice(parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> _Part:
        out = _EMPTY
        while self.peek() and self.peek() not in "|)":
            out = self.g.after(out, self.repeated())
        return out

    def repeated(self) -> _Part:
        p = self.atom()
        while (sign := self.peek()) and sign in "*+?{":
            if sign == "{":
                end = self.text.find("}", self.at)
                low, comma, high = self.text[self.at + 1:end].partition(",")
                if end < 0 or not low.isdigit() or (high and not high.isdigit()):
                    raise _Unclear
                self.at = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                self.at += 1
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
            if self.peek() and self.peek() in "?+":  # reluctant or possessive: the same texts or fewer
                self.at += 1
            p = self.g.repeat(p, least, most)
        return p

    def atom(self) -> _Part:
        sign = self.take()
        if sign == "(":
            if self.peek() == "?":
                if self.peek(2) == "?:":
                    self.at += 2
                elif self.peek(2) == "?<" and self.peek(3) not in ("?<=", "?<!"):
                    self.at = self.text.index(">", self.at) + 1 if ">" in self.text[self.at:] else self.stop()
                else:
                    self.stop()
            inner = self.alternatives()
            if self.take() != ")":
                self.stop()
            return inner
        if sign == "[":
            return self.members()
        if sign == ".":
            return _UNKNOWN
        if sign in "^$":
            return _EMPTY
        return self.escaped() if sign == "\\" else self.letter(sign)

    def stop(self):
        raise _Unclear

    def letter(self, sign: str) -> _Part:
        # Matching without case is about ASCII letters only; folding may change the length of other letters.
        return self.g.words({sign.upper()}) if sign.isascii() else _UNKNOWN

    def escaped(self) -> _Part:
        sign = self.take()
        if sign in "bBAzZG":
            return _EMPTY
        if not sign.isalnum():
            return self.letter(sign)
        if sign in "wWdDsS":
            return _UNKNOWN
        return self.stop()  # \Q, \p, \x, back references and the like

    def members(self) -> _Part:
        if self.peek() == "^":
            self.at += 1
            self.skip_members()
            return _UNKNOWN
        start, found = self.at, set()
        while True:
            sign = self.take()
            if sign == "]" and found:
                break
            if sign in "[]&":
                self.stop()  # nested classes, intersections, a bracket as first member
            if sign == "\\":
                sign = self.take()
                if sign.isalnum():
                    self.at = start
                    self.skip_members()
                    return _UNKNOWN
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.at += 1
                last = self.take()
                if last == "\\":
                    last = self.take()
                if ord(last) - ord(sign) > 26:
                    self.skip_members()
                    return _UNKNOWN
                found |= {chr(c) for c in range(ord(sign), ord(last) + 1)}
            else:
                found.add(sign)
        folded = {c.upper() for c in found}
        return self.g.words(folded) if len(folded) <= MEMBERS and all(c.isascii() for c in folded) else _UNKNOWN

    def skip_members(self) -> None:
        while (sign := self.take()) != "]":
            if sign == "\\":
                self.take()
            elif sign in "[&":
                self.stop()


def formula(expression: str, n: int = 3) -> All:
    """Formula over n-grams of the upper-cased text that every text with a match satisfies."""
    reader = _Reader(expression, n)
    try:
        part = reader.alternatives()
        if reader.at < len(expression):
            return NOTHING_SURE
    except _Unclear:
        return NOTHING_SURE
    return reader.g.formula(part)


def holds(f, present) -> bool:
    """Whether a set of grams satisfies the formula."""
    if isinstance(f, str):
        return f in present
    return (all if isinstance(f, All) else any)(holds(p, present) for p in f.parts)


def grams(f) -> set[str]:
    """All grams that the formula names."""
    return {f} if isinstance(f, str) else set().union(*[grams(p) for p in f.parts])


def cheapest(f, cost, keep: int = 2):
    """A weaker formula with the ``keep`` parts of each conjunction that have the lowest cost (a function of a gram)."""
    if isinstance(f, str):
        return f
    parts = [cheapest(p, cost, keep) for p in f.parts]
    if isinstance(f, Any):
        return Any(frozenset(parts))
    return All(frozenset(sorted(parts, key=lambda p: (expense(p, cost), repr(p)))[:keep]))


def expense(f, cost) -> float:
    """Postings that answering the formula reads at most: of a conjunction the cheapest part, of a choice all."""
    if isinstance(f, str):
        return cost(f)
    each = [expense(p, cost) for p in f.parts]
    return (min(each) if each else float("inf")) if isinstance(f, All) else sum(each)
