"""Cheap and linear tests in front of patterns, derived from the patterns themselves.

A pattern that is a choice of phrases can only occur in a text that holds the longest word of one of them, or, where phrases don't consist of words, their longest run of fixed characters. A text is put in lower case and
its words are gathered once for all patterns (seen), and a pattern is only tried where it can occur. A phrase with `.*` inside is tried from the first place where its head stands, which serves for all later ones, so its time grows with the text and not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache, reduce
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters outside ASCII that equal an ASCII one when case is ignored, and these.
ODD, PLAIN = "ſıİK", "siik"
#: Spellings beyond which a pattern gets no such test.
MOST = 400


def seen(c: Column) -> Column:
    """struct(low, words): a text without case, and its distinct words of ASCII letters and digits."""
    low = F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, ODD, PLAIN)))
    return let(low, lambda x: F.struct(x.alias("low"), F.array_distinct(F.split(x, "[^a-z0-9]+")).alias("words")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def alternatives(pattern: str) -> tuple[str, list[str]] | None:
    """Flags and phrases of a pattern of the form \\b(one|two|...)\\b; null for others."""
    flags = "(?s)" if pattern.startswith("(?s)") else ""
    body = pattern[len(flags) :]
    if not (body.startswith(r"\b(") and body.endswith(r")\b")):
        return None
    out, depth, start, i = [], 0, 3, 3
    body = body[:-3]
    while i < len(body):
        if body[i] == "\\":
            i += 1
        elif body[i] == "[":
            i = body.index("]", i + 2)
        elif body[i] == "(":
            depth += 1
        elif body[i] == ")":
            depth -= 1
            if depth < 0:
                return None
        elif body[i] == "|" and not depth:
            out.append(body[start:i])
            start = i + 1
        i += 1
    return flags, [*out, body[start:]]


@cache
def linear(pattern: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Patterns that together occur where `pattern` does, each with further phrases that must be in the text for it to be tried."""
    cut = alternatives(pattern)
    if cut is None or ".*" not in pattern:
        return ((pattern, ()),)
    flags, phrases = cut
    plain = [p for p in phrases if ".*" not in p]
    out = [(rf"{flags}\b({'|'.join(plain)})\b", ())] if plain else []
    for p in phrases:
        if ".*" in p:
            head, tail = p.split(".*", 1)
            start = r"(?s)\A" if flags else "(?m)^"
            # up to the first head, without a step back
            out.append((rf"{start}(?:(?!\b{head}).)*+\b{head}.*{tail}\b", (rf"\b{head}", *([rf"\b{tail[1:]}\b"] if tail.startswith(" ") else []))))
    return tuple(out)


#: What is known so far of a way to spell a pattern: its longest whole word, the word being spelt and whether it began at a border, the longest run of fixed characters, and the run being spelt.
State = tuple[str, str, bool, str, str]


def _longer(a: str, b: str) -> str:
    return b if len(b) > len(a) else a


def _ended(s: State, border: bool = True) -> State:
    """The word ends here, at a border of words or, if not, at a character that may belong to it."""
    word, part, began, run, now = s
    return (_longer(word, part) if began and border else word, "", border, run, now)


def _unknown(s: State, border: bool = False) -> State:
    word, part, began, run, now = _ended(s, border)
    return (word, part, began, _longer(run, now), "")


def _spelt(items: Iterable, states: set[State]) -> set[State] | None:
    """All ways to spell these parts of a parsed pattern; null where that can't be told or are too many."""
    for op, value in items:
        if op is K.LITERAL:
            ch = chr(value).lower()
            if ch.isascii() and ch.isalnum():
                states = {(w, p + ch, b, r, n + ch) for w, p, b, r, n in states}
            else:
                states = {(w, p, b, r, n + ch) for w, p, b, r, n in map(_ended, states)}
        elif op is K.AT:
            states = {_ended(s) for s in states} if value is K.AT_BOUNDARY else states
        elif op is K.IN and all(o is K.LITERAL for o, _ in value):
            states = {x for v in value for x in _spelt([v], states)}
        elif op is K.IN:
            states = {_unknown(s, value == [(K.CATEGORY, K.CATEGORY_SPACE)]) for s in states}
        elif op in (K.ANY, K.NOT_LITERAL):
            states = {_unknown(s) for s in states}
        elif op is K.BRANCH:
            each = [_spelt(b, states) for b in value[1]]
            if any(e is None for e in each):
                return None
            states = set().union(*each)
        elif op is K.SUBPATTERN:
            states = _spelt(value[3], states)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = value
            once = _spelt(body, states)
            if once is None:
                return None
            if high != 1:  # more of the same may follow
                once = {_unknown(s, s[1] == "" and s[2]) for s in once}
            states = once | (states if not low else set())
        elif op not in (K.ASSERT, K.ASSERT_NOT):
            return None
        if states is None or len(states) > MOST:
            return None
    return states


@cache
def required(pattern: str) -> tuple[tuple[str, ...] | None, tuple[str, ...] | None]:
    """Words of which a text must hold one for the pattern to occur, and runs of characters of which it must; null where there is no such list."""
    body = pattern.removeprefix("(?s)")
    found = _spelt(parser.parse(body, re.IGNORECASE), {("", "", False, "", "")})
    if not found:
        return None, None
    words = {w for w, *_ in found}
    runs = {_longer(r, n) for *_, r, n in found}
    runs = {r for r in runs if not any(x in r for x in runs - {r})}
    return (tuple(sorted(words)) if "" not in words else None, tuple(sorted(runs)) if all(len(r) > 1 or r and not r.isascii() for r in runs) else None)


@cache
def phrases(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """Single words, and runs that are longer than the word in them, as whole phrases are, of which a text must hold one for the pattern to occur; null where no phrase tells more than required()."""
    found = _spelt(parser.parse(pattern.removeprefix("(?s)"), re.IGNORECASE), {("", "", False, "", "")})
    told = {(w, _longer(r, n)) for w, *_, r, n in found or ()}
    if not told or any(not w for w, _ in told):
        return None
    words = {w for w, r in told if len(r) <= len(w)}
    runs = {r for w, r in told if len(r) > len(w) and w not in words}
    return (tuple(sorted(words)), tuple(sorted(r for r in runs if not any(x in r for x in runs - {r})))) if runs else None


def _digit(items: Iterable) -> bool:
    """Whether each way to spell these parts holds a digit."""
    for op, value in items:
        if op is K.IN and value == [(K.CATEGORY, K.CATEGORY_DIGIT)]:
            return True
        if op is K.BRANCH and all(_digit(b) for b in value[1]) or op is K.SUBPATTERN and _digit(value[3]) or op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] and _digit(value[2]):
            return True
    return False


@cache
def needs_digit(pattern: str) -> bool:
    return _digit(parser.parse(pattern.removeprefix("(?s)"), re.IGNORECASE))


def can_occur(seen: Column, pattern: str, also: tuple[str, ...] = ()) -> Column | None:
    """Whether a text that was seen() may hold the pattern, and further phrases; null where nothing can be told."""
    tests = []
    for p in (pattern, *also):
        words, runs = required(p)
        within = lambda found: [F.contains(seen["low"], F.lit(r)) for r in found]
        held = lambda found: F.arrays_overlap(seen["words"], F.array(*[F.lit(w) for w in found]))
        either = lambda found: reduce(lambda a, b: a | b, found)
        if words:
            tests.append(held(words))
            if more := phrases(p):
                tests.append(either([*([held(more[0])] if more[0] else []), *within(more[1])]))
        elif runs:
            tests.append(either(within(runs)))
        # what is fixed may hold the digit already; it is looked for last, as it takes a pattern
        fixed = words or runs or ("",)
        if needs_digit(p) and not all(any(x in "0123456789" for x in r) for r in fixed):
            tests.append(F.when(F.octet_length(seen["low"]) == F.length(seen["low"]), seen["low"].rlike("[0-9]")).otherwise(seen["low"].rlike(r"(?U)\d")))
    return reduce(lambda a, b: a & b, tests) if tests else None
