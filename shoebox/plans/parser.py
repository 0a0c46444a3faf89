"""Filter text to expressions.

Spaces and tabs part tokens. A quote begins or ends a literal run and disappears. An opening
parenthesis groups only where a token begins; a closing one groups unless its token holds an
opening one, so tags such as miku_(singer) need no quotes. OR binds least, then AND, then
NOT, which takes one term. Terms side by side are an error, not a conjunction.
"""

from __future__ import annotations

import math
import re
from datetime import date, timedelta

from shoebox.plans.expressions import ANY, And, ColorLabel, DateRange, Expression, HasGeo, HasNamespace, MEDIA_TYPES, MediaType, Not, Number, Or, Rating, Tag


class FilterError(ValueError):
    """A filter that can't be read."""


class UnexpectedEnd(FilterError):
    pass


class UnexpectedToken(FilterError):
    pass


class InvalidRating(FilterError):
    pass


class UnknownMediaType(FilterError):
    pass


class InvalidDate(FilterError):
    pass


class InvalidNumber(FilterError):
    pass


def tokenize(text: str) -> list[str]:
    tokens: list[str] = []
    word, quoted = "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif quoted:
            word += c
        elif c in " \t" or c == "(" and not word or c == ")" and "(" not in word:
            tokens += [x for x in (word, c.strip(" \t")) if x]
            word = ""
        else:
            word += c
    return [*tokens, word] if word else tokens


def parse(text: str) -> Expression:
    tokens = _Tokens(tokenize(text))
    if not tokens.left:
        raise UnexpectedEnd("nothing to parse")
    found = tokens.chain("OR", Or)
    if tokens.left:
        raise UnexpectedToken(tokens.left[0])
    return found


class _Tokens:
    def __init__(self, tokens: list[str]):
        self.left = tokens

    def take(self) -> str:
        if not self.left:
            raise UnexpectedEnd("a term is missing")
        token, *self.left = self.left
        return token

    def at(self, word: str) -> bool:
        return bool(self.left) and self.left[0].isascii() and self.left[0].upper() == word

    def chain(self, word: str, kind: type) -> Expression:
        """Terms joined by a keyword, from the left."""
        part = (lambda: self.chain("AND", And)) if word == "OR" else self.negated
        found = part()
        while self.at(word):
            self.take()
            found = kind(found, part())
        return found

    def negated(self) -> Expression:
        if self.at("NOT"):
            self.take()
            return Not(self.term())
        return self.term()

    def term(self) -> Expression:
        token = self.take()
        if token == "(":
            found = self.chain("OR", Or)
            if self.left[:1] != [")"]:
                raise UnexpectedToken("expected ')'")
            self.take()
            return found
        return _term(token)


_COMPARED = {">=": "gte", "<=": "lte", "=": "eq"}
_DATES = {"date": "taken", "added": "added", "viewed": "viewed"}
_NUMBERS = {"width": "width", "height": "height", "size": "file_size", "filesize": "file_size"}


def _term(token: str) -> Expression:
    if m := re.match(r"rating(>=|<=|=)", token):
        value = token[m.end() :]
        if not re.fullmatch(r"\+?[0-9]+", value) or int(value) > 255:
            raise InvalidRating(value)
        return Rating(_COMPARED[m[1]], int(value))
    sign = next((s for s in ("<=", ">=", "=") if s in token), None)
    if sign:
        field, _, value = token.partition(sign)
        if field in _DATES:
            start, end = period(value)
            return DateRange(_DATES[field], None if sign == "<=" else start, None if sign == ">=" else end)
        if field in _NUMBERS:
            return Number(_NUMBERS[field], _COMPARED[sign], size_literal(value) if field.endswith("size") else _integer(value, token))
    if token.startswith("type:"):
        if (kind := token[5:].lower()) not in MEDIA_TYPES:
            raise UnknownMediaType(token[5:])
        return MediaType(kind)
    if token.startswith("color:"):
        return ColorLabel(token[6:])
    if token in ("has:geo", "missing:geo"):
        return HasGeo(token == "has:geo")
    if token.startswith("has::"):
        return HasNamespace(namespace(token[5:]))
    if "::" in token:
        space, _, value = token.partition("::")
        return Tag(namespace(space), value)
    return HasNamespace(token) if namespace(token) is not ANY else Tag(ANY, token)


def namespace(text: str) -> str | None:
    """A namespace that exists, or ANY: an unknown prefix is no error."""
    return text if text in ("user", "set") or text.startswith("plugin.") else ANY


def _integer(value: str, token: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", value) or not -(1 << 63) <= int(value) < 1 << 63:
        raise InvalidNumber(token)
    return int(value)


def period(text: str) -> tuple[int, int]:
    """First and last second (UTC) of a year, month or day; the year's text has four bytes."""
    parts = text.split("-")
    try:
        if len(parts[0].encode()) != 4 or len(parts) > 3 or not all(re.fullmatch(r"\+?[0-9]+", p) for p in parts):
            raise ValueError
        year, month, day = (*map(int, parts), 1, 1)[:3]
        start = date(year, month, day)
        if len(parts) == 3:
            after = start + timedelta(days=1)
        else:
            after = date(year + (len(parts) == 1 or month == 12), 1 if len(parts) == 1 else month % 12 + 1, 1)
    except (ValueError, OverflowError):
        raise InvalidDate(text) from None
    return tuple((d - date(1970, 1, 1)).days * 86400 - late for d, late in ((start, 0), (after, 1)))


def size_literal(text: str) -> int:
    """Bytes of a number with an optional unit, 1024 of each to the next, cut to an integer."""
    m = re.fullmatch(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*(gb|mb|kb|b|)\s*", text.lower())
    value = float(m[1]) if m else -1.0
    if value < 0 or not math.isfinite(value):
        raise InvalidNumber(text)
    return min((1 << 63) - 1, int(value * {"gb": 1 << 30, "mb": 1 << 20, "kb": 1 << 10}.get(m[2], 1)))


def completion(text: str, cursor: int) -> tuple[int, str | None, str]:
    """Where the token before the cursor begins, its namespace if that is a known one, and the word to complete."""
    begin = max(text.rfind(" ", 0, cursor), text.rfind("\t", 0, cursor)) + 1
    token = text[begin:cursor]
    space, parted, word = token.partition("::")
    return (begin, space, word) if parted and namespace(space) is not ANY else (begin, None, token)


def composed(text: str, rating: int | None, op: str = ">=") -> str:
    """Filter text and the rating control; no parentheses are added, so an OR in the text binds anew."""
    control = f"rating{op}{rating}" if rating else ""
    return " AND ".join(x for x in (text.strip(), control) if x)
