"""The record filter language, from text to one Column.

Parsing gives a tree of and, or, not and simple conditions.  Compiling pushes every negation
down to the conditions first, so that the result needs no NOT: an absent value counts as 0,
and each condition says itself what holds for it then (``x > 10`` or ``x < 10 or x is null``).
That keeps conditions in the shapes that reach the Parquet scan: comparisons, ranges, lists.
Networks are ranges for the same reason.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions import ip
from flowloom.functions.convert import flags_number, protocol_number
from flowloom.plans.catalog import FIELDS, calculated, zero

OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
WORDS = {"eq": "=", "==": "=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ne": "!=", "<>": "!="}
SUFFIX = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}

_TOKEN = re.compile(r"\s*(?:(&&|\|\||<=|>=|!=|<>|==|[()\[\],<>=!])|([A-Za-z0-9_.:/+-]+))")


class FilterError(ValueError):
    """The text is not a filter."""


class Node:
    def column(self, positive: bool = True) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Group(Node):
    all_of: bool
    parts: tuple[Node, ...]

    def column(self, positive: bool = True) -> Column:
        cs = [p.column(positive) for p in self.parts]
        return reduce(operator.and_ if self.all_of == positive else operator.or_, cs)


@dataclass(frozen=True)
class Not(Node):
    part: Node

    def column(self, positive: bool = True) -> Column:
        return self.part.column(not positive)


@dataclass(frozen=True)
class Always(Node):
    def column(self, positive: bool = True) -> Column:
        return F.lit(positive)


@dataclass(frozen=True)
class Compare(Node):
    name: str
    op: str
    value: int | float

    def column(self, positive: bool = True) -> Column:
        op = self.op if positive else OPPOSITE[self.op]
        c = F.col(self.name)
        held = OPS[op](c, F.lit(self.value))
        return held | c.isNull() if OPS[op](0, self.value) else held


@dataclass(frozen=True)
class Among(Node):
    name: str
    values: tuple[int, ...]

    def column(self, positive: bool = True) -> Column:
        c = F.col(self.name)
        held = c.isin(*self.values) if positive else ~c.isin(*self.values)
        return held | c.isNull() if (0 in self.values) == positive else held


@dataclass(frozen=True)
class Bits(Node):
    """All bits of the mask are set, or none of them."""

    name: str
    mask: int
    none: bool = False

    def column(self, positive: bool = True) -> Column:
        found = zero(self.name).bitwiseAND(F.lit(self.mask))
        want = F.lit(0 if self.none else self.mask)
        return found == want if positive else found != want


@dataclass(frozen=True)
class Calculated(Node):
    """A comparison of a calculated field; where the field is undefined it does not hold."""

    name: str
    op: str
    value: float

    def column(self, positive: bool = True) -> Column:
        held = F.coalesce(OPS[self.op](calculated(self.name), F.lit(self.value)), F.lit(False))
        return held if positive else ~held


@dataclass(frozen=True)
class Exists(Node):
    name: str

    def column(self, positive: bool = True) -> Column:
        c = F.col(self.name)
        return c.isNotNull() if positive else c.isNull()


def _both(a: Node, b: Node) -> Node:
    return Group(True, (a, b))


def _range(name: str, low: int, high: int) -> Node:
    return Compare(name, "=", low) if low == high else _both(Compare(name, ">=", low), Compare(name, "<=", high))


def address_in(field: str, text: str) -> Node:
    """The address field lies in the network, or equals the address."""
    address, width, length = ip.parse(text)
    length = width if length is None else length
    if width == 32:
        span = 2 ** (32 - length)
        base = address // span * span
        return _both(Compare(f"{field}_hi", "=", 0), _range(f"{field}_lo", base, base + span - 1))
    if length == 0:
        return Always()
    span = 2 ** (128 - length)
    low, high = address // span * span, address // span * span + span - 1
    (low_hi, low_lo), (high_hi, high_lo) = ip.halves(low), ip.halves(high)
    if length <= 64:
        return _range(f"{field}_hi", low_hi, high_hi)
    return _both(Compare(f"{field}_hi", "=", low_hi), _range(f"{field}_lo", low_lo, high_lo))


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"unexpected character at {at} in filter: {text!r}")
            self.tokens.append(m.group(1) or m.group(2))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].lower() if i < len(self.tokens) else ""

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise FilterError(f"filter ends too early: {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> str:
        if self.peek() in words:
            return self.next().lower()
        return ""

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise FilterError(f"'{word}' expected, not '{self.peek()}', in filter: {self.text!r}")

    def whole(self) -> Node:
        if not self.tokens:
            return Always()
        node = self.any_of()
        if self.at < len(self.tokens):
            raise FilterError(f"'{self.peek()}' not expected in filter: {self.text!r}")
        return node

    def any_of(self) -> Node:
        parts = [self.all_of()]
        while self.take("or", "||"):
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Group(False, tuple(parts))

    def all_of(self) -> Node:
        parts = [self.one()]
        while self.take("and", "&&"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Group(True, tuple(parts))

    def one(self) -> Node:
        if self.take("not", "!"):
            if self.peek() in ("flags", "tcpflags") and self.peek(1) not in ("isset", "isnset"):  # directly negated flags: none of them
                self.next()
                return Bits("flags", self.flags(), none=True)
            return Not(self.one())
        if self.take("("):
            node = self.any_of()
            self.expect(")")
            return node
        return self.condition()

    def directions(self) -> tuple[list[str], bool] | None:
        """(sides, both needed)."""
        side = self.take("src", "dst")
        if not side:
            return None
        if self.peek() in ("or", "and") and self.peek(1) in ("src", "dst") and self.peek(1) != side:
            both = self.next().lower() == "and"
            self.next()
            return ["src", "dst"], both
        return [side], False

    def condition(self) -> Node:
        sides = self.directions()
        word = self.next().lower()
        fused = re.fullmatch(r"(src|dst)(ip|host|net|port)", word)
        if fused and sides is None:
            sides, word = ([fused[1]], False), fused[2]
        if word in ("ip", "host", "net", "port"):
            names, both = sides or (["src", "dst"], False)
            make = self.port() if word == "port" else self.address()
            parts = tuple(make(s) for s in names)
            return parts[0] if len(parts) == 1 else Group(both, parts)
        if sides is not None:
            raise FilterError(f"'{word}' has no direction in filter: {self.text!r}")
        if word == "any":
            return Always()
        if word in ("inet", "ipv4"):
            return _both(Compare("srcip_hi", "=", 0), _range("srcip_lo", 0, 2**32 - 1))
        if word in ("inet6", "ipv6"):
            return Not(_both(Compare("srcip_hi", "=", 0), _range("srcip_lo", 0, 2**32 - 1)))
        if word in ("proto", "protocol"):
            op = self.operator()
            if op == "in":
                return Among("proto", self.listed(protocol_number))
            try:
                return Compare("proto", op, protocol_number(self.next()))
            except ValueError as e:
                raise FilterError(str(e)) from None
        if word in ("flags", "tcpflags"):
            return Bits("flags", none=self.take("isset", "isnset") == "isnset", mask=self.flags())
        if word == "exists":
            name = self.next().lower()
            self.known(name)
            return Group(True, tuple(Exists(c) for c in FIELDS[name].columns)) if FIELDS[name].kind != "calc" else Always()
        if word in ("in", "out") and self.take("if"):
            name, op = {"in": "input", "out": "output"}[word], self.operator()
            return Among(name, self.listed(self.as_number)) if op == "in" else Compare(name, op, self.number())
        self.known(word)
        field = FIELDS[word]
        if field.kind == "addr":
            raise FilterError(f"'{word}' needs an address in filter: {self.text!r}")
        op = self.operator()
        parse = {"time": self.as_moment, "mac": self.as_mac}.get(field.kind, self.as_number)
        if field.kind == "mac" and op not in ("=", "!=", "in"):
            raise FilterError(f"'{op}' does not compare hardware addresses in filter: {self.text!r}")
        if field.kind == "calc":
            if op == "in":
                raise FilterError(f"'{word}' cannot be listed in filter: {self.text!r}")
            return Calculated(word, op, self.number())
        if op == "in":
            return Among(word, self.listed(parse))
        return Compare(word, op, parse(self.next()))

    def known(self, word: str) -> None:
        if word not in FIELDS:
            raise FilterError(f"'{word}' is no field in filter: {self.text!r}")

    def operator(self) -> str:
        word = self.peek()
        if word == "in":
            self.next()
            return "in"
        if word in OPS or word in WORDS:
            self.next()
            return WORDS.get(word, word)
        return "="

    def as_number(self, text: str) -> int | float:
        m = re.fullmatch(r"(-?\d+(?:\.\d+)?)([kmgt]?)", text.lower())
        if not m:
            raise FilterError(f"'{text}' is no number in filter: {self.text!r}")
        value = float(m[1]) if "." in m[1] else int(m[1])
        value *= SUFFIX.get(m[2], 1)
        return int(value) if value == int(value) else value

    def as_mac(self, text: str) -> int:
        if not re.fullmatch(r"(?i)[0-9a-f]{2}(:[0-9a-f]{2}){5}", text):
            raise FilterError(f"'{text}' is no hardware address in filter: {self.text!r}")
        return int(text.replace(":", ""), 16)

    def as_moment(self, text: str) -> int | float:
        """Milliseconds, or a UTC date with or without a time: 2024-03-06, 2024-03-06T10:15, 2024-03-06T10:15:30.250."""
        if not re.match(r"\d{4}-", text):
            return self.as_number(text)
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            raise FilterError(f"'{text}' is no time in filter: {self.text!r}") from None
        whole = moment.replace(tzinfo=moment.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return whole // timedelta(milliseconds=1)

    def number(self) -> int | float:
        return self.as_number(self.next())

    def flags(self) -> int:
        if (op := self.operator()) != "=":
            raise FilterError(f"'{op}' does not compare flags in filter: {self.text!r}")
        text = self.next()
        try:
            return int(text) if text.isdigit() else flags_number(text)
        except ValueError as e:
            raise FilterError(str(e)) from None

    def listed(self, parse) -> tuple:
        self.expect("[")
        found = []
        while not self.take("]"):
            if not self.take(","):
                try:
                    found.append(parse(self.next()))
                except FilterError:
                    raise
                except ValueError as e:
                    raise FilterError(str(e)) from None
        if not found:
            raise FilterError(f"empty list in filter: {self.text!r}")
        return tuple(found)

    def port(self):
        op = self.operator()
        if op == "in":
            values = self.listed(self.as_number)
            return lambda side: Among(f"{side}port", values)
        n = self.number()
        return lambda side: Compare(f"{side}port", op, n)

    def address(self):
        """Equal, unequal or in a list; addresses have no order here, so ``<`` and the like raise."""
        op = self.operator()
        if op not in ("=", "!=", "in"):
            raise FilterError(f"'{op}' does not compare addresses in filter: {self.text!r}")
        texts = self.listed(str) if op == "in" else (self.next(),)
        try:
            for t in texts:
                ip.parse(t)
        except ValueError as e:
            raise FilterError(str(e)) from None

        def make(side: str) -> Node:
            found = tuple(address_in(f"{side}ip", t) for t in texts)
            node = found[0] if len(found) == 1 else Group(False, found)
            return Not(node) if op == "!=" else node

        return make


def parse(text: str) -> Node:
    """The tree of a filter; an empty text matches everything.  Raises FilterError."""
    return Parser(text or "").whole()


def compile_filter(text: str) -> Column:
    return parse(text).column()
