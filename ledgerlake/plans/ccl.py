"""The condition language: a tokenizer, a recursive parser, and a builder that makes the same trees.

    condition  := or [order by ...] [page clauses]
    or         := and ("or" and)*            ("||" and "|" are spellings)
    and        := leaf ("and" leaf)*         ("&&" and "&" are spellings)
    leaf       := "(" or ")" | key operator value [value] ["at" time]
    key        := name | a.b.c | name "|" function | "$id$"
    value      := quoted text | unquoted words | function "(" key ["," records or condition or at time] ")" | $local
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.values import Call, Scalar, infer, operator_of
from .times import Clock, now, to_micros

ID = "$id$"
#: Names of calculations and their spellings.
CALCULATIONS = {"sum": "sum", "avg": "avg", "average": "avg", "count": "count", "max": "max", "min": "min"}
_TIME_WORDS = {"at", "on", "during", "in"}
_AND, _OR = {"and", "&&", "&"}, {"or", "||"}


@dataclass(frozen=True)
class Leaf:
    key: str
    operator: str
    values: tuple
    at: int | None = None


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Sort:
    key: str
    ascending: bool = True
    at: int | None = None


@dataclass(frozen=True)
class Page:
    skip: int = 0
    limit: int | None = None

    @staticmethod
    def number(n: int, size: int = 20) -> Page:
        return Page((n - 1) * size, size)

    def next(self) -> Page:
        return replace(self, skip=self.skip + (self.limit or 0))

    def back(self) -> Page:
        return replace(self, skip=max(0, self.skip - (self.limit or 0)))

    def go(self, n: int) -> Page:
        return Page.number(n, self.limit or 20)

    def resize(self, size: int) -> Page:
        return replace(self, limit=size)


@dataclass(frozen=True)
class Query:
    condition: object
    order: tuple[Sort, ...] = ()
    page: Page | None = None


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    | (?P<stamp>\|[^|]+(?:\|[^|]+)?\|)(?=\s|\)|$)
    | (?P<tag>`[^`]+`)
    | (?P<resolve>@[^@]*[\s=<>~][^@]*@)
    | (?P<op>->|!=|!~|>=|<=|==|><|=|>|<|~)
    | (?P<bool>&&|\|\||&)
    | (?P<pipe>\|)
    | (?P<paren>[()])
    | (?P<comma>,)
    | (?P<word>[^\s()=<>!~,&|"']+|'[^\s]*)
    )""",
    re.X,
)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def key_class(key: str) -> str:
    """writable | identifier | navigation | function | invalid"""
    if key == ID:
        return "identifier"
    if re.fullmatch(r"[A-Za-z0-9_]+", key):
        return "writable"
    if re.fullmatch(r"[A-Za-z0-9_$]+(\.[A-Za-z0-9_$]+)+", key):
        return "navigation"
    if m := re.fullmatch(r"([A-Za-z0-9_.]+)\s*\|\s*(\w+)", key):
        return "function" if m[2].lower() in CALCULATIONS else "invalid"
    return "invalid"


@dataclass
class Parser:
    tokens: list[tuple[str, str]]
    data: dict = field(default_factory=dict)
    clock: Clock = now
    at: int = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, want: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or (want and text.lower() != want):
            raise ValueError(f"expected {want or 'more'}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def word(self, *words: str) -> bool:
        return all(self.peek(i)[0] == "word" and self.peek(i)[1].lower() == w for i, w in enumerate(words))

    def query(self) -> Query:
        if self.word("where"):
            self.take()
        tree = None if self.word("order", "by") or self.peek()[0] == "end" else self.either()
        order: list[Sort] = []
        if self.word("order", "by"):
            self.at += 2
            while True:
                order.append(self.sort())
                if self.peek()[0] != "comma":
                    break
                self.take()
        page = self.page()
        if self.peek()[0] != "end":
            raise ValueError(f"not understood: {self.peek()[1]!r}")
        return Query(tree, tuple(order), page)

    def sort(self) -> Sort:
        key, ascending, at = self.take(), True, None
        if key[0] in "<>":
            ascending, key = key[0] == "<", self.take()
        while self.peek()[0] == "word" and self.peek()[1].lower() in ("asc", "ascending", "desc", "descending", "at"):
            w = self.take().lower()
            if w == "at":
                at = self.time()
            else:
                ascending = w.startswith("asc")
        return Sort(key, ascending, at)

    def page(self) -> Page | None:
        skip, limit, number = 0, None, None
        while self.peek()[0] == "word" and self.peek()[1].lower() in ("page", "size", "limit", "skip"):
            w, n = self.take().lower(), int(self.take())
            if w == "page":
                number = n
            elif w == "skip":
                skip = n
            else:
                limit = n
        if number is not None:
            return Page.number(number, limit or 20)
        return Page(skip, limit) if skip or limit is not None else None

    def either(self):
        tree = self.both()
        while self.peek()[1].lower() in _OR and self.peek()[0] in ("word", "bool"):
            self.take()
            tree = Or(tree, self.both())
        return tree

    def both(self):
        tree = self.leaf()
        while self.peek()[1].lower() in _AND and self.peek()[0] in ("word", "bool"):
            self.take()
            tree = And(tree, self.leaf())
        return tree

    def leaf(self):
        if self.peek() == ("paren", "("):
            self.take()
            tree = self.either()
            self.take(")")
            return tree
        key = self.take()
        if self.peek()[0] == "pipe":
            self.take()
            key = f"{key} | {CALCULATIONS[self.take().lower()]}"
        if key_class(key) == "invalid":
            raise ValueError(f"not a key: {key!r}")
        op = operator_of(self.take())
        values = [self.value(op)]
        if op == "BETWEEN":
            if self.word("and"):
                self.take()
            values.append(self.value(op))
        at = None
        if self.peek()[0] == "word" and self.peek()[1].lower() in _TIME_WORDS:
            self.take()
            at = self.time()
        return Leaf(key, op, tuple(values), at)

    def time(self) -> int:
        if self.peek()[0] == "quoted":
            return to_micros(self.take(), self.clock)
        return to_micros(self._words(), self.clock)

    def _ends(self) -> bool:
        kind, text = self.peek()
        low = text.lower()
        if kind in ("end", "paren", "bool", "comma"):
            return True
        return kind == "word" and (low in _AND | _OR or (low in _TIME_WORDS and self.peek(1)[0] != "end") or low in ("page", "size", "limit", "skip") or (low == "order" and self.peek(1)[1].lower() == "by"))

    def _words(self) -> str:
        words = []
        while not self._ends():
            words.append(self.take())
        if not words:
            raise ValueError("a value is missing")
        return " ".join(words)

    def value(self, op: str) -> Scalar | Call:
        kind, text = self.peek()
        if kind == "quoted":
            self.take()
            body = re.sub(r"\\(.)", lambda m: m[0] if m[1] not in "\"'\\" else m[1], text[1:-1]) if "\\" in text else text[1:-1]
            return body
        if kind in ("tag", "stamp", "resolve"):
            return infer(self.take())
        if kind == "word" and text.startswith("$") and text[1:] in self.data:
            self.take()
            return self.data[text[1:]]
        if kind == "word" and text.lower() in CALCULATIONS and self.peek(1) == ("paren", "("):
            return self.call()
        if op == "BETWEEN":
            return infer(self.take())
        words = self._words()
        return words if op in ("REGEX", "NOT_REGEX", "LIKE", "NOT_LIKE", "CONTAINS", "NOT_CONTAINS") else infer(words)

    def call(self) -> Call:
        name = CALCULATIONS[self.take().lower()]
        self.take("(")
        key, records, condition, at = self.take(), [], None, None
        while self.peek()[0] == "comma":
            self.take()
            if self.word("at"):
                self.take()
                at = self.time()
            elif re.fullmatch(r"\d+", self.peek()[1]) and self.peek(1)[1] in (",", ")"):
                records.append(int(self.take()))
            else:
                condition = self.either()
        self.take(")")
        return Call(name, key, tuple(records), condition, at)


def parse(text: str, data: dict | None = None, clock: Clock = now) -> Query:
    return Parser(tokenize(text), data or {}, clock).query()


class Where:
    """where("age").op(">", 5).at(t), joined by ``&`` and ``|`` (or .and_ and .or_): the builder's form of a condition."""

    def __init__(self, tree):
        self.tree = tree

    def at(self, when, clock: Clock = now) -> Where:
        return Where(replace(self.tree, at=to_micros(when, clock)))

    def and_(self, other: Where) -> Where:
        return Where(And(self.tree, other.tree))

    def or_(self, other: Where) -> Where:
        return Where(Or(self.tree, other.tree))

    __and__, __or__ = and_, or_


class _Key:
    def __init__(self, key: str):
        self.key = key

    def op(self, spelling: str, *values) -> Where:
        return Where(Leaf(self.key, operator_of(spelling), tuple(values)))


def where(key: str) -> _Key:
    if key_class(key) == "invalid":
        raise ValueError(f"not a key: {key!r}")
    return _Key(key)


