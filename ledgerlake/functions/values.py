"""Values of the data model: literals, type inference, identity and order.

Order: numbers, then links, then everything else by its string form, first without regard to case, then with it. Timestamps
have a string form of fixed width, so their order is that of time. Numbers are equal across numeric types; a tag is equal to a string
of the same text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER, LINK, OTHER = 0, 1, 2
EPOCH = datetime(1970, 1, 1)

#: Operators and their spellings.
OPERATORS = {
    "EQUALS": ["=", "==", "eq"],
    "NOT_EQUALS": ["!=", "ne"],
    "GREATER_THAN": [">", "gt"],
    "GREATER_THAN_OR_EQUALS": [">=", "gte"],
    "LESS_THAN": ["<", "lt"],
    "LESS_THAN_OR_EQUALS": ["<=", "lte"],
    "BETWEEN": ["bw", "><"],
    "REGEX": ["regex"],
    "NOT_REGEX": ["nregex"],
    "LIKE": ["like"],
    "NOT_LIKE": ["nlike"],
    "LINKS_TO": ["->", "lnks2", "lnk2"],
    "CONTAINS": ["~", "search", "search_match", "contains"],
    "NOT_CONTAINS": ["!~", "search_exclude", "not_contains", "ncontains"],
}
SPELLINGS = {s: name for name, ss in OPERATORS.items() for s in [*ss, name.lower()]}


def operator_of(text: str) -> str:
    try:
        return SPELLINGS[text.lower()]
    except KeyError:
        raise ValueError(f"unknown operator {text!r}") from None


@dataclass(frozen=True)
class Link:
    record: int


@dataclass(frozen=True)
class Tag:
    text: str


@dataclass(frozen=True)
class ResolvableLink:
    """A link to every record that a condition finds."""

    condition: str


@dataclass(frozen=True)
class Call:
    """A calculation as a value: over a key, of all records, listed ones, or those of a condition; at a time or now."""

    name: str
    key: str
    records: tuple[int, ...] = ()
    condition: object = None
    at: int | None = None


Scalar = bool | int | float | Decimal | str | datetime | Link | Tag


def infer(text: str) -> Scalar | ResolvableLink:
    """A value from its text, in this order: quoted string, link, boolean, tag, timestamp, number, string."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if m := re.fullmatch(r"@(-?\d+)@?", text):
        return Link(int(m[1]))
    if len(text) > 2 and text[0] == text[-1] == "@" and re.search(r"\s|[=<>~]", text):
        return ResolvableLink(text[1:-1])
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if len(text) > 2 and text[0] == text[-1] == "`":
        return Tag(text[1:-1])
    if len(text) > 2 and text[0] == text[-1] == "|":
        body, _, fmt = text[1:-1].partition("|")
        return datetime.strptime(body.strip(), time_format(fmt.strip())) if fmt else datetime.fromisoformat(body.strip())
    return number(text) if number(text) is not None else text


#: Pattern letters of timestamp literals, each run of a letter (by its least length) and what it reads.
PATTERN_LETTERS = [
    ("yyyy", "%Y"), ("yy", "%y"), ("y", "%Y"), ("MMMM", "%B"), ("MMM", "%b"), ("M", "%m"), ("d", "%d"), ("D", "%j"), ("EEEE", "%A"), ("E", "%a"),
    ("H", "%H"), ("h", "%I"), ("k", "%H"), ("K", "%I"), ("m", "%M"), ("s", "%S"), ("S", "%f"), ("a", "%p"), ("Z", "%z"), ("z", "%Z"),
]


_RUN = re.compile(r"'((?:[^']|'')*)'|([A-Za-z])\2*|[^A-Za-z']")


def time_format(pattern: str) -> str:
    """A pattern of letters (``yyyy-MM-dd``, quotes around plain text) as a format of strptime; one with % is that already."""
    if "%" in pattern:
        return pattern
    out = []
    for m in _RUN.finditer(pattern):
        if m[1] is not None:
            out.append("'" if m[0] == "''" else m[1].replace("''", "'"))
        elif m[2] is None:
            out.append(m[0])
        else:
            found = next((f for p, f in PATTERN_LETTERS if m[0].startswith(p)), None)
            if found is None:
                raise ValueError(f"unknown pattern letter {m[0]!r}")
            out.append(found)
    return "".join(out)


def number(text: str) -> int | float | None:
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?[dDfF]?", text):
        return float(text.rstrip("dDfF"))
    return None


def micros(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def string_form(v: Scalar) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, Link):
        return f"@{v.record}"
    if isinstance(v, Tag):
        return v.text
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, float) and v == int(v):
        return str(int(v)) if abs(v) < 1e15 else repr(v)
    return str(v)


def rank_of(v: Scalar) -> int:
    if isinstance(v, Link):
        return LINK
    return NUMBER if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else OTHER


def type_of(v: Scalar) -> str:
    for kind, name in ((bool, "BOOLEAN"), (int, "LONG"), (float, "DOUBLE"), (Decimal, "DOUBLE"), (Link, "LINK"), (Tag, "TAG"), (datetime, "TIMESTAMP")):
        if isinstance(v, kind):
            return name
    return "STRING"


def identity(v: Scalar) -> str:
    """Equal for equal values: of numbers their canonical text, of a tag that of its string."""
    if rank_of(v) == NUMBER:
        d = Decimal(str(v))
        return "n:" + (format(d.quantize(Decimal(1)), "f") if d == d.to_integral_value() else format(d.normalize(), "f"))
    if isinstance(v, Link):
        return f"l:{v.record}"
    prefix = {"BOOLEAN": "b:", "TIMESTAMP": "t:"}.get(type_of(v), "s:")
    return prefix + string_form(v)


class Triple:
    """The columns that conditions read from a live triple: rank, num, str and type, of which some may be constants.

    A constant rank lets Catalyst fold a condition down to a plain comparison that reaches the scan."""

    def __init__(self, prefix: str = ""):
        self.rank, self.num, self.text, self.type = (F.col(prefix + c) for c in ("rank", "num", "str", "type"))

    def _side(self, v: Scalar) -> tuple[int, Column, Column]:
        r = rank_of(v)
        if r == NUMBER:
            return r, self.num, F.lit(v)
        if r == LINK:
            return r, self.num, F.lit(v.record)
        return r, F.lower(self.text), F.lit(string_form(v).lower())

    def equals(self, v: Scalar) -> Column:
        r, own, other = self._side(v)
        return (self.rank == r) & (own == other)

    def greater(self, v: Scalar, or_equal: bool = False) -> Column:
        r, own, other = self._side(v)
        return (self.rank > r) | ((self.rank == r) & (own >= other if or_equal else own > other))

    def matches(self, pattern: str) -> Column:
        return self.text.rlike(rf"\A(?:{pattern})\z")

    def compare(self, op: str, values: list[Scalar]) -> Column:
        """The condition of one stored value; CONTAINS is in operators.search."""
        v = values[0]
        if op == "EQUALS":
            return self.equals(v)
        if op == "NOT_EQUALS":
            return ~self.equals(v)
        if op in ("GREATER_THAN", "GREATER_THAN_OR_EQUALS"):
            return self.greater(v, op.endswith("EQUALS"))
        if op in ("LESS_THAN", "LESS_THAN_OR_EQUALS"):
            return ~self.greater(v, op == "LESS_THAN")
        if op == "BETWEEN":
            return self.greater(v, True) & ~self.greater(values[1], True)
        if op in ("REGEX", "NOT_REGEX", "LIKE", "NOT_LIKE"):
            pattern = string_form(v)
            found = self.matches(like_pattern(pattern) if op.endswith("LIKE") else pattern)
            return ~found if op.startswith("NOT") else found
        if op == "LINKS_TO":
            target = v.record if isinstance(v, Link) else int(v)
            return (self.rank == LINK) & (self.num == target)
        raise ValueError(op)


def like_pattern(text: str) -> str:
    """Per cent signs are wildcards unless escaped; all else is a regular expression."""
    return re.sub(r"\\%|%", lambda m: "%" if m[0] == "\\%" else ".*", text)
