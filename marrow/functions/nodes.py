"""Value expressions and predicates as small serialisable trees; marrow.plans.compiler turns them into Columns.

A predicate's left side is a property path (a string): absent and null values follow the rules of the compiler.
``compare`` on two value expressions makes an ``Expr`` instead."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from typing import Any

OPS = ("=", "!=", ">", "<", ">=", "<=")
PARTS = ("year", "month", "dayOfMonth", "dayOfWeek", "hour", "minute", "second")


class Node:
    """Base of all nodes: a tuple of fields, equal by content."""

    def to_json(self) -> dict[str, Any]:
        def plain(v: Any) -> Any:
            if isinstance(v, Node):
                return v.to_json()
            if isinstance(v, tuple):
                return [plain(x) for x in v]
            if isinstance(v, datetime):
                return {"date": v.isoformat()}
            return v

        return {"node": type(self).__name__} | {k: plain(v) for k, v in self.__dict__.items()}

    def digest(self) -> str:
        """Equal for trees that differ only in the order under ``And`` and ``Or``."""

        def canonical(n: Any) -> Any:
            if isinstance(n, dict):
                n = {k: canonical(v) for k, v in n.items()}
                if n.get("node") in ("And", "Or"):
                    n["parts"] = sorted(n["parts"], key=lambda x: json.dumps(x, sort_keys=True, default=str))
                return n
            return [canonical(x) for x in n] if isinstance(n, list) else n

        return json.dumps(canonical(self.to_json()), sort_keys=True, default=str)


class Value(Node):
    pass


class Predicate(Node):
    pass


@dataclass(frozen=True)
class Field(Value):
    path: str


@dataclass(frozen=True)
class Lit(Value):
    value: Any


@dataclass(frozen=True)
class Arith(Value):
    op: str  # + - * / %
    args: tuple


@dataclass(frozen=True)
class Neg(Value):
    arg: Value


@dataclass(frozen=True)
class Concat(Value):
    args: tuple


@dataclass(frozen=True)
class Coalesce(Value):
    args: tuple


@dataclass(frozen=True)
class DatePart(Value):
    part: str
    arg: Value
    tz: str | None = None


@dataclass(frozen=True)
class DateString(Value):
    arg: Value
    fmt: str
    tz: str | None = None


@dataclass(frozen=True)
class Cmp(Value):
    left: Value
    op: str
    right: Value


@dataclass(frozen=True)
class AllOf(Value):
    args: tuple


@dataclass(frozen=True)
class AnyOf(Value):
    args: tuple


@dataclass(frozen=True)
class Negate(Value):
    arg: Value


@dataclass(frozen=True)
class Cond(Value):
    test: Value
    then: Value
    other: Value


@dataclass(frozen=True)
class Switch(Value):
    cases: tuple  # of (when, then)
    other: Value


@dataclass(frozen=True)
class All(Predicate):
    pass


@dataclass(frozen=True)
class Compare(Predicate):
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Expr(Predicate):
    left: Value
    op: str
    right: Value


@dataclass(frozen=True)
class In(Predicate):
    path: str
    values: tuple


@dataclass(frozen=True)
class NotIn(Predicate):
    path: str
    values: tuple


@dataclass(frozen=True)
class Contains(Predicate):
    path: str
    value: Any


@dataclass(frozen=True)
class AnyElement(Predicate):
    path: str
    where: Predicate


@dataclass(frozen=True)
class Between(Predicate):
    path: str
    low: Any
    high: Any


@dataclass(frozen=True)
class Exists(Predicate):
    path: str
    should: bool = True


@dataclass(frozen=True)
class IsNull(Predicate):
    path: str
    negated: bool = False


@dataclass(frozen=True)
class Size(Predicate):
    path: str
    n: int


@dataclass(frozen=True)
class TextMatch(Predicate):
    path: str
    kind: str  # prefix, suffix, substring
    needle: str
    ignore_case: bool = False


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def from_json(data: Any) -> Any:
    """The node that to_json made this from."""
    if isinstance(data, list):
        return tuple(from_json(x) for x in data)
    if not isinstance(data, dict):
        return data
    if set(data) == {"date"}:
        return datetime.fromisoformat(data["date"])
    kind = globals().get(str(data.get("node")))
    if not (isinstance(kind, type) and issubclass(kind, Node)):
        raise ValueError(f"unknown node {data.get('node')!r}")
    return kind(**{k: from_json(v) for k, v in data.items() if k != "node"})


# builders: values
def field(path: str) -> Field:
    return Field(path)


def lit(value: Any) -> Lit:
    return Lit(value)


def as_value(v: Any) -> Value:
    return v if isinstance(v, Value) else Lit(v)


def _arith(op: str, *args: Any) -> Arith:
    return Arith(op, tuple(map(as_value, args)))


def add(*args: Any) -> Arith:
    return _arith("+", *args)


def sub(a: Any, b: Any) -> Arith:
    return _arith("-", a, b)


def mul(*args: Any) -> Arith:
    return _arith("*", *args)


def div(a: Any, b: Any) -> Arith:
    return _arith("/", a, b)


def mod(a: Any, b: Any) -> Arith:
    return _arith("%", a, b)


def neg(a: Any) -> Neg:
    return Neg(as_value(a))


def concat(*args: Any) -> Concat:
    return Concat(tuple(map(as_value, args)))


def coalesce(*args: Any) -> Coalesce:
    return Coalesce(tuple(map(as_value, args)))


def date_part(part: str, x: Any, tz: str | None = None) -> DatePart:
    if part not in PARTS:
        raise ValueError(f"no date part {part!r}")
    return DatePart(part, as_value(x), tz)


def year(x: Any, tz: str | None = None) -> DatePart:
    return date_part("year", x, tz)


def month(x: Any, tz: str | None = None) -> DatePart:
    return date_part("month", x, tz)


def day_of_month(x: Any, tz: str | None = None) -> DatePart:
    return date_part("dayOfMonth", x, tz)


def day_of_week(x: Any, tz: str | None = None) -> DatePart:
    return date_part("dayOfWeek", x, tz)


def hour(x: Any, tz: str | None = None) -> DatePart:
    return date_part("hour", x, tz)


def date_to_string(x: Any, fmt: str, tz: str | None = None) -> DateString:
    return DateString(as_value(x), fmt, tz)


def cmp(left: Any, op: str, right: Any) -> Cmp:
    return Cmp(as_value(left), _op(op), as_value(right))


def all_of(*args: Any) -> AllOf:
    return AllOf(tuple(map(as_value, args)))


def any_of(*args: Any) -> AnyOf:
    return AnyOf(tuple(map(as_value, args)))


def negate(x: Any) -> Negate:
    return Negate(as_value(x))


def cond(test: Any, then: Any, other: Any) -> Cond:
    return Cond(as_value(test), as_value(then), as_value(other))


def switch(cases: list[tuple[Any, Any]], other: Any) -> Switch:
    return Switch(tuple((as_value(a), as_value(b)) for a, b in cases), as_value(other))


# builders: predicates
def _op(op: str) -> str:
    if op not in OPS:
        raise ValueError(f"no operator {op!r}")
    return op


def everything() -> All:
    return All()


def compare(left: str | Value, op: str, right: Any) -> Predicate:
    return Expr(left, _op(op), as_value(right)) if isinstance(left, Value) else Compare(left, _op(op), right)


def eq(left: str | Value, right: Any) -> Predicate:
    return compare(left, "=", right)


def neq(left: str | Value, right: Any) -> Predicate:
    return compare(left, "!=", right)


def gt(left: str | Value, right: Any) -> Predicate:
    return compare(left, ">", right)


def lt(left: str | Value, right: Any) -> Predicate:
    return compare(left, "<", right)


def gte(left: str | Value, right: Any) -> Predicate:
    return compare(left, ">=", right)


def lte(left: str | Value, right: Any) -> Predicate:
    return compare(left, "<=", right)


def in_list(path: str, values: Any) -> In:
    return In(path, tuple(values))


def not_in_list(path: str, values: Any) -> NotIn:
    return NotIn(path, tuple(values))


def contains(path: str, value: Any) -> Contains:
    return Contains(path, value)


def any_element(path: str, where: Predicate) -> AnyElement:
    return AnyElement(path, where)


def between(path: str, low: Any, high: Any) -> Between:
    return Between(path, low, high)


def exists(path: str, should: bool = True) -> Exists:
    return Exists(path, should)


def is_null(path: str) -> IsNull:
    return IsNull(path)


def is_not_null(path: str) -> IsNull:
    return IsNull(path, True)


def size(path: str, n: int) -> Size:
    return Size(path, n)


def starts_with(path: str, needle: str, ignore_case: bool = False) -> TextMatch:
    return TextMatch(path, "prefix", needle, ignore_case)


def ends_with(path: str, needle: str, ignore_case: bool = False) -> TextMatch:
    return TextMatch(path, "suffix", needle, ignore_case)


def includes_text(path: str, needle: str, ignore_case: bool = False) -> TextMatch:
    return TextMatch(path, "substring", needle, ignore_case)


def and_(*parts: Predicate) -> And:
    return And(tuple(parts))


def or_(*parts: Predicate) -> Or:
    return Or(tuple(parts))


def not_(part: Predicate) -> Not:
    return Not(part)
