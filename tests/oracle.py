"""The rules for missing values and types, restated on plain Python rows, to hold the compiled plans against."""

from __future__ import annotations

from typing import Any

from marrow.functions import nodes as N

ABSENT = object()


def get(row: dict[str, Any], path: str) -> Any:
    v: Any = row
    for k in path.split("."):
        if not isinstance(v, dict) or k not in v:
            return ABSENT
        v = v[k]
    return ABSENT if v is None else v  # typed columns don't tell null from absent


def _type(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else type(v).__name__


def _order(a: Any, op: str, b: Any) -> bool:
    if a is ABSENT or b is None or _type(a) != _type(b):
        return False
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def holds(p: N.Predicate, row: dict[str, Any]) -> bool:
    match p:
        case N.All():
            return True
        case N.And(parts):
            return all(holds(x, row) for x in parts)
        case N.Or(parts):
            return any(holds(x, row) for x in parts)
        case N.Not(part):
            return not holds(part, row)
        case N.Compare(path, op, v):
            a = get(row, path)
            same = a is not ABSENT and v is not None and _type(a) == _type(v) and a == v
            if isinstance(a, list):
                same = v in a
            return same if op == "=" else not same if op == "!=" else _order(a, op, v)
        case N.In(path, values):
            a = get(row, path)
            return a is not ABSENT and any(_type(a) == _type(v) and a == v for v in values)
        case N.NotIn(path, values):
            return not holds(N.In(path, values), row)
        case N.Between(path, low, high):
            a = get(row, path)
            return _order(a, ">=", low) and _order(a, "<=", high)
        case N.IsNull(path, negated):
            return (get(row, path) is ABSENT) != negated
        case N.Exists(path, should):
            return (get(row, path) is not ABSENT) == should
        case N.Size(path, n):
            a = get(row, path)
            return isinstance(a, list) and len(a) == n
        case N.Contains(path, v):
            a = get(row, path)
            return isinstance(a, list) and v in a
        case N.TextMatch(path, kind, needle, _):
            a = get(row, path)
            return isinstance(a, str) and {"prefix": a.startswith, "suffix": a.endswith, "substring": a.__contains__}[kind](needle)
    raise TypeError(p)
