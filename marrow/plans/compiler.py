"""Trees to Columns.

Predicates are two-valued: a comparison with a missing value is false and its negation true.  Negation is pushed to
the leaves instead of wrapped around them, so that filters stay in the forms that reach the Parquet scan: equality
is null-safe, and a negated ordering becomes ``NOT (a < b) OR a IS NULL``.  Types are strict: a literal of another
type than the field's equals nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import nodes as N

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRUE, FALSE = lambda: F.lit(True), lambda: F.lit(False)


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.type)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    for cls, name in ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.TimestampType, "date"), (T.TimestampNTZType, "date"), (T.DateType, "date"), (T.ArrayType, "array"), (T.StructType, "struct"), (T.NullType, "null"), (T.VariantType, "variant")):
        if isinstance(t, cls):
            return name
    return "other"


def kind_of_literal(v: Any) -> str:
    for cls, name in ((bool, "boolean"), (int | float, "number"), (str, "string"), (datetime | date, "date"), (list | tuple, "array")):
        if isinstance(v, cls):
            return name
    return "null" if v is None else "other"


class Scope:
    """Resolves property paths against a struct type; paths go into structs and variants, never into arrays."""

    def __init__(self, struct: T.StructType, base: Callable[[str], Column] | None = None, alias: dict[str, Typed] | None = None):
        self.struct, self.base, self.alias = struct, base or (lambda name: F.col(f"`{name}`")), alias or {}

    def resolve(self, path: str, wanted: str = "string") -> Typed:
        if path in self.alias:
            return self.alias[path]
        head, *rest = path.split(".")
        if head not in self.struct.names:
            return Typed(F.lit(None), T.NullType())
        col, t = self.base(head), self.struct[head].dataType
        for i, name in enumerate(rest):
            if isinstance(t, T.VariantType):
                target = {"number": "double", "boolean": "boolean", "date": "timestamp"}.get(wanted, "string")
                strict = F.try_variant_get(col, variant_path(rest[i:]), "variant")
                shape = {"number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "boolean": "^BOOLEAN", "date": "^TIMESTAMP"}.get(wanted, "^STRING")
                value = F.when(F.schema_of_variant(strict).rlike(shape), F.try_variant_get(strict, "$", target))
                return Typed(value, T._parse_datatype_string(target))
            if not isinstance(t, T.StructType) or name not in t.names:
                return Typed(F.lit(None), T.NullType())
            col, t = col.getField(name), t[name].dataType
        return Typed(col, t)


def variant_path(names: list[str]) -> str:
    """A path into a variant in which every name is quoted; a name with a quote or a backslash can't be said."""
    if any(set(n) & set("'\"\\") for n in names):
        raise ValueError(f"no field {'.'.join(names)!r}")
    return "$" + "".join(f"['{n}']" for n in names)


# values
def number(v: Typed) -> Column:
    """The number that arithmetic sees: what is no number counts as 0."""
    if v.kind == "number":
        return F.coalesce(v.col, F.lit(0).cast(v.type))
    if v.kind in ("string", "boolean"):
        return F.coalesce(v.col.try_cast("double") if v.kind == "string" else v.col.cast("double"), F.lit(0.0))
    if v.kind == "date":
        return F.coalesce(F.unix_millis(v.col.cast("timestamp")), F.lit(0).cast("long"))
    return F.lit(0.0)


def string(v: Typed) -> Column:
    """The text that concat sees: null is empty, and a whole double has no point."""
    if v.kind == "number" and isinstance(v.type, T.DoubleType | T.FloatType):
        d = v.col.cast("double")
        whole = (d == F.rint(d)) & (F.abs(d) < 1e15)
        out = F.when(whole, F.when(whole, d).cast("bigint").cast("string")).otherwise(d.cast("string"))
    elif v.kind == "date":
        out = F.unix_millis(v.col.cast("timestamp")).cast("string")
    elif v.kind in ("array", "struct"):
        out = F.to_json(v.col)
    elif v.kind == "null":
        return F.lit("")
    else:
        out = v.col.cast("string")
    return F.coalesce(out, F.lit(""))


def truthy(v: Typed) -> Column:
    if v.kind == "boolean":
        return F.coalesce(v.col, FALSE())
    if v.kind == "number":
        return F.coalesce(v.col != 0, FALSE())
    return FALSE() if v.kind == "null" else v.col.isNotNull()


def literal(v: Any) -> Typed:
    if isinstance(v, bool):
        return Typed(F.lit(v), T.BooleanType())
    if isinstance(v, int):
        return Typed(F.lit(v).cast("long"), T.LongType())
    if isinstance(v, float):
        return Typed(F.lit(v), T.DoubleType())
    if isinstance(v, datetime):
        return Typed(F.lit(v).cast("timestamp"), T.TimestampType())
    return Typed(F.lit(v), T.NullType() if v is None else T.StringType())


def _common(values: list[Typed]) -> T.DataType:
    kinds = [v for v in values if v.kind != "null"]
    if not kinds:
        return T.NullType()
    if all(v.kind == "number" for v in kinds):
        return T.LongType() if all(isinstance(v.type, T.IntegralType) for v in kinds) else T.DoubleType()
    return kinds[0].type if len({v.kind for v in kinds}) == 1 else T.StringType()


def _cast(v: Typed, t: T.DataType) -> Column:
    if isinstance(t, T.StringType) and v.kind not in ("string", "null"):
        return F.when(v.col.isNotNull(), string(v))
    return v.col.cast(t)


def _zoned(v: Typed, tz: str | None) -> Column:
    ts = F.timestamp_millis(v.col.cast("long")) if v.kind == "number" else v.col.cast("timestamp")
    return F.from_utc_timestamp(ts, tz) if tz and tz != "UTC" else ts


def _relate(left: Typed, op: str, right: Typed) -> Column:
    """Two-valued comparison of values; missing counts as null, and null equals null."""
    kinds = {left.kind, right.kind}
    if kinds == {"date", "number"}:
        left, right = (Typed(F.unix_millis(v.col.cast("timestamp")), T.LongType()) if v.kind == "date" else v for v in (left, right))
        kinds = {"number"}
    comparable = len(kinds) == 1 or "null" in kinds
    if op in ("=", "!="):
        if not comparable:  # of different types: equal only if both are null
            same = left.col.isNull() & right.col.isNull()
        else:
            same = left.col.eqNullSafe(right.col)
        return same if op == "=" else ~same
    if len(kinds) > 1 or "null" in kinds:
        return FALSE()
    return F.coalesce(_ordered(left.col, op, right.col), FALSE())


def _ordered(a: Column, op: str, b: Column) -> Column:
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def value(node: N.Value, scope: Scope) -> Typed:
    """The column of a value expression, with its type."""
    at = lambda n: value(n, scope)
    match node:
        case N.Field(path):
            return scope.resolve(path, "number")
        case N.Lit(v):
            return literal(v)
        case N.Arith(op, args):
            cols = [number(at(a)) for a in args]
            parts = [at(a) for a in args]
            whole = all(p.kind == "number" and isinstance(p.type, T.IntegralType) for p in parts)
            if op == "/":
                return Typed(F.coalesce(F.try_divide(cols[0].cast("double"), cols[1].cast("double")), F.lit(0.0)), T.DoubleType())
            if op == "%":
                return Typed(F.coalesce(F.try_mod(*cols), F.lit(0).cast("long" if whole else "double")), T.LongType() if whole else T.DoubleType())
            step = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}[op]
            kind = T.LongType() if whole else T.DoubleType()
            return Typed(reduce(step, [c.cast(kind) for c in cols], F.lit(1 if op == "*" else 0).cast(kind)) if not cols else reduce(step, [c.cast(kind) for c in cols]), kind)
        case N.Neg(arg):
            v = at(arg)
            return Typed(-number(v), v.type if v.kind == "number" else T.DoubleType())
        case N.Concat(args):
            return Typed(F.concat(*[string(at(a)) for a in args]) if args else F.lit(""), T.StringType())
        case N.Coalesce(args):
            parts = [at(a) for a in args]
            t = _common(parts)
            return Typed(F.coalesce(*[_cast(p, t) for p in parts]), t)
        case N.DatePart(part, arg, tz):
            ts = _zoned(at(arg), tz)
            get = {"year": F.year, "month": F.month, "dayOfMonth": F.dayofmonth, "dayOfWeek": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second}[part]
            return Typed(get(ts).cast("long"), T.LongType())
        case N.DateString(arg, fmt, tz):
            return Typed(F.date_format(_zoned(at(arg), tz), java_format(fmt)), T.StringType())
        case N.Cmp(left, op, right):
            return Typed(_relate(at(left), op, at(right)), T.BooleanType())
        case N.AllOf(args):
            return Typed(reduce(lambda a, b: a & b, [truthy(at(a)) for a in args], TRUE()), T.BooleanType())
        case N.AnyOf(args):
            return Typed(reduce(lambda a, b: a | b, [truthy(at(a)) for a in args], FALSE()), T.BooleanType())
        case N.Negate(arg):
            return Typed(~truthy(at(arg)), T.BooleanType())
        case N.Cond(test, then, other):
            a, b = at(then), at(other)
            t = _common([a, b])
            return Typed(F.when(truthy(at(test)), _cast(a, t)).otherwise(_cast(b, t)), t)
        case N.Switch(cases, other):
            ends = [at(b) for _, b in cases] + [at(other)]
            t = _common(ends)
            out = _cast(ends[-1], t)
            for (test, _), end in reversed(list(zip(cases, ends, strict=False))):
                out = F.when(truthy(at(test)), _cast(end, t)).otherwise(out)
            return Typed(out, t)
    raise TypeError(f"no value: {node!r}")


def java_format(fmt: str) -> str:
    """%Y %m %d %H %M %S %% as a pattern of date_format; everything else is quoted."""
    codes, out, text, i = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}, "", "", 0

    def quoted() -> str:
        return "'" + text.replace("'", "''") + "'" if text else ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt) and (fmt[i + 1] in codes or fmt[i + 1] == "%"):
            if fmt[i + 1] == "%":
                text += "%"
            else:
                out, text = out + quoted() + codes[fmt[i + 1]], ""
            i += 2
        else:
            text, i = text + fmt[i], i + 1
    return out + quoted()


# predicates
def predicate(node: N.Predicate, scope: Scope, positive: bool = True, leaf: Callable | None = None) -> Column:
    """The filter for a predicate (or for its negation).  leaf may take over a node by returning its column."""
    go = lambda n, p: predicate(n, scope, p, leaf)
    if leaf is not None and (taken := leaf(node, positive)) is not None:
        return taken
    match node:
        case N.All():
            return F.lit(positive)
        case N.And(parts) | N.Or(parts):
            is_and = isinstance(node, N.And) == positive
            cols = [go(p, positive) for p in parts]
            return reduce((lambda a, b: a & b) if is_and else (lambda a, b: a | b), cols) if cols else F.lit(is_and)
        case N.Not(part):
            return go(part, not positive)
        case N.Compare(path, op, v):
            return _compare(scope, path, op, v, positive)
        case N.Expr(left, op, right):
            col = _relate(value(left, scope), op, value(right, scope))
            return col if positive else ~col
        case N.In(path, values):
            return _in(scope, path, values, positive)
        case N.NotIn(path, values):
            return _in(scope, path, values, not positive)
        case N.Contains(path, v):
            arr = scope.resolve(path)
            if arr.kind != "array" or not _fits(arr.type.elementType, v):
                return F.lit(not positive)
            return _two(F.exists(arr.col, lambda x: x.eqNullSafe(_like(arr.type.elementType, v))), arr.col, positive)
        case N.AnyElement(path, where):
            arr = scope.resolve(path)
            if arr.kind != "array":
                return F.lit(not positive)
            element = arr.type.elementType

            def one(x: Column) -> Column:
                struct = element if isinstance(element, T.StructType) else T.StructType([T.StructField("value", element)])
                inner = Scope(struct, x.getField) if isinstance(element, T.StructType) else Scope(struct, lambda _: x)
                return F.coalesce(predicate(where, inner), FALSE())

            return _two(F.exists(arr.col, one), arr.col, positive)
        case N.Between(path, low, high):
            return go(N.And((N.Compare(path, ">=", low), N.Compare(path, "<=", high))), positive)
        case N.Exists(path, should):
            col = scope.resolve(path).col
            return col.isNotNull() if should == positive else col.isNull()
        case N.IsNull(path, negated):
            col = scope.resolve(path).col
            return col.isNull() if negated != positive else col.isNotNull()
        case N.Size(path, n):
            arr = scope.resolve(path)
            return _two(F.size(arr.col) == n, arr.col, positive) if arr.kind == "array" else F.lit(not positive)
        case N.TextMatch(path, kind, needle, ignore_case):
            v = scope.resolve(path, "string")
            if v.kind != "string":
                return F.lit(not positive)
            fold = (lambda c: F.translate(c, UPPER, LOWER)) if ignore_case else (lambda c: c)
            wanted = needle.translate(str.maketrans(UPPER, LOWER)) if ignore_case else needle
            match_ = {"prefix": F.startswith, "suffix": F.endswith, "substring": F.contains}[kind]
            return _two(match_(fold(v.col), F.lit(wanted)), v.col, positive)
    raise TypeError(f"no predicate: {node!r}")


def _two(col: Column, operand: Column, positive: bool) -> Column:
    """col, or its negation that holds where the operand is missing."""
    return col if positive else operand.isNull() | ~col


def _fits(t: T.DataType, v: Any) -> bool:
    kind, given = kind_of(t), kind_of_literal(v)
    return given == "null" or kind == given or (kind == "date" and given == "number")


def _like(t: T.DataType, v: Any) -> Column:
    if v is None:
        return F.lit(None).cast(t)
    if kind_of(t) == "date":
        instant = F.timestamp_millis(F.lit(int(v))) if kind_of_literal(v) == "number" else F.lit(v).cast("timestamp")
        return instant.cast(t)
    if isinstance(t, T.IntegralType) and isinstance(v, float) and not v.is_integer():
        return F.lit(v)
    return F.lit(v).cast(t) if isinstance(t, T.IntegralType) and abs(v) < 1 << (31 if isinstance(t, T.IntegerType) else 63) else F.lit(v)


def _compare(scope: Scope, path: str, op: str, v: Any, positive: bool) -> Column:
    if op == "!=":
        return _compare(scope, path, "=", v, not positive)
    field = scope.resolve(path, kind_of_literal(v))
    if field.kind == "array" and kind_of_literal(v) != "array" and op == "=":
        return predicate(N.Contains(path, v), scope, positive)
    if v is None or not _fits(field.type, v):  # by name, null equals an explicit null only, which typed columns don't keep
        return F.lit(not positive)
    if op == "=":
        if kind_of_literal(v) == "array":
            col = field.col.eqNullSafe(F.array(*[_like(field.type.elementType, x) for x in v]).cast(field.type))
        else:
            col = field.col.eqNullSafe(_like(field.type, v))
        return col if positive else ~col
    return _two(_ordered(field.col, op, _like(field.type, v)), field.col, positive)


def _in(scope: Scope, path: str, values: tuple, positive: bool) -> Column:
    given = [v for v in values if v is not None]
    field = scope.resolve(path, kind_of_literal(given[0]) if given else "string")
    fitting = [v for v in given if _fits(field.type, v) and field.kind != "null"]
    if not fitting:
        return F.lit(not positive)
    return _two(field.col.isin([_like(field.type, v) for v in fitting]), field.col, positive)
