"""Set-based updates as column expressions: every new value is computed from the row before the update."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marrow.functions import nodes as N
from marrow.plans import compiler
from marrow.plans.compiler import Scope, Typed
from marrow.schema import Model


@dataclass(frozen=True)
class Op:
    name: str  # set unset inc mul push addToSet pull
    arg: Any = None


def set_(v: Any) -> Op:
    """A value, or a value expression over the row before the update."""
    return Op("set", v)


def unset() -> Op:
    return Op("unset")


def inc(by: float = 1) -> Op:
    return Op("inc", by)


def mul(by: float) -> Op:
    return Op("mul", by)


def push(*values: Any) -> Op:
    return Op("push", values)


def add_to_set(*values: Any) -> Op:
    return Op("addToSet", values)


def pull(*values: Any) -> Op:
    return Op("pull", values)


def _literal(v: Any, t: T.DataType) -> Column:
    if isinstance(v, list | tuple) and isinstance(t, T.ArrayType):
        return F.array(*[_literal(x, t.elementType) for x in v]).cast(t)
    if isinstance(v, Mapping) and isinstance(t, T.StructType):
        return F.struct(*[_literal(v.get(f.name), f.dataType).alias(f.name) for f in t])
    return F.lit(v).cast(t)


def new_value(op: Any, old: Typed, scope: Scope) -> Column:
    op = op if isinstance(op, Op) else Op("set", op)
    t = old.type
    if op.name == "set":
        return compiler.value(op.arg, scope).col.cast(t) if isinstance(op.arg, N.Value) else _literal(op.arg, t)
    if op.name == "unset":
        return F.lit(None).cast(t)
    if op.name in ("inc", "mul"):
        n = compiler.number(old)
        return (n + F.lit(op.arg) if op.name == "inc" else n * F.lit(op.arg)).cast(t)
    empty = F.array().cast(t)
    arr, given = F.coalesce(old.col, empty), _literal(list(op.arg), t)
    if op.name == "push":
        return F.concat(arr, given)
    if op.name == "addToSet":  # copies that are there stay; array_union would drop them
        return F.concat(arr, F.filter(F.array_distinct(given), lambda x: ~F.exists(arr, lambda y: y.eqNullSafe(x))))
    if op.name == "pull":
        return F.when(old.col.isNotNull(), F.filter(arr, lambda x: ~F.exists(given, lambda y: y.eqNullSafe(x))))
    raise ValueError(f"no update {op.name!r}")


def patched(df: DataFrame, model: Model, where: N.Predicate, spec: Mapping[str, Any], now: datetime | None = None) -> DataFrame:
    """df with the updates applied to the rows for which the predicate holds."""
    scope = Scope(df.schema)
    hit = compiler.predicate(where, scope)
    spec = dict(spec)
    if model.timestamps and "updatedAt" in df.columns:
        spec.setdefault("updatedAt", now or datetime.now(UTC).replace(tzinfo=None))
    by_head: dict[str, list[tuple[list[str], Any]]] = {}
    for path, op in spec.items():
        head, *rest = path.split(".")
        by_head.setdefault(head, []).append((rest, op))
    changed = {}
    for head, changes in by_head.items():
        if head not in df.columns:
            raise ValueError(f"{model.name} has no {head}")
        col = F.col(head)
        for rest, op in changes:
            if rest:
                old = scope.resolve(".".join([head, *rest]))
                col = col.withField(".".join(rest), new_value(op, old, scope))
            else:
                col = new_value(op, scope.resolve(head), scope)
        changed[head] = F.when(F.coalesce(hit, F.lit(False)), col).otherwise(F.col(head))
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: that with the highest position."""
    w = Window.partitionBy(key).orderBy(F.col(position).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged(base: DataFrame, changes: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """Upsert by key: changes replace rows of the same key; within changes the highest position wins."""
    if position is not None:
        changes = last_wins(changes, key, position).drop(position)
    columns = base.columns
    return base.join(changes.select(key), key, "left_anti").select(columns).unionByName(changes.select(columns))


def removed(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti").select(base.columns)


def violations(df: DataFrame, model: Model) -> DataFrame:
    """(columns, n) for each unique key that several rows share; a null in a key is never shared."""
    found = []
    for names in model.unique_keys():
        rows = df.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
        for i in model.indexes:
            if i.columns == tuple(names) and i.where is not None:
                rows = rows.filter(compiler.predicate(i.where, Scope(df.schema)))
        n = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(n.select(F.lit(",".join(names)).alias("columns"), F.to_json(F.struct(*names)).alias("key"), "n"))
    empty = df.sparkSession.createDataFrame([], "columns string, key string, n long")
    return reduce(lambda a, b: a.unionByName(b), found, empty)


def dirty(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, fields): the names of the columns in which a row of after differs from its row in before."""
    names = [c for c in after.columns if c != key]
    b = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_b_{c}") for c in names])
    joined = after.join(b, after[key] == b["_key"])
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in names]))
    return joined.select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def seed(match: N.Predicate, update: Mapping[str, Any], on_insert: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The row that an upsert inserts: the match's equalities, what is set, and on_insert."""
    equal = {p.path: p.value for p in (match.parts if isinstance(match, N.And) else (match,)) if isinstance(p, N.Compare) and p.op == "="}
    plain = {k: (v.arg if isinstance(v, Op) else v) for k, v in update.items() if not isinstance(v, Op) or v.name == "set"}
    return equal | plain | dict(on_insert or {})
