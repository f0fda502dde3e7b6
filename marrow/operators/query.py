"""The query builder: immutable, lazily compiled to one DataFrame plan."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marrow.functions import nodes as N
from marrow.plans import compiler, docfilter
from marrow.plans.compiler import Scope, Typed, kind_of
from marrow.schema import Model, Property, new_uuid
from marrow.session import shared_dir

RANKS = {"rowNumber": F.row_number, "rank": F.rank, "denseRank": F.dense_rank}


@dataclass(frozen=True)
class Aggregate:
    fn: str  # count countDistinct sum avg min max
    arg: Any = None


def count() -> Aggregate:
    return Aggregate("count")


def count_distinct(x: str | N.Value) -> Aggregate:
    return Aggregate("countDistinct", x)


def sum_(x: str | N.Value) -> Aggregate:
    return Aggregate("sum", x)


def avg(x: str | N.Value) -> Aggregate:
    return Aggregate("avg", x)


def min_(x: str | N.Value) -> Aggregate:
    return Aggregate("min", x)


def max_(x: str | N.Value) -> Aggregate:
    return Aggregate("max", x)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None


class Catalog:
    """Models with their data: where queries and relations find their tables."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}
        self._frames: dict[str, Callable[[], DataFrame]] = {}

    def add(self, model: Model, data: DataFrame | Callable[[], DataFrame]) -> Catalog:
        self.models[model.name] = model
        self._frames[model.name] = data if callable(data) else lambda: data
        return self

    def frame(self, name: str) -> DataFrame:
        return self._frames[name]()

    def query(self, name: str, policy: Callable[[Model], N.Predicate | None] | None = None) -> Query:
        return Query(self, self.models[name], policy=policy)

    def live(self, name: str, policy: Callable[[Model], N.Predicate | None] | None = None) -> DataFrame:
        """A model's rows without those that are softly deleted or that the policy hides."""
        return Query(self, self.models[name], policy=policy).rows()


@dataclass(frozen=True)
class Query:
    catalog: Catalog
    model: Model
    where_: N.Predicate = field(default_factory=N.All)
    order: tuple[tuple[str, bool], ...] = ()
    start: int = 0
    end: int | None = None
    deleted: bool = False
    policy: Callable[[Model], N.Predicate | None] | None = None

    # building
    def filter(self, p: N.Predicate) -> Query:
        return replace(self, where_=p if isinstance(self.where_, N.All) else N.And((self.where_, p)))

    def where(self, doc: Mapping[str, Any]) -> Query:
        return self.filter(docfilter.parse(doc))

    def sort(self, name: str, descending: bool = False) -> Query:
        if (p := self.model.properties.get(name.split(".")[0])) is not None and not p.stored:
            raise ValueError(f"{name} is computed and can't be sorted by")
        return replace(self, order=(*self.order, (name, descending)))

    def slice(self, start: int, end: int) -> Query:
        for n in (start, end):
            if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                raise ValueError("bounds are whole numbers from 0")
        if end < start:
            raise ValueError("the end lies before the start")
        return replace(self, start=start, end=end)

    def include_deleted(self) -> Query:
        return replace(self, deleted=True)

    # plans
    def scope(self, df: DataFrame) -> Scope:
        return Scope(df.schema)

    def rows(self) -> DataFrame:
        """The filtered rows, without order and paging."""
        df = self.catalog.frame(self.model.name)
        if self.policy is not None and (hidden := self.policy(self.model)) is not None:
            df = _filtered(self.catalog, self.model, df, hidden, self.policy)
        if self.model.soft_delete and not self.deleted:
            df = df.filter(F.col(self.model.soft_delete).isNull())
        return _filtered(self.catalog, self.model, df, self.where_, self.policy)

    def _sorted(self, df: DataFrame) -> DataFrame:
        """Ascending with nulls first, descending with nulls last; ties, and so pages without an order, by key."""
        if not self.order and not self.start and self.end is None:
            return df
        scope = self.scope(df)
        keys = [scope.resolve(n).col.desc_nulls_last() if d else scope.resolve(n).col.asc_nulls_first() for n, d in self.order]
        return df.orderBy(*keys, F.col(self.model.key).asc())

    def _paged(self, df: DataFrame) -> DataFrame:
        df = self._sorted(df)
        if self.start:
            df = df.offset(self.start)
        return df if self.end is None else df.limit(self.end - self.start)

    def frame(self) -> DataFrame:
        """Rows in order and paged, with computed properties."""
        df = self._paged(self.rows())
        decoded = {n: p.decode(F.col(n)) for n, p in self.model.properties.items() if p.decode and n in df.columns}
        df = df.withColumns(decoded) if decoded else df
        made = {n: p.compute(df) for n, p in self.model.properties.items() if p.kind == "computed"}
        return df.withColumns(made) if made else df

    def ids(self) -> DataFrame:
        return self._paged(self.rows()).select(self.model.key)

    def list(self) -> list[Row]:
        return self.frame().collect()

    def each(self, callback: Callable[[Row], None]) -> None:
        for row in self.frame().toLocalIterator():
            callback(row)

    def first(self) -> Row | None:
        return next(iter(self.frame().limit(1).collect()), None)

    def count(self) -> int:
        return self.rows().count()

    def count_frame(self, name: str = "count") -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias(name))

    def get(self, key: str) -> Row | None:
        return self.filter(N.Compare(self.model.key, "=", key)).first()

    def get_many(self, keys: Sequence[str]) -> DataFrame:
        """Rows in the order of the keys; unknown keys are left out."""
        df = self.rows()
        wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], T.StructType([T.StructField("_key", df.schema[self.model.key].dataType), T.StructField("_at", T.IntegerType())]))
        return df.join(wanted, df[self.model.key] == wanted["_key"]).orderBy("_at").drop("_key", "_at")

    def distinct(self, path: str) -> DataFrame:
        df = self.rows()
        return df.select(self.scope(df).resolve(path).col.alias(path.split(".")[-1])).distinct()

    # aggregation
    def aggregate(self, **aggs: Aggregate) -> DataFrame:
        df = self.rows()
        return df.agg(*[_aggregate(a, self.scope(df)).alias(n) for n, a in aggs.items()])

    def group_by(self, keys: str | N.Value | Sequence[str | N.Value] | Mapping[str, str | N.Value], **aggs: Aggregate) -> DataFrame:
        """One row for each key (null is a key), with the aggregates."""
        named = keys if isinstance(keys, Mapping) else {(k if isinstance(k, str) else "key" if i == 0 else f"key{i}"): k for i, k in enumerate([keys] if isinstance(keys, str | N.Value) else keys)}
        df = self.rows()
        scope = self.scope(df)
        cols = [_typed(k, scope).col.alias(n.replace(".", "_")) for n, k in named.items()]
        return df.groupBy(*cols).agg(*[_aggregate(a, scope).alias(n) for n, a in aggs.items()])

    # windows
    def windowed(self, partition_by: Sequence[str | N.Value] = (), **functions: str) -> DataFrame:
        """All filtered rows with rowNumber, rank or denseRank columns over the query's order.  Without a partition the
        rows are written to the shared folder in ranges of the order, so that no task holds them all."""
        df = self.rows()
        scope = self.scope(df)
        order = [scope.resolve(n).col.desc_nulls_last() if d else scope.resolve(n).col.asc_nulls_first() for n, d in self.order]
        parts = [_typed(p, scope).col for p in partition_by]
        key = F.col(self.model.key).asc()
        if not parts:
            return _ranked(df, order, key, functions)
        plain = Window.partitionBy(*parts).orderBy(*(order or [F.lit(1)]))
        tied = Window.partitionBy(*parts).orderBy(*order, key)
        return df.withColumns({n: RANKS[fn]().over(tied if fn == "rowNumber" else plain).cast("long") for n, fn in functions.items()})

    # keyset pages
    def page_frame(self, limit: int, after: str | None = None) -> DataFrame:
        """The rows after a cursor, one more than the limit: the filter of the keyset reaches the scan."""
        if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
            raise ValueError("a page has one row at least")
        df = self.rows()
        if after is not None:
            state = json.loads(base64.urlsafe_b64decode(after))
            if state["o"] != [list(o) for o in self.order]:
                raise ValueError("the cursor is of another order")
            df = df.filter(self._beyond(df, state["v"]))
        scope = self.scope(df)
        keys = [scope.resolve(n).col.desc_nulls_last() if d else scope.resolve(n).col.asc_nulls_first() for n, d in self.order]
        return df.orderBy(*keys, F.col(self.model.key).asc()).limit(limit + 1)

    def page(self, limit: int, after: str | None = None) -> Page:
        rows = self.page_frame(limit, after).collect()
        return Page(rows[:limit], self.cursor(rows[limit - 1]) if len(rows) > limit else None)

    def cursor(self, row: Row) -> str:
        def plain(v: Any) -> Any:
            return {"us": round((v - datetime(1970, 1, 1)).total_seconds() * 1e6)} if isinstance(v, datetime) else v

        def of(path: str) -> Any:
            return reduce(lambda v, k: None if v is None else v[k], path.split("."), row)

        state = {"o": [list(o) for o in self.order], "v": [plain(of(n)) for n, _ in self.order] + [plain(row[self.model.key])]}
        return base64.urlsafe_b64encode(json.dumps(state).encode()).decode()

    def _beyond(self, df: DataFrame, values: list[Any]) -> Column:
        scope = self.scope(df)
        keys = [(scope.resolve(n), d) for n, d in self.order] + [(Typed(F.col(self.model.key), df.schema[self.model.key].dataType), False)]
        out: list[Column] = []
        for k, (key, descending) in enumerate(keys):
            at = [F.timestamp_micros(F.lit(v["us"])).cast(t.type) if isinstance(v, dict) else F.lit(v).cast(t.type) for v, (t, _) in zip(values, keys, strict=True)]
            same = [t.col.eqNullSafe(a) if v is None else t.col == a for v, a, (t, _) in zip(values[:k], at, keys, strict=False)]
            if values[k] is None:  # nulls come first ascending, last descending
                step = F.lit(False) if descending else key.col.isNotNull()
            else:
                step = (key.col < at[k]) | key.col.isNull() if descending else key.col > at[k]
            out.append(reduce(lambda a, b: a & b, [*same, step]))
        return reduce(lambda a, b: a | b, out)

    # projection
    def select(self, spec: Mapping[str, Any]) -> DataFrame:
        """Named columns: True for a property, a value expression for a computed one, a nested spec for a struct or a
        relation.  The key is left out unless it is named."""
        df = self._paged(self.rows())
        return _select(self.catalog, self.model, df, spec, self.policy)

    def load(self, *relations: str) -> DataFrame:
        """Rows with the named relations in place of their references."""
        df = self._paged(self.rows())
        for name in relations:
            df = _loaded(self.catalog, self.model, df, name, None, self.policy)
        return self._sorted(df)

    def plan(self) -> dict[str, Any]:
        return {"model": self.model.name, "where": self.where_.to_json(), "order": [list(o) for o in self.order], "paging": {"start": self.start, "end": self.end}}

    def digest(self) -> str:
        return json.dumps(self.plan() | {"where": self.where_.digest(), "deleted": self.deleted}, sort_keys=True, default=str)


def from_plan(catalog: Catalog, plan: Mapping[str, Any], allowed: Sequence[str] | None = None, max_page: int | None = None, policy: Callable[[Model], N.Predicate | None] | None = None) -> Query:
    """A query from its JSON form, under a policy; models outside of the list, and those that start with _, are refused, and pages clamped."""
    name = plan["model"]
    if name.startswith("_") or (allowed is not None and name not in allowed) or name not in catalog.models:
        raise PermissionError(f"no model {name!r}")
    q = catalog.query(name, policy).filter(N.from_json(plan["where"]))
    for path, descending in plan.get("order", ()):
        q = q.sort(path, descending)
    start, end = plan.get("paging", {}).get("start", 0), plan.get("paging", {}).get("end")
    if max_page is not None:
        end = start + max_page if end is None else min(end, start + max_page)
    return q if end is None else q.slice(start, end)


def _typed(x: str | N.Value, scope: Scope) -> Typed:
    return scope.resolve(x, "number") if isinstance(x, str) else compiler.value(x, scope)


def _aggregate(a: Aggregate, scope: Scope) -> Column:
    """Numbers only: what is none is left out, and an empty group gives 0."""
    if a.fn == "count":
        return F.count(F.lit(1))
    v = _typed(a.arg, scope)
    if a.fn == "countDistinct":
        return F.count_distinct(F.to_json(v.col) if v.kind in ("struct", "variant") else v.col)
    if v.kind != "number":
        if v.kind != "date":
            return F.lit(0.0) + F.sum(F.lit(0.0)) * 0 if a.fn == "avg" else F.coalesce(F.max(F.lit(0.0)), F.lit(0.0))
        v = Typed(F.unix_millis(v.col.cast("timestamp")), T.LongType())
    col = F.when(F.abs(v.col) < float("inf"), v.col) if isinstance(v.type, T.DoubleType | T.FloatType) else v.col
    if a.fn in ("sum", "avg"):
        col = col.cast("double")
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](col), F.lit(0).cast("double" if a.fn in ("sum", "avg") else v.type))


def _ranked(df: DataFrame, order: Sequence[Column], key: Column, functions: Mapping[str, str]) -> DataFrame:
    """Ranks over all rows: within ranges of the order, from where the ranges before end.  Rows that tie are in one range
    unless only row numbers are asked for."""
    if not order and "rowNumber" not in functions.values():
        return df.withColumns({n: F.lit(1).cast("long") for n in functions})
    only_numbers = set(functions.values()) == {"rowNumber"} or not order
    path = f"{shared_dir(df.sparkSession)}/marrow-ranks-{new_uuid()}"
    ranged = df.repartitionByRange(*order, *([key] if only_numbers else []))
    ranged.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    kept = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    plain, tied = (Window.partitionBy("_part").orderBy(*o) for o in ((order or [F.lit(1)]), (*order, key)))
    local = {n: RANKS[fn]().over(tied if fn == "rowNumber" else plain).cast("long") for n, fn in functions.items()}
    dense = kept.withColumn("_dense", F.dense_rank().over(plain))
    rows, groups, offsets = 0, 0, []
    for r in dense.groupBy("_part").agg(F.count("*").alias("n"), F.max("_dense").alias("g")).orderBy("_part").collect():  # one row for each task
        offsets.append((r["_part"], rows, groups))
        rows, groups = rows + r["n"], groups + r["g"]
    if not offsets:
        return df.withColumns({n: F.lit(None).cast("long") for n in functions})
    before = lambda k: F.create_map(*[F.lit(x).cast("long") for o in offsets for x in (o[0], o[k])])[F.col("_part").cast("long")]
    shifted = {n: F.lit(1).cast("long") if not order and fn != "rowNumber" else F.col(n) + before(2 if fn == "denseRank" else 1) for n, fn in functions.items()}
    return kept.withColumns(local).withColumns(shifted).drop("_part")


# relations
def _relation(model: Model, path: str) -> tuple[str, Property, str] | None:
    head, _, rest = path.partition(".")
    p = model.properties.get(head)
    return (head, p, rest) if p is not None and p.kind == "relation" and not p.embed and rest else None


def _paths(p: N.Predicate) -> list[str]:
    if isinstance(p, N.And | N.Or):
        return [x for q in p.parts for x in _paths(q)]
    if isinstance(p, N.Not):
        return _paths(p.part)
    if isinstance(p, N.Expr):
        return []
    return [p.path] if hasattr(p, "path") else []


def _related_keys(catalog: Catalog, model: Model, df: DataFrame, leaf: N.Predicate, policy: Any) -> DataFrame:
    """The distinct keys of model's rows that have a related row for which the leaf holds."""
    head, p, rest = _relation(model, leaf.path)  # type: ignore[attr-defined,misc]
    target = catalog.models[p.target]
    hits = Query(catalog, target, policy=policy).filter(replace(leaf, path=rest)).rows().select(F.col(target.key).alias("_target"))
    if p.many:
        refs = df.select(F.col(model.key).alias("_owner"), F.explode(head).alias("_ref"))
        return refs.join(hits, refs["_ref"] == hits["_target"], "left_semi").select("_owner").distinct()
    return df.join(hits, df[head] == hits["_target"], "left_semi").select(F.col(model.key).alias("_owner")).distinct()


def _filtered(catalog: Catalog, model: Model, df: DataFrame, where: N.Predicate, policy: Any) -> DataFrame:
    """Conjuncts without relations filter the scan; a relation's leaf is a semi join, and inside of or and not a flag."""
    parts = where.parts if isinstance(where, N.And) else (where,)
    while any(isinstance(x, N.And) for x in parts):
        parts = tuple(y for x in parts for y in (x.parts if isinstance(x, N.And) else (x,)))
    for name in (n for x in parts for n in _paths(x)):
        if (q := model.properties.get(name.split(".")[0])) is not None and not q.stored:
            raise ValueError(f"{name} is computed and can't be filtered by")
    plain = [x for x in parts if not any(_relation(model, n) for n in _paths(x))]
    for x in plain:
        if not isinstance(x, N.All):
            df = df.filter(compiler.predicate(x, Scope(df.schema)))
    for x in parts:
        if x in plain:
            continue
        if hasattr(x, "path"):
            head, p, rest = _relation(model, x.path)  # type: ignore[misc]
            if p.many:
                df = df.join(_related_keys(catalog, model, df, x, policy), df[model.key] == F.col("_owner"), "left_semi")
            else:
                target = catalog.models[p.target]
                hits = Query(catalog, target, policy=policy).filter(replace(x, path=rest)).rows().select(F.col(target.key).alias("_target"))
                df = df.join(hits, df[head] == hits["_target"], "left_semi")
            continue
        columns, flags = df.columns, {}

        def leaf(node: N.Predicate, positive: bool, flags: dict = flags) -> Column | None:
            if not hasattr(node, "path") or not _relation(model, node.path):
                return None
            name = flags.setdefault(node.digest(), (f"_flag{len(flags)}", node))[0]
            found = F.col(name).isNotNull()
            return found if positive else ~found

        col = compiler.predicate(x, Scope(df.schema), True, leaf)
        for name, node in flags.values():
            head, p, rest = _relation(model, node.path)  # type: ignore[misc]
            if not p.many:  # a target's key is there once, so the foreign key finds one flag at most
                target = catalog.models[p.target]
                hits = Query(catalog, target, policy=policy).filter(replace(node, path=rest)).rows().select(F.col(target.key).alias(f"{name}_k"), F.lit(True).alias(name))
                df = df.join(hits, df[head] == hits[f"{name}_k"], "left").drop(f"{name}_k")
                continue
            keys = _related_keys(catalog, model, df.select(columns), node, policy).select(F.col("_owner").alias(f"{name}_k"), F.lit(True).alias(name))
            df = df.join(keys, df[model.key] == keys[f"{name}_k"], "left").drop(f"{name}_k")
        df = df.filter(col).select(columns)
    return df


def _target_rows(catalog: Catalog, p: Property, spec: Mapping[str, Any] | None, policy: Any) -> tuple[DataFrame, str]:
    target = catalog.models[p.target]
    rows = Query(catalog, target, policy=policy).rows()
    if spec is None:
        scalars = [n for n in rows.columns if target.properties.get(n) is None or target.properties[n].kind != "relation"]
        out = rows.select(F.col(target.key).alias("_target"), F.struct(*scalars).alias("_one"))
    else:
        out = _select(catalog, target, rows.withColumn("_target", F.col(target.key)), spec, policy, keep=("_target",))
        out = out.select("_target", F.struct(*[c for c in out.columns if c != "_target"]).alias("_one"))
    return out, target.key


def _loaded(catalog: Catalog, model: Model, df: DataFrame, name: str, spec: Mapping[str, Any] | None, policy: Any) -> DataFrame:
    """df with the relation's rows in place of its references: a struct or null, or an array in the references' order."""
    p = model.properties[name]
    if p.embed:
        return df
    one, _ = _target_rows(catalog, p, spec, policy)
    columns = df.columns
    if not p.many:
        out = df.join(one, df[name] == one["_target"], "left")
        return out.select(*[F.col("_one").alias(c) if c == name else df[c] for c in columns])
    refs = df.select(F.col(model.key).alias("_owner"), F.posexplode(name).alias("_at", "_ref"))
    found = refs.join(one, refs["_ref"] == one["_target"]).groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("_at", "_one"))).alias("_all"))
    out = df.join(found, df[model.key] == found["_owner"], "left")
    empty = F.array().cast(T.ArrayType(one.schema["_one"].dataType))
    many = F.coalesce(F.transform("_all", lambda x: x["_one"]), empty)
    return out.select(*[many.alias(c) if c == name else df[c] for c in columns])


def _embedded(catalog: Catalog, model: Model, df: DataFrame, name: str, spec: Mapping[str, Any], policy: Any) -> DataFrame:
    """df with the to-one references that the spec follows inside of an embedded document (or an array of them) as rows."""
    p = model.properties[name]
    inside = catalog.models[p.target].properties if p.target in catalog.models else {}
    for field_, want in spec.items():
        q = inside.get(field_)
        if not isinstance(want, Mapping) or q is None or q.kind != "relation" or q.embed or q.many:
            continue
        one, _ = _target_rows(catalog, q, want, policy)
        if not p.many:
            found = df.join(one, df[name][field_] == one["_target"], "left")
            put = F.when(df[name].isNotNull(), df[name].withField(field_, F.col("_one")))
            df = found.select(*[put.alias(c) if c == name else df[c] for c in df.columns])
            continue
        each = df.select(F.col(model.key).alias("_owner"), F.posexplode(name).alias("_at", "_doc"))
        each = each.join(one, each["_doc"][field_] == one["_target"], "left").withColumn("_doc", F.when(F.col("_doc").isNotNull(), F.col("_doc").withField(field_, F.col("_one"))))
        found = each.groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("_at", "_doc"))).alias("_all"))
        out = df.join(found, df[model.key] == found["_owner"], "left")
        many = F.when(df[name].isNotNull(), F.coalesce(F.transform("_all", lambda x: x["_doc"]), F.array().cast(T.ArrayType(each.schema["_doc"].dataType))))
        df = out.select(*[many.alias(c) if c == name else df[c] for c in df.columns])
    return df


def _select(catalog: Catalog, model: Model, df: DataFrame, spec: Mapping[str, Any], policy: Any, keep: Sequence[str] = ()) -> DataFrame:
    for name, want in spec.items():
        p = model.properties.get(name)
        if p is not None and p.kind == "relation" and not p.embed:
            df = _loaded(catalog, model, df, name, None if want is True else want, policy)
        elif p is not None and p.embed and isinstance(want, Mapping):
            df = _embedded(catalog, model, df, name, want, policy)
    scope = Scope(df.schema)
    cols = [F.col(k) for k in keep]
    for name, want in spec.items():
        p = model.properties.get(name)
        if isinstance(want, N.Value):
            col = compiler.value(want, scope).col
        elif p is not None and p.kind == "computed":
            col = p.compute(df)
        elif want is True or (p is not None and p.kind == "relation" and not p.embed):
            col = scope.resolve(name).col
        else:
            col = _shaped(scope.resolve(name), want)
        cols.append(col.alias(name.split(".")[-1]))
    return df.select(*cols)


def _shaped(v: Typed, spec: Mapping[str, Any]) -> Column:
    if isinstance(v.type, T.ArrayType):
        return F.transform(v.col, lambda x: _shaped(Typed(x, v.type.elementType), spec))
    scope = Scope(v.type, v.col.getField)
    fields = []
    for name, want in spec.items():
        inner = compiler.value(want, scope) if isinstance(want, N.Value) else scope.resolve(name)
        fields.append((inner.col if want is True or isinstance(want, N.Value) else _shaped(inner, want)).alias(name))
    return F.when(v.col.isNotNull(), F.struct(*fields))
