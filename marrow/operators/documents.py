"""A document collection's interface: dict filters, pipelines and updates over a store's model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from marrow.functions import nodes as N
from marrow.operators import patch
from marrow.operators.query import Aggregate, Catalog, Query
from marrow.plans import docfilter
from marrow.plans.docfilter import Unsupported
from marrow.schema import Model, new_uuid

Policy = Callable[[Model], N.Predicate | None] | None
_ACCUMULATORS = {"$avg": "avg", "$min": "min", "$max": "max"}


def find(catalog: Catalog, name: str, doc: Mapping[str, Any] | None = None, sort: Mapping[str, int] | None = None, skip: int = 0, limit: int | None = None, policy: Policy = None) -> Query:
    q = catalog.query(name, policy).where(doc or {})
    for key, direction in (sort or {}).items():
        q = q.sort(key, direction < 0)
    return q.slice(skip, skip + limit) if limit is not None else q if not skip else q.slice(skip, skip + (1 << 31) - 1)


def pipeline(catalog: Catalog, name: str, stages: Sequence[Mapping[str, Any]], policy: Policy = None) -> DataFrame:
    """$match, $sort, $skip, $limit, then $group or $count, then $sort, $skip, $limit; other stages raise.

    Before $group and $count, $skip and $limit have no effect: these see all rows that match."""
    q, skip, limit = catalog.query(name, policy), 0, None
    out: DataFrame | None = None
    for stage in stages:
        if len(stage) != 1:
            raise Unsupported("a stage has one operator")
        op, arg = next(iter(stage.items()))
        if out is not None:
            if op == "$sort":
                out = out.orderBy(*[F.col(k).desc_nulls_last() if d < 0 else F.col(k).asc_nulls_first() for k, d in arg.items()])
            elif op == "$skip":
                out = out.offset(arg)
            elif op == "$limit":
                out = out.limit(arg)
            elif op == "$count":
                out = out.agg(F.count(F.lit(1)).alias(arg))
            else:
                raise Unsupported(f"{op} after $group")
        elif op == "$match":
            q = q.where(arg)
        elif op == "$sort":
            for key, direction in arg.items():
                q = q.sort(key, direction < 0)
        elif op == "$skip":
            skip += arg
        elif op == "$limit":
            limit = arg if limit is None else min(limit, arg)
        elif op == "$count":
            out = q.count_frame(arg)
        elif op == "$group":
            out = _group(q, arg)
        else:
            raise Unsupported(f"stage {op}")
    if out is None:
        out = (q.slice(skip, skip + limit) if limit is not None else q.slice(skip, skip + (1 << 31) - 1) if skip else q).frame()
    return out


def _name(x: Any) -> str:
    if not isinstance(x, str) or not x.startswith("$") or len(x) < 2:
        raise Unsupported(f"{x!r} is no field")
    return x[1:]


def _group(q: Query, spec: Mapping[str, Any]) -> DataFrame:
    aggs = {}
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, Mapping) or len(acc) != 1:
            raise Unsupported(f"accumulator of {name}")
        op, arg = next(iter(acc.items()))
        if op == "$count" or (op == "$sum" and arg == 1 and not isinstance(arg, bool)):
            aggs[name] = Aggregate("count")
        elif op == "$sum" and not isinstance(arg, str):
            raise Unsupported("$sum of a number other than 1")
        elif op == "$sum":
            aggs[name] = Aggregate("sum", _name(arg))
        elif op in _ACCUMULATORS:
            aggs[name] = Aggregate(_ACCUMULATORS[op], _name(arg))
        else:
            raise Unsupported(f"accumulator {op}")
    if spec.get("_id") is None:
        return q.aggregate(**aggs).select(F.lit(None).cast("string").alias("_id"), *aggs)
    return q.group_by({"_id": _name(spec["_id"])}, **aggs)


def parse_update(doc: Mapping[str, Any], now: datetime | None = None) -> tuple[dict[str, Any], dict[str, Any]]:
    """(updates, values for inserts only) of an update document."""
    if not doc:
        raise Unsupported("an empty update")
    out: dict[str, Any] = {}
    insert: dict[str, Any] = {}

    def put(name: str, op: Any) -> None:
        if name in out:
            raise Unsupported(f"two updates of {name}")
        out[name] = op

    for op, fields in doc.items():
        if not op.startswith("$"):
            raise Unsupported("a replacement is no update")
        for name, v in fields.items():
            if op == "$set":
                put(name, patch.set_(v))
            elif op == "$unset":
                put(name, patch.unset())
            elif op == "$inc":
                put(name, patch.inc(v))
            elif op == "$mul":
                put(name, patch.mul(v))
            elif op in ("$push", "$addToSet"):
                each = v["$each"] if isinstance(v, Mapping) and "$each" in v else [v]
                put(name, (patch.push if op == "$push" else patch.add_to_set)(*each))
            elif op == "$pull":
                if isinstance(v, Mapping) and set(v) != {"$in"}:
                    raise Unsupported("$pull by a condition")
                put(name, patch.pull(*(v["$in"] if isinstance(v, Mapping) else [v])))
            elif op == "$pullAll":
                put(name, patch.pull(*v))
            elif op == "$currentDate":
                put(name, patch.set_(now or datetime.now(UTC).replace(tzinfo=None)))
            elif op == "$setOnInsert":
                insert[name] = v
            else:
                raise Unsupported(f"update {op}")
    return out, insert


class Collection:
    def __init__(self, store: Any, name: str):
        self.store, self.name, self.model = store, name, store.models[name]

    def find(self, doc: Mapping[str, Any] | None = None, **options: Any) -> Query:
        return find(self.store.catalog, self.name, doc, policy=self.store.policy, **options)

    def find_one(self, doc: Mapping[str, Any] | None = None) -> Row | None:
        return self.find(doc).first()

    def count_documents(self, doc: Mapping[str, Any] | None = None) -> int:
        return self.find(doc).count()

    def aggregate(self, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
        return pipeline(self.store.catalog, self.name, stages, self.store.policy)

    def insert_many(self, docs: Sequence[Mapping[str, Any]]) -> list[str]:
        rows = [self.model.instance(d) for d in docs]
        self.store.save(self.name, rows)
        return [r[self.model.key] for r in rows]

    def insert_one(self, doc: Mapping[str, Any]) -> str:
        return self.insert_many([doc])[0]

    def _first(self, doc: Mapping[str, Any]) -> Row | None:
        return self.find(doc).sort(self.model.key).first()

    def _key(self, row: Row) -> N.Predicate:
        return N.Compare(self.model.key, "=", row[self.model.key])

    def update_one(self, doc: Mapping[str, Any], update: Mapping[str, Any], upsert: bool = False) -> int:
        ops, insert = parse_update(update)
        row = self._first(doc)
        if row is not None:
            return self.store.patch_where(self.name, self._key(row), ops)
        if upsert:
            self.store.upsert(self.name, docfilter.parse(doc), ops, insert)
        return 0

    def update_many(self, doc: Mapping[str, Any], update: Mapping[str, Any], upsert: bool = False) -> int:
        ops, insert = parse_update(update)
        n = self.store.patch_where(self.name, docfilter.parse(doc), ops)
        if not n and upsert:
            self.store.upsert(self.name, docfilter.parse(doc), ops, insert)
        return n

    def find_one_and_update(self, doc: Mapping[str, Any], update: Mapping[str, Any], after: bool = True, upsert: bool = False) -> Row | None:
        """The row after the update, or before it; an upsert that inserts has nothing before it."""
        ops, insert = parse_update(update)
        row = self._first(doc)
        if row is not None:
            changed = self.store.patch(self.name, row[self.model.key], ops)
            return changed if after else row
        if not upsert:
            return None
        key = {} if self.model.key in patch.seed(docfilter.parse(doc), ops, insert) else {self.model.key: new_uuid()}
        made = patch.seed(docfilter.parse(doc), ops, insert) | key
        self.store.save(self.name, [made])
        return self.store.query(self.name).get(made[self.model.key]) if after else None

    def replace_one(self, doc: Mapping[str, Any], new: Mapping[str, Any]) -> int:
        row = self._first(doc)
        if row is None:
            return 0
        self.store.save(self.name, [dict(new) | {self.model.key: row[self.model.key]}])
        return 1

    def delete_one(self, doc: Mapping[str, Any]) -> int:
        row = self._first(doc)
        if row is None:
            return 0
        self.store.remove(self.name, self._key(row))
        return 1

    def delete_many(self, doc: Mapping[str, Any]) -> int:
        n = self.count_documents(doc)
        self.store.remove(self.name, docfilter.parse(doc))
        return n
