"""Readers, writers and copies between stores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions import nodes as N
from marrow.operators import patch
from marrow.operators.query import Query
from marrow.plans import compiler
from marrow.plans.compiler import Scope
from marrow.schema import Model, new_uuid
from marrow.sources.store import Store


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, model: Model, id_field: str | None = None) -> DataFrame:
    """Exported documents under the model's schema; id_field is renamed to the key, and its {"$oid": …} form read."""
    struct = model.struct()
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("d"))
    cols = [_reference("d", compiler.variant_path([id_field or model.key])).alias(model.key)]
    for f in struct:
        if f.name == model.key:
            continue
        at, p = compiler.variant_path([f.name]), model.properties.get(f.name)
        plain = F.try_variant_get("d", at, f.dataType.simpleString())
        if p is not None and p.kind == "relation" and not p.embed:  # references have the same form as keys
            plain = F.transform(F.try_variant_get("d", at, "array<variant>"), lambda x: _reference(x, "$")) if p.many else _reference("d", at)
        cols.append(plain.alias(f.name))
    return raw.select(*cols)


def _reference(doc: str | Column, at: str) -> Column:
    """A key as text or in its {"$oid": …} form."""
    return F.coalesce(F.try_variant_get(doc, f"{at}['$oid']", "string"), F.try_variant_get(doc, at, "string"))


def jdbc(spark: SparkSession, url: str, table: str, **options: Any) -> DataFrame:
    """A table of a relational database; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 500, **properties: str) -> None:
    df.write.jdbc(url, table, mode, {"batchsize": str(batch)} | properties)


def copied(rows: DataFrame, where: N.Predicate | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    if where is not None:
        rows = rows.filter(compiler.predicate(where, Scope(rows.schema)))
    return transform(rows) if transform is not None else rows


def copy(source: Store, target: Store, models: Sequence[str] | None = None, where: N.Predicate | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, batch: int | None = None, on_batch: Callable[[str, int], None] | None = None) -> dict[str, int]:
    """Upserts the models' rows into another store; returns the number of each.

    The rows are computed once, to a folder of the target, and saved from there: in one commit, or in commits of
    ``batch`` rows in the order of the key.  on_batch(model, rows so far) is called after each commit."""
    done = {}
    for name in models or source.models:
        side, key = f"{target.path}/_staged/copy-{new_uuid()}", source.models[name].key
        copied(source.table(name), where, transform).write.parquet(side)
        rows = source.spark.read.parquet(side)
        done[name], last = 0, None
        while True:
            part = rows if last is None else rows.filter(F.col(key) > F.lit(last))
            part = part if batch is None else part.orderBy(key).limit(batch)
            n, last = part.agg(F.count("*"), F.max(key)).first()
            if n:
                target.save(name, part)
                done[name] += n
                if on_batch is not None:
                    on_batch(name, done[name])
            if batch is None or n < batch:
                break
        target.files.delete(side)
    return done


def write_all(df: DataFrame, sinks: Sequence[Callable[[DataFrame], None]], strict: bool = True) -> list[Exception | None]:
    """The same rows, computed once, to several sinks: the first must succeed, others too if strict."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return _each([lambda sink=sink: sink(kept) for sink in sinks], strict)
    finally:
        kept.unpersist()


def _each(steps: Sequence[Callable[[], Any]], strict: bool) -> list[Exception | None]:
    out: list[Exception | None] = []
    for k, step in enumerate(steps):
        try:
            step()
            out.append(None)
        except Exception as e:  # noqa: BLE001
            if strict or k == 0:
                raise
            out.append(e)
    return out


class FanOut:
    """Writes to several stores: the first is the one that is read and must succeed, others too if strict.
    ``errors`` has what the last write ended with in each."""

    def __init__(self, stores: Sequence[Store], strict: bool = True):
        self.stores, self.strict, self.errors = list(stores), strict, []

    def _all(self, method: str, *args: Any, **options: Any) -> Any:
        out: list[Any] = []
        self.errors = _each([lambda s=s: out.append(getattr(s, method)(*args, **options)) for s in self.stores], self.strict)
        return out[0]

    def save(self, name: str, rows: DataFrame | Sequence[dict[str, Any]]) -> None:
        if not isinstance(rows, DataFrame):  # every store gets the same new keys
            model = self.stores[0].models[name]
            rows = model.frame(self.stores[0].spark, rows)
        self.errors = write_all(rows, [lambda df, s=s: s.save(name, df) for s in self.stores], self.strict)

    def patch_where(self, name: str, where: N.Predicate, spec: Mapping[str, Any]) -> int:
        return self._all("patch_where", name, where, spec)

    def upsert(self, name: str, match: N.Predicate, update: Mapping[str, Any], on_insert: Mapping[str, Any] | None = None) -> None:
        model = self.stores[0].models[name]
        fresh = {} if model.key in patch.seed(match, update, on_insert) else {model.key: new_uuid()}
        self._all("upsert", name, match, update, dict(on_insert or {}) | fresh)

    def remove(self, name: str, where: N.Predicate, hard: bool = False) -> None:
        self._all("remove", name, where, hard)

    def query(self, name: str) -> Query:
        return self.stores[0].query(name)
