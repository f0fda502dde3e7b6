"""Ordered, tracked migrations of a store's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.schema import Model, text
from marrow.schema import date as date_property
from marrow.sources.store import Store

TRACKING = Model("_migrations", {"name": text(unique=True), "appliedAt": date_property()}, key="name")


class Schema:
    """What a migration may do; each step rewrites one table as a DataFrame."""

    def __init__(self, store: Store):
        self.store = store

    def _rewrite(self, table: str, step: Callable[[DataFrame], DataFrame]) -> None:
        at = None if table in (self.store._staged or {}) else self.store.manifest()["tables"].get(table)
        df = self.store.tables.read(table, at) if at else self.store.table(table)
        self.store._changed(table, step(df))

    def create_table(self, model: Model) -> None:
        self.store.models[model.name] = model
        self.store.catalog.add(model, lambda: self.store.table(model.name))
        if model.name not in self.store.manifest()["tables"] and model.name not in (self.store._staged or {}):
            self.store._changed(model.name, self.store.spark.createDataFrame([], model.struct()))

    def drop_table(self, name: str) -> None:
        """The table goes, its removed rows are logged, and the model is forgotten with the commit."""
        self.store._changed(name, None)

    def add_column(self, table: str, name: str, type_: T.DataType, default: object = None) -> None:
        self._rewrite(table, lambda df: df.withColumn(name, F.lit(default).cast(type_)))

    def drop_column(self, table: str, name: str) -> None:
        self._rewrite(table, lambda df: df.drop(name))

    def rename_column(self, table: str, old: str, new: str) -> None:
        self._rewrite(table, lambda df: df.withColumnRenamed(old, new))

    def alter_column_type(self, table: str, name: str, type_: T.DataType) -> None:
        self._rewrite(table, lambda df: df.withColumn(name, F.col(name).try_cast(type_.simpleString())))

    def create_index(self, table: str, columns: Sequence[str]) -> None:
        """A declaration only: Parquet statistics and partitioning stand in for indexes."""

    def drop_index(self, table: str, columns: Sequence[str]) -> None:
        """As create_index."""

    def sql(self, table: str, query: str) -> None:
        self.store.sql("SELECT 1")
        self.store._changed(table, self.store.spark.sql(query))


@dataclass(frozen=True)
class Migration:
    name: str
    up: Callable[[Schema], None]
    down: Callable[[Schema], None] | None = None


def _applied(store: Store) -> list[str]:
    if TRACKING.name not in store.models:
        store.models[TRACKING.name] = TRACKING
        store.catalog.add(TRACKING, lambda: store.table(TRACKING.name))
    return [r["name"] for r in store.table(TRACKING.name).orderBy("appliedAt", "name").collect()]


def _checked(migrations: Sequence[Migration]) -> None:
    names = [m.name for m in migrations]
    if len(set(names)) < len(names):
        raise ValueError("two migrations have one name")


def migrate(store: Store, migrations: Sequence[Migration]) -> list[str]:
    """Runs those that haven't run yet, in order; returns their names."""
    _checked(migrations)
    done, ran = set(_applied(store)), []
    for m in migrations:
        if m.name not in done:
            with store.transaction():  # a migration and its tracking row are one commit
                m.up(Schema(store))
                store.save(TRACKING.name, [{"name": m.name, "appliedAt": datetime.now(UTC).replace(tzinfo=None)}])
            ran.append(m.name)
    return ran


def rollback(store: Store, migrations: Sequence[Migration], n: int = 1) -> list[str]:
    """Undoes the last n that ran, newest first."""
    from marrow.functions import nodes as N

    _checked(migrations)
    by_name, undone = {m.name: m for m in migrations}, []
    for name in reversed(_applied(store)[-n:] if n else []):
        m = by_name.get(name)
        if m is None or m.down is None:
            raise ValueError(f"{name} can't be undone")
        with store.transaction():
            m.down(Schema(store))
            store.remove(TRACKING.name, N.Compare("name", "=", name))
        undone.append(name)
    return undone
