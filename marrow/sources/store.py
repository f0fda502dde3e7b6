"""A store of models as versioned Parquet tables.

A commit writes new versions of the tables that it touches and its changes (with the rows before and after), each
where nobody reads, and then a manifest, numbered one more than the last, that names the current version of every
model and of the changes.  The manifest is moved into place by a rename that fails if another writer's has that number:
readers see all of a commit or nothing, and of two writers the second gets a Conflict and can try again.  After that the
changes move into the change log, which Structured Streaming can follow; if the writer dies in between, whoever
reads or writes next moves them.  Unique keys are checked on the merged tables before the manifest moves.

A policy names the rows of a model that are seen: queries, collections, patches, removals and upserts act on these
alone, and a save that would replace a hidden row is denied.  ``table`` and ``changes`` are not subject to it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from datetime import UTC, datetime
from functools import reduce, wraps
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marrow.functions import nodes as N
from marrow.operators import patch
from marrow.operators.inverse import inverse_updates
from marrow.operators.query import Catalog, Query
from marrow.plans import compiler
from marrow.plans.compiler import Scope
from marrow.schema import Model, fingerprint, new_uuid


class UniqueViolation(ValueError):
    pass


class WriteDenied(PermissionError):
    pass


class Conflict(RuntimeError):
    """Another writer has committed since this commit began."""


CHANGES = "seq long, model string, key string, kind string, before string, after string"


class Files:
    """Small files and renames in whatever file system Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing if it isn't there."""
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def move(self, source: str, target: str) -> bool:
        """Renames unless the target is there or the source isn't."""
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.jvm.org.apache.hadoop.fs.Path(source), p, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise
        return True

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Tables:
    """Where a store keeps its tables: each version is written once, read often, and never changed.  A class with these
    three methods, over whatever Spark reads and writes, can take its place."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        self.spark, self.path, self.kind, self.files = spark, path, kind, Files(spark)

    def write(self, name: str, version: str, df: DataFrame) -> None:
        df.write.format(self.kind).save(f"{self.path}/{name}/{version}")

    def read(self, name: str, version: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read.format(self.kind)
        return (reader if schema is None else reader.schema(schema)).load(f"{self.path}/{name}/{version}")

    def drop(self, name: str, version: str) -> None:
        self.files.delete(f"{self.path}/{name}/{version}")


def _writes(method: Callable) -> Callable:
    """What a method commits rests on the version that was there when it began."""

    @wraps(method)
    def run(self: Store, *args: Any, **options: Any) -> Any:
        outer = self._basis
        if outer is None:
            self._basis = self.manifest()["version"]
        try:
            return method(self, *args, **options)
        finally:
            self._basis = outer

    return run


class Store:
    def __init__(self, spark: SparkSession, path: str, models: Iterable[Model], policy: Callable[[Model], N.Predicate | None] | None = None, can_write: Callable[[Model, DataFrame], bool] | None = None, hooks: Mapping[str, Callable] | None = None, observe: Callable[[dict], None] | None = None, tables: Tables | None = None):
        self.spark, self.path, self.policy, self.can_write, self.hooks, self.observe = spark, path.rstrip("/"), policy, can_write, dict(hooks or {}), observe
        self.models = {m.name: m for m in models}
        self.files, self.catalog = Files(spark), Catalog()
        self.tables = tables or Tables(spark, self.path)
        self._staged: dict[str, DataFrame | None] | None = None
        self._basis: int | None = None
        for m in self.models.values():
            self.catalog.add(m, lambda m=m: self.table(m.name))
        self._listeners: list[Callable[[str, DataFrame], None]] = []
        self._cache: dict[str, DataFrame] = {}

    # reading
    def manifest(self) -> dict[str, Any]:
        """The latest: its version, the number of its last change, the tables' versions and that of its changes."""
        names = self.files.names(f"{self.path}/_manifests")
        return json.loads(self.files.read(f"{self.path}/_manifests/{names[-1]}")) if names else {"version": 0, "seq": 0, "tables": {}, "log": None}

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """The model's rows: staged ones inside of a transaction, else the committed version.  Columns that a model
        has gained since are null."""
        model = self.models[name]
        if self._staged is not None and name in self._staged:
            return self._staged[name] if self._staged[name] is not None else self.spark.createDataFrame([], model.struct())
        at = version or self.manifest()["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], model.struct())
        df = self.tables.read(name, at)
        return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in model.struct()], *[c for c in df.columns if c not in model.struct().names])

    def query(self, name: str) -> Query:
        return self.catalog.query(name, self.policy)

    def cached(self, query: Query) -> DataFrame:
        """The query's rows, kept until the next commit of any model; equal queries share them."""
        key = query.digest()
        if key not in self._cache:
            self._cache[key] = query.frame().persist()
        return self._cache[key]

    def _forget(self) -> None:
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()

    def sql(self, text: str, **args: Any) -> DataFrame:
        """Raw SQL over the models' rows as views; with a policy, over those that it shows."""
        for name in self.models:
            (self.table(name) if self.policy is None else self.query(name).include_deleted().rows()).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    def fingerprint(self) -> str:
        return fingerprint(self.models.values())

    # writing
    def _changed(self, name: str, after: DataFrame | None) -> None:
        """A model's new rows; None drops its table."""
        if self._staged is not None:
            self._staged[name] = after
        else:
            self._commit({name: after})

    def _hook(self, name: str, *args: Any) -> Any:
        return self.hooks[name](*args) if name in self.hooks else None

    def _commit(self, tables: Mapping[str, DataFrame | None]) -> None:
        began = datetime.now(UTC)
        self.publish()
        state = self.manifest()
        if self._basis not in (None, state["version"]):
            raise Conflict(f"version {state['version']} has come since")
        number = state["version"] + 1
        version = f"v{number:012d}-{new_uuid()[:8]}"
        before = {n: self._committed(n) for n in tables}
        made, logs, written = [f"{self.path}/_staged/{version}", f"{self.path}/_log/{version}"], [], []
        try:
            for name, df in tables.items():
                model = self.models[name]
                if df is not None:
                    if "before_commit" in self.hooks:
                        df = self._hook("before_commit", model, df)
                    written.append(name)
                    self.tables.write(name, version, df)
                    df = self.tables.read(name, version, df.schema)
                    shared = patch.violations(df, model).limit(1).collect()
                    if shared:
                        raise UniqueViolation(f"{name}: {shared[0]['columns']} = {shared[0]['key']}")
                log = change_rows(model, before[name], before[name].limit(0) if df is None else df)
                if self.can_write is not None and not self.can_write(model, log.filter("kind = 'saved'").select("after")):
                    raise WriteDenied(name)
                logs.append(log.select("model", "key", "kind", F.to_json("before").alias("before"), F.to_json("after").alias("after")))
            seq = self._log_changes(logs, state["seq"], f"{self.path}/_staged/{version}", f"{self.path}/_log/{version}")
            now = {n: v for n, v in state["tables"].items() if n not in tables} | {n: version for n, df in tables.items() if df is not None}
            self.files.write(f"{self.path}/_staged/{version}.json", json.dumps({"version": number, "seq": seq, "tables": now, "log": version}))
            if not self.files.move(f"{self.path}/_staged/{version}.json", f"{self.path}/_manifests/{number:012d}.json"):
                raise Conflict(f"version {number} is another writer's")
        except Exception:
            for path in [*made, f"{self.path}/_staged/{version}.json"]:
                self.files.delete(path)
            for name in written:
                self.tables.drop(name, version)
            raise
        if self._basis is not None:
            self._basis = number
        self.files.delete(made[0])
        self.publish()
        self._forget()
        for name in tables:
            for listener in self._listeners:
                listener(name, self.changes(state["seq"]).filter(F.col("model") == name))
        self._hook("after_commit", list(tables))
        if self.observe is not None:
            self.observe({"op": "commit", "models": list(tables), "seconds": (datetime.now(UTC) - began).total_seconds(), "changes": seq - state["seq"]})

    def publish(self) -> None:
        """Moves the last commit's changes into the change log if its writer hasn't."""
        log = self.manifest()["log"]
        if log is not None:
            self.files.move(f"{self.path}/_log/{log}", f"{self.path}/_changes/{log}")

    def _log_changes(self, logs: list[DataFrame], seq: int, staging: str, target: str) -> int:
        """Numbers the changes by model and key, each task its own range from where the ranges before it end, and returns the last number."""
        log = reduce(DataFrame.unionByName, logs)
        at = F.monotonically_increasing_id()
        ranged = log.repartitionByRange("model", "key").sortWithinPartitions("model", "key")
        ranged.withColumns({"part": F.shiftright(at, 33), "n": at.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(staging)
        staged = self.spark.read.parquet(staging)
        starts = [(-1, seq)]
        for r in staged.groupBy("part").count().orderBy("part").collect():  # one row for each task
            starts.append((r["part"], seq))
            seq += r["count"]
        start = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("part")]
        staged.select((start + F.col("n") + 1).cast("long").alias("seq"), "model", "key", "kind", "before", "after").write.parquet(target)
        return seq

    def _committed(self, name: str) -> DataFrame:
        staged, self._staged = self._staged, None
        try:
            return self.table(name)
        finally:
            self._staged = staged

    def visible(self, name: str, where: N.Predicate) -> N.Predicate:
        """The predicate with what the policy shows."""
        shown = self.policy(self.models[name]) if self.policy is not None else None
        return where if shown is None else N.And((where, shown))

    @_writes
    def save(self, name: str, rows: Iterable[Mapping[str, Any]] | DataFrame) -> None:
        """Upserts by key; of rows with one key the last counts."""
        model = self.models[name]
        if not isinstance(rows, DataFrame):
            by_key = {r[model.key]: r for r in map(model.instance, rows)}
            rows = self.spark.createDataFrame([tuple(r[f.name] for f in model.struct()) for r in by_key.values()], model.struct())
        if "before_save" in self.hooks:
            rows = self._hook("before_save", model, rows)
        base = self.table(name)
        if self.policy is not None:
            hidden = base.filter(compiler.predicate(N.Not(self.visible(name, N.All())), Scope(base.schema)))
            if hidden.join(rows.select(model.key), model.key, "left_semi").limit(1).count():
                raise WriteDenied(f"{name}: a hidden row has this key")
        changed = {name: patch.merged(base, rows, model.key)}
        tables = {n: changed.get(n, self.table(n)) for n in {p.target for p in model.properties.values() if p.inverse and not p.embed}}
        changed |= inverse_updates(self.models, tables, model, base, rows)
        if self._staged is not None:
            self._staged |= changed
        else:
            self._commit(changed)
        self._hook("after_save", model, rows)

    @_writes
    def remove(self, name: str, where: N.Predicate, hard: bool = False) -> None:
        model, base = self.models[name], self.table(name)
        if "before_remove" in self.hooks:
            where = self._hook("before_remove", model, where)
        where = self.visible(name, where)
        if model.soft_delete and not hard:
            where = N.And((where, N.IsNull(model.soft_delete)))
            self._changed(name, patch.patched(base, model, where, {model.soft_delete: datetime.now(UTC).replace(tzinfo=None)}))
        else:
            self._changed(name, base.filter(compiler.predicate(where, Scope(base.schema), False)))
        self._hook("after_remove", model, where)

    @_writes
    def restore(self, name: str, where: N.Predicate) -> None:
        model = self.models[name]
        self._changed(name, patch.patched(self.table(name), model, self.visible(name, where), {model.soft_delete: patch.unset()}))

    @_writes
    def patch_where(self, name: str, where: N.Predicate, spec: Mapping[str, Any]) -> int:
        """Updates all matching rows; returns how many matched before."""
        model, base = self.models[name], self.table(name)
        live = self.visible(name, where if not model.soft_delete else N.And((where, N.IsNull(model.soft_delete))))
        n = base.filter(compiler.predicate(live, Scope(base.schema))).count()
        if n:
            self._changed(name, patch.patched(base, model, live, spec))
        return n

    def patch(self, name: str, key: Any, spec: Mapping[str, Any]) -> Row | None:
        self.patch_where(name, N.Compare(self.models[name].key, "=", key), spec)
        return self.query(name).get(key)

    @_writes
    def upsert(self, name: str, match: N.Predicate, update: Mapping[str, Any], on_insert: Mapping[str, Any] | None = None) -> None:
        """Updates the rows that match and are seen, or inserts one; an insert over a hidden row's key is denied."""
        model, base = self.models[name], self.table(name)
        seen = self.visible(name, match if not model.soft_delete else N.And((match, N.IsNull(model.soft_delete))))
        if base.filter(compiler.predicate(seen, Scope(base.schema))).limit(1).count():
            self._changed(name, patch.patched(base, model, seen, update))
        else:
            self.save(name, [patch.seed(match, update, on_insert)])

    def transaction(self) -> Transaction:
        return Transaction(self)

    # changes
    def changes(self, after: int = 0) -> DataFrame:
        """The change log beyond a sequence number, in order."""
        if self.manifest()["seq"] == 0:
            return self.spark.createDataFrame([], CHANGES)
        self.publish()
        return self.spark.read.schema(CHANGES).parquet(f"{self.path}/_changes/*").filter(F.col("seq") > after).orderBy("seq")

    def subscribe(self, listener: Callable[[str, DataFrame], None], name: str | None = None, where: N.Predicate | None = None) -> Callable[[], None]:
        """Calls listener(model, changes) after commits whose rows match before or after."""

        def call(model: str, changes: DataFrame) -> None:
            if name is not None and model != name:
                return
            if where is not None:
                changes = matching(changes, self.models[model], where)
            if changes.limit(1).count():
                listener(model, changes)

        self._listeners.append(call)
        return lambda: self._listeners.remove(call)

    @_writes
    def vacuum(self) -> None:
        """Drops expired rows of models with a time-to-live."""
        for m in self.models.values():
            for i in m.indexes:
                if i.ttl_seconds is not None:
                    base = self.table(m.name)
                    fresh = F.col(i.columns[0]).isNull() | (F.col(i.columns[0]) > F.current_timestamp() - F.make_interval(secs=F.lit(i.ttl_seconds)))
                    self._changed(m.name, base.filter(fresh))


def change_rows(model: Model, before: DataFrame, after: DataFrame) -> DataFrame:
    """(model, key as text, kind, before, after) of the rows that differ between two versions of a table."""
    columns = model.struct().names
    b = before.select(F.col(model.key).alias("_b"), F.struct(*[c for c in columns if c in before.columns]).alias("before"))
    a = after.select(F.col(model.key).alias("_a"), F.struct(*[c for c in columns if c in after.columns]).alias("after"))
    both = b.join(a, b["_b"] == a["_a"], "full_outer").filter(~F.to_json("before").eqNullSafe(F.to_json("after")))
    kind = F.when(F.col("_a").isNull(), "removed").otherwise("saved")
    return both.select(F.lit(model.name).alias("model"), F.coalesce("_a", "_b").cast("string").alias("key"), kind.alias("kind"), "before", "after")


def matching(changes: DataFrame, model: Model, where: N.Predicate) -> DataFrame:
    """The changes whose row matched before or matches after; works on a stream as well."""
    struct = model.struct()
    rows = changes.withColumns({"_b": F.from_json("before", struct), "_a": F.from_json("after", struct)})
    side = lambda c: F.coalesce(F.col(c).isNotNull() & compiler.predicate(where, Scope(struct, lambda n: F.col(c).getField(n))), F.lit(False))
    return rows.filter(side("_b") | side("_a")).drop("_b", "_a")


class Transaction:
    """Reads its own writes; commits all models with one manifest, or none if the block raises."""

    def __init__(self, store: Store):
        self.store, self.open = store, False

    def __enter__(self) -> Store:
        if self.store._staged is not None or self.open:
            raise RuntimeError("a transaction is open")
        self.store._staged, self.open = {}, True
        self.store._basis = self.store.manifest()["version"]
        return self.store

    def __exit__(self, kind: Any, *_: Any) -> None:
        staged, self.store._staged, self.open = self.store._staged, None, False
        try:
            if kind is None and staged:
                self.store._commit(staged)
        finally:
            self.store._basis = None
