"""Replication: hybrid logical clocks, last-write-wins folds of whole records and of fields, and replicas.

A change is a row (seq, model, key, kind, record, version, fields): record is JSON, version a clock's stamp, fields
JSON of a stamp for each field or null.  Versions compare as strings.  The folds are the definition; the stateful
stream gives the same result in whatever order changes come."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marrow.schema import Model, integer, json_, text
from marrow.sources.store import Conflict, Store

CHANGE = "seq long, model string, key string, kind string, record string, version string, fields string"
_STAMP = re.compile(r"^(\d{15}):(\d{6}):(.+)$")


class Clock:
    """Stamps of a fixed width that sort as strings: milliseconds, a counter, the node."""

    def __init__(self, node: str, now: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.node, self._now, self.ms, self.n = node, now, 0, 0

    def _stamp(self) -> str:
        return f"{self.ms:015d}:{self.n:06d}:{self.node}"

    def now(self) -> str:
        at = self._now()
        self.ms, self.n = (at, 0) if at > self.ms else (self.ms, self.n + 1)
        return self._stamp()

    def update(self, remote: str) -> None:
        """Moves on past a stamp from elsewhere; a malformed one is ignored."""
        m = _STAMP.match(remote or "")
        if not m:
            return
        known = max((self.ms, self.n), (int(m[1]), int(m[2])))
        at = self._now()
        self.ms, self.n = (at, 0) if at > known[0] else (known[0], known[1] + 1)


def lww(changes: DataFrame) -> DataFrame:
    """The winning change of each (model, key): the highest version, the first seq among equal ones."""
    order = F.struct("version", (-F.col("seq")).alias("first"))
    best = F.max_by(F.struct("seq", "kind", "record", "version", *(["fields"] if "fields" in changes.columns else [])), order)
    return changes.groupBy("model", "key").agg(best.alias("w")).select("model", "key", "w.*")


def live(folded: DataFrame) -> DataFrame:
    return folded.filter("kind = 'saved'")


def merge_fields(changes: DataFrame) -> DataFrame:
    """(model, key, record, versions): each field from the change with its highest version.  A record whose highest
    removal is beyond all of its changes is gone; one that was changed after its removals is whole again."""
    newest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("version")))
    alive = changes.groupBy("model", "key").agg(newest("removed").alias("gone"), newest("saved").alias("version")).filter("gone IS NULL OR version > gone").select("model", "key")
    rows = changes.filter("kind = 'saved'").select("model", "key", "seq", "version", F.from_json("record", "map<string,string>").alias("r"), F.from_json("fields", "map<string,string>").alias("f"))
    each = rows.select("model", "key", "seq", "version", "f", F.explode("r").alias("name", "value"))
    each = each.withColumn("v", F.coalesce(F.try_element_at("f", F.col("name")), "version"))
    won = each.groupBy("model", "key", "name").agg(F.max_by(F.struct("value", "v"), F.struct("v", (-F.col("seq")).alias("first"))).alias("w"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", f"w.{c}"))))
    merged = won.groupBy("model", "key").agg(entries("value").alias("record"), entries("v").alias("versions"))
    return merged.join(alive, ["model", "key"], "left_semi")


def pull(changes: DataFrame, cursor: int = 0) -> DataFrame:
    """Changes beyond the cursor in the order in which the target took them (not in the clocks' order)."""
    return changes.filter(F.col("seq") > cursor).orderBy("seq")


def lww_stream(changes: DataFrame) -> DataFrame:
    """As lww, over a stream: a row whenever a change wins."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = old = state.get if state.exists else None
        for df in batches:
            top = df[df["version"] == df["version"].max()]
            if len(top):
                first = top.loc[top["seq"].idxmin()]
                if best is None or (first["version"], -int(first["seq"])) > tuple(best[:2]):
                    best = (first["version"], -int(first["seq"]), first["kind"], first["record"])
        if best is not None and best != old:
            state.update(best)
            yield pd.DataFrame([{"model": key[0], "key": key[1], "seq": -best[1], "kind": best[2], "record": best[3], "version": best[0]}])

    return changes.groupBy("model", "key").applyInPandasWithState(step, "model string, key string, seq long, kind string, record string, version string", "version string, first long, kind string, record string", "update", GroupStateTimeout.NoTimeout)


class Target:
    """A server's log: takes changes in order, and hands them out by sequence number.  State is one table of winners
    and one log, both rebuilt from the log by ``lww``; fit for tests and small control data, while bulk replication
    uses the folds on tables."""

    def __init__(self, by_field: bool = False):
        self.by_field, self.log, self.best = by_field, [], {}

    def push(self, changes: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Takes those with a higher version than the current one (all, if fields are merged); returns the conflicts."""
        conflicts = []
        for c in changes:
            at = (c["model"], c["key"])
            if not self.by_field and at in self.best and not c["version"] > self.best[at]["version"]:
                conflicts.append(self.best[at])
                continue
            c = c | {"seq": len(self.log) + 1}
            self.log.append(c)
            if at not in self.best or c["version"] > self.best[at]["version"]:
                self.best[at] = c
        return conflicts

    def pull(self, cursor: int = 0) -> tuple[list[dict[str, Any]], int]:
        return self.log[cursor:], len(self.log)

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in CHANGE.split(", ")]
        return spark.createDataFrame([tuple(c.get(n) for n in names) for c in self.log], CHANGE)


LOG = Model("_sync_changes", {"seq": integer(), "model": text(), "key": text(), "kind": text(), "record": json_(), "version": text(), "fields": json_()})


class StoreTarget:
    """A ``Target`` whose log is a model of a store, so it is there after a restart.  The number of the last change
    comes from the log when the target starts and after another writer's commit; pushes are taken one at a time.
    What is collected is the current change of the keys pushed, never more."""

    def __init__(self, store: Store, by_field: bool = False):
        self.store, self.by_field, self._lock = store, by_field, threading.Lock()
        store.models[LOG.name] = LOG
        store.catalog.add(LOG, lambda: store.table(LOG.name))
        self._reseed()

    def _reseed(self) -> None:
        self.version = self.store.manifest()["version"]
        self.seq = self.store.table(LOG.name).agg(F.max("seq")).first()[0] or 0

    def push(self, changes: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Takes those with a higher version than the current one (all, if fields are merged); returns the conflicts."""
        with self._lock:
            for again in (True, False):
                try:
                    return self._push(changes)
                except Conflict:  # another hub has committed since
                    if not again:
                        raise
        return []

    def _push(self, changes: list[dict[str, Any]]) -> list[dict[str, Any]]:
        if not changes:
            return []
        if self.store.manifest()["version"] != self.version:
            self._reseed()
        log = self.store.table(LOG.name)
        keys = self.store.spark.createDataFrame(sorted({(c["model"], c["key"]) for c in changes}), "model string, key string")
        best = {(r["model"], r["key"]): _change(r) for r in lww(log.join(F.broadcast(keys), ["model", "key"], "left_semi")).collect()}
        taken, conflicts, seq = [], [], self.seq
        for c in changes:
            at = (c["model"], c["key"])
            if not self.by_field and at in best and not c["version"] > best[at]["version"]:
                conflicts.append(best[at])
                continue
            seq += 1
            taken.append({"uuid": str(seq), "seq": seq, "record": c["record"], "fields": c.get("fields") or None} | {k: c[k] for k in ("model", "key", "kind", "version")})
            if at not in best or c["version"] > best[at]["version"]:
                best[at] = c
        if taken:
            with self.store.transaction() as tx:
                if self.store._basis != self.version:
                    raise Conflict("another hub's changes have come")
                tx.save(LOG.name, taken)
            self.version += 1
        self.seq = seq
        return conflicts

    def pull(self, cursor: int = 0) -> tuple[list[dict[str, Any]], int]:
        """The changes beyond the cursor, which a replica holds anyway."""
        rows = pull(self.store.table(LOG.name), cursor).collect()
        return [_change(r) for r in rows], rows[-1]["seq"] if rows else cursor

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.store.table(LOG.name).select(*[c.split()[0] for c in CHANGE.split(", ")])


def _change(r: Any) -> dict[str, Any]:
    row = r.asDict()
    return {k: row[k] for k in ("seq", "model", "key", "kind", "version")} | {k: None if row.get(k) is None else json.loads(row[k]) for k in ("record", "fields")}


class Replica:
    """A local-first copy: writes go to an outbox, and ``sync`` pulls, merges and pushes.  Removals are tombstones
    with a version; a later write brings a record back."""

    def __init__(self, clock: Clock, target: Target):
        self.clock, self.target, self.cursor = clock, target, 0
        self.rows: dict[tuple[str, str], dict[str, Any]] = {}
        self.outbox: list[dict[str, Any]] = []

    def get(self, model: str, key: str) -> dict[str, Any] | None:
        row = self.rows.get((model, key))
        return row["record"] if row is not None and row["kind"] == "saved" else None

    def save(self, model: str, key: str, record: dict[str, Any]) -> None:
        old = self.rows.get((model, key))
        before = old["record"] if old and old["kind"] == "saved" else {}
        changed = [k for k in record if k not in before or before[k] != record[k]]
        if old and old["kind"] == "saved" and not changed:
            return  # a save that changes nothing bumps no version
        stamp = self.clock.now()
        fields = dict((old or {}).get("fields") or {}) | dict.fromkeys(changed, stamp)
        self._own({"model": model, "key": key, "kind": "saved", "record": before | record, "version": stamp, "fields": fields})

    def remove(self, model: str, key: str) -> None:
        self._own({"model": model, "key": key, "kind": "removed", "record": None, "version": self.clock.now(), "fields": None})

    def _own(self, change: dict[str, Any]) -> None:
        self.rows[change["model"], change["key"]] = change
        self.outbox.append(change)

    def sync(self) -> None:
        incoming, self.cursor = self.target.pull(self.cursor)
        for c in incoming:
            self._take(c)
        conflicts = self.target.push(self.outbox)
        self.outbox = []
        for c in conflicts:
            self._take(c)
        incoming, self.cursor = self.target.pull(self.cursor)
        for c in incoming:
            self._take(c)

    def _take(self, c: dict[str, Any]) -> None:
        self.clock.update(c["version"])
        at = (c["model"], c["key"])
        old = self.rows.get(at)
        if old is None:
            self.rows[at] = c
        elif self.target.by_field and old["kind"] == c["kind"] == "saved":
            a, b = old.get("fields") or {}, c.get("fields") or {}
            names = [*old["record"], *(k for k in c["record"] if k not in old["record"])]
            newer = {k: b.get(k, c["version"]) > a.get(k, "") if k in c["record"] else False for k in names}
            record = {k: (c if newer[k] else old)["record"][k] for k in names if k in (c if newer[k] else old)["record"]}
            self.rows[at] = old | {"record": record, "version": max(old["version"], c["version"]), "fields": {k: (b.get(k, c["version"]) if newer[k] else a.get(k, old["version"])) for k in record}}
        elif c["version"] > old["version"]:
            self.rows[at] = c
