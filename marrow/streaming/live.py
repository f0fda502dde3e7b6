"""Change feeds and live queries on Structured Streaming, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import nodes as N
from marrow.operators.query import Query, _paths, _relation
from marrow.sources.store import CHANGES, Store, matching


def change_stream(store: Store, name: str | None = None, where: N.Predicate | None = None, visible: N.Predicate | None = None) -> DataFrame:
    """The store's change log as a stream.  ``visible`` is a read policy: saved rows that it hides are left out, and
    so is every removal, since its row can't be judged."""
    stream = store.spark.readStream.schema(CHANGES).parquet(f"{store.path}/_changes/*")
    if name is not None:
        stream = stream.filter(F.col("model") == name)
        if where is not None:
            stream = matching(stream, store.models[name], where)
        if visible is not None:
            from marrow.plans import compiler

            struct = store.models[name].struct()
            row = F.from_json("after", struct)
            ok = compiler.predicate(visible, compiler.Scope(struct, lambda n: row.getField(n)))
            stream = stream.filter((F.col("kind") == "saved") & F.coalesce(ok, F.lit(False)))
    return stream


class LiveQuery:
    """Runs a query again when rows change that matched its filter or match it now.  It starts with its first
    subscriber and stops with its last; the last result stays readable meanwhile."""

    def __init__(self, store: Store, query: Query, run: Callable[[Query], Any] | None = None, checkpoint: str | None = None):
        self.store, self.query, self.run, self.checkpoint = store, query, run or (lambda q: q.list()), checkpoint
        self.value: Any = None
        self.error: Exception | None = None
        self._subscribers: list[tuple[Callable, Callable | None]] = []
        self._stream: Any = None
        self._turn = 0

    def refetch(self) -> Any:
        self._turn += 1
        turn = self._turn
        try:
            value = self.run(self.query)
        except Exception as e:  # noqa: BLE001
            self.error = e
            for _, failed in self._subscribers:
                if failed:
                    failed(e)
            return self.value
        if turn == self._turn:  # a later run has not overtaken this one
            self.value, self.error = value, None
            for listener, _ in list(self._subscribers):
                listener(value)
        return self.value

    def subscribe(self, listener: Callable[[Any], None], failed: Callable[[Exception], None] | None = None) -> Callable[[], None]:
        self._subscribers.append((listener, failed))
        if len(self._subscribers) == 1:
            self.store.publish()
            seen = self.store.manifest()["seq"]  # before the first run, so no commit falls between them
            self.refetch()
            self._start(seen)
        else:
            listener(self.value)
        entry = self._subscribers[-1]

        def stop() -> None:
            if entry in self._subscribers:
                self._subscribers.remove(entry)
            if not self._subscribers and self._stream is not None:
                self._stream.stop()
                self._stream = None

        return stop

    def _start(self, seen: int) -> None:
        targets = self._targets()
        if targets:  # a related row may change the result: any change of either model counts
            stream = change_stream(self.store).filter(F.col("model").isin([self.query.model.name, *targets]))
        else:
            stream = change_stream(self.store, self.query.model.name, self.query.where_)
        stream = stream.filter(F.col("seq") > seen)

        def on_batch(batch: DataFrame, _: int) -> None:
            if batch.limit(1).count():
                self.refetch()

        writer = stream.writeStream.foreachBatch(on_batch).trigger(processingTime="1 second")
        self._stream = (writer.option("checkpointLocation", self.checkpoint) if self.checkpoint else writer).start()

    def _targets(self) -> list[str]:
        """Models that the filter reaches by a relation, one hop away."""
        found = (_relation(self.query.model, path) for path in _paths(self.query.where_))
        return sorted({p.target for _, p, _ in filter(None, found)})

    def drain(self) -> None:
        """Waits for what is in the log; for tests."""
        if self._stream is not None:
            self._stream.processAllAvailable()


def tumbling(df: DataFrame, time: str, width: str, *keys: str, late: str | None = None, **aggs: Any) -> DataFrame:
    """Aggregates by event-time windows; with late, a watermark drops what comes later than that."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no timestamps without a zone
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, width), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sessions(df: DataFrame, time: str, gap: str, *keys: str, late: str | None = None, **aggs: Any) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)
