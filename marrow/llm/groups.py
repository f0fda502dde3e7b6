"""Lookups that stand hot keys, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import saved

#: A key with more rows than this is looked up by broadcast, unless HOT_KEYS others have more still: so what is
#: broadcast is bounded (a few numbers for each), and a key that isn't has at most a HOT_KEYS-th of all rows, which
#: adaptive execution splits if that is much.
HOT_ROWS, HOT_KEYS = 20_000, 100_000
#: Id lists up to this length are broadcast to filter a wide table; longer ones are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Edges that one task may join (16 bytes each).
EDGES_IN_TASK = 1_000_000


def look_up(rows: DataFrame, entries: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """rows with ``value`` from the entry of their keys (null without one).  entries: one row for each key, with the number of rows that have it in ``count``."""
    hot = entries.filter(F.col(count) > HOT_ROWS).orderBy(F.desc(count)).limit(HOT_KEYS).select(*keys, F.col(value).alias("_hot"))
    cold = entries.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(value).alias("_cold"))
    found = rows.join(F.broadcast(hot), keys, "left")
    # rows of a hot key need no second look: a null in the key matches nothing, and the other part spreads them
    spread = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    found = found.withColumn("_spread", spread)
    found = found.join(cold.withColumn("_zero", F.lit(-1).cast("long")), [F.col(k) == F.col(f"_c_{k}") for k in keys] + [F.col("_spread") == F.col("_zero")], "left")
    return found.select(*rows.columns, F.coalesce("_hot", "_cold").alias(value))


def only_ids(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``wide`` whose key is among ids (a column of the same name)."""
    return wide.join(_bounded(ids), key, "left_semi")


def without_ids(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``wide`` whose key is not among ids; a null key stays."""
    return wide.join(_bounded(ids), key, "left_anti")


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the component is named by its smallest id.

    Up to EDGES_IN_TASK edges (counted; 16 bytes each) are joined by union-find in one task.  More take alternating
    large and small stars (Kiveris et al. 2014), each round saved; a round's smallest neighbours are aggregated with
    partial sums and looked up without gathering a node's neighbours in one task.  Both give the same components."""
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
    before = mark(now)
    if 0 < before[0] <= EDGES_IN_TASK:
        return now.coalesce(1).mapInArrow(_union_find, now.select(F.col("u").alias("id"), F.col("v").alias("component")).schema)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = look_up(both, least, ["u"], "m", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, ["u"], "m", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    nodes, place = np.unique(np.concatenate([rows.column(0).to_numpy(), rows.column(1).to_numpy()]), return_inverse=True)
    a, b = place[: rows.num_rows], place[rows.num_rows :]
    root = np.arange(len(nodes))
    while True:  # every root is hung below the smallest root that it meets, and paths are halved
        while not np.array_equal(up := root[root], root):
            root = up
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    kind = rows.schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], names=["id", "component"])
