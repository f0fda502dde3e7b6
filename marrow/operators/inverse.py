"""Keeps both sides of a relation in step when rows are saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.schema import Model


def inverse_updates(models: dict[str, Model], tables: dict[str, DataFrame], model: Model, before: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The target tables with their inverse properties as ``rows`` (saved over ``before``) imply.

    A to-many inverse gains the owners that now refer to a target and loses those that no longer do, keeping its
    order; a to-one inverse takes the smallest new owner, or null if its owner is gone.  Both are joins on the target's
    key; a target's owners among the saved rows are gathered, which a list property of the target must hold anyway."""
    out: dict[str, DataFrame] = {}
    for name, p in model.properties.items():
        if p.kind != "relation" or p.embed or not p.inverse:
            continue
        target = models[p.target]
        back = target.properties[p.inverse]

        def pairs(df: DataFrame, name: str = name, many: bool = p.many) -> DataFrame:
            ref = F.explode(name) if many else F.col(name)
            return df.select(F.col(model.key).alias("_owner"), ref.alias("_target")).filter(F.col("_target").isNotNull()).distinct()

        old = pairs(before.join(rows.select(model.key), model.key, "left_semi"))
        new = pairs(rows)
        gather = lambda df, c: df.groupBy("_target").agg(F.array_sort(F.collect_set("_owner")).alias(c))
        added, lost = gather(new.subtract(old), "_added"), gather(old.subtract(new), "_lost")
        base = out.get(target.name, tables[target.name])
        joined = base.join(added.withColumnRenamed("_target", "_t1"), base[target.key] == F.col("_t1"), "left").join(lost.withColumnRenamed("_target", "_t2"), base[target.key] == F.col("_t2"), "left")
        if back.many:
            empty = F.array().cast(base.schema[p.inverse].dataType)
            kept = F.filter(F.coalesce(F.col(p.inverse), empty), lambda x: ~F.coalesce(F.array_contains("_lost", x), F.lit(False)))
            value = F.concat(kept, F.filter(F.coalesce("_added", empty), lambda x: ~F.array_contains(kept, x)))
            value = F.when(F.col("_added").isNull() & F.col("_lost").isNull(), F.col(p.inverse)).otherwise(value)
        else:
            gone = F.coalesce(F.array_contains("_lost", F.col(p.inverse)), F.lit(False))
            value = F.coalesce(F.get("_added", F.lit(0)), F.when(~gone, F.col(p.inverse)))
        out[target.name] = joined.select(*[value.alias(c) if c == p.inverse else base[c] for c in base.columns])
    return out
