"""The bounded sample of labelled rows that the classifiers learn from, and their scoring frame."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marrow.llm.common import saved

#: A classifier learns from so many rows at most, and only from texts of so many characters at most: together
#: these bound what the driver receives, whatever the input.  Scoring knows no such bound.
MAX_ROWS, MAX_CHARS = 6000, 20_000


def remainder(id_col: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(by))


def bounded(ids: DataFrame, max_rows: int) -> DataFrame:
    """The rows of ids (a column id) with the smallest hashes, max_rows at most; hardly more than these leave the tasks."""
    n = ids.count()
    if n > max_rows:
        ids = ids.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * max_rows / n + 50 / n)))
    return ids.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(max_rows)


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of the allowed rows with the smallest id hashes: a fixed pseudo-random choice among those that
    have a label and a text of max_chars at most.

    Where labels repeat an id, its largest label counts, and of rows that repeat one the smallest text; rows with a
    null id, label or text teach nothing."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull())
    known = known.withColumnRenamed("id", id_col).filter(allowed).withColumnRenamed(id_col, "id").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    picked = bounded(saved(known.join(texts.select("id"), "id", "left_semi"), "labelled"), max_rows)  # at most max_rows small rows
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["id"], r["text"], r["y"]) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows]


def score_of(model, spark: SparkSession, text: Column) -> Column:
    """The model's score of a text column, for plans that carry whole rows along."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts]))

    return score(text)


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """id and score of every row; model.score(texts) gives numbers from 0 to 1.  The model is of a bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    like, kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from marrow.llm.piece_table import blocks

        for keys, texts in blocks(batches, limit=batch_chars):
            yield pa.RecordBatch.from_arrays([pa.array(keys, like), pa.array(shared.value.score(texts), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
