"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators between words: ASCII characters that are neither digits nor (lower-cased) letters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: this cuts lineage, survives the loss of
    executors, and keeps later jobs from running the same work again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marrow-{name}-{uuid.uuid4().hex}"
    for tables in _open.get():
        tables.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The lists of paths that are being gathered, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("marrow_tables", default=())


@contextmanager
def gathered() -> Iterator[list[str]]:
    """The paths of the tables that are saved inside of the block: whoever has written all that was derived from them
    may ``delete`` them.  Tables that others have saved are not touched."""
    tables: list[str] = []
    token = _open.set((*_open.get(), tables))
    try:
        yield tables
    finally:
        _open.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Lower-cased words (runs of ASCII letters, digits and non-ASCII characters); null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), lambda w: w != "")


#: Rows that Spark sends to Python at a time, where the session has its default of 10,000: rows here hold whole texts.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, unless they find it by PYTHONPATH; makes Arrow batches fit for texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = Path(__file__).resolve().parents[2]
    if str(root) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(spark.sparkContext, "_marrow_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="marrow-")  # the driver's file server hands it out as long as the session lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/marrow", "zip", root, "marrow"))
    spark.sparkContext._marrow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
