"""Line dedup: lines that many documents share stay only in the smallest document that holds them.

DataFrame functions only.  Lines are exploded and hashed to 128 bits; the hash is the only thing that is
shuffled to count documents, and partial aggregation leaves one row for each hash and task.  Repeated hashes
are saved, then looked up from every line: those of very many lines by broadcast, the others by a shuffled join in
which no key is hot (``groups.look_up``).

Defined results: a null or empty text is one empty line.  A null doc_id is no document: its lines are neither
counted nor dropped.  Rows that repeat a doc_id count as one document.  An empty table gives an empty result.
Columns of the input other than the id and the text are carried along by ``rewrite`` and ignored elsewhere,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import ascii_lower, saved
from marrow.llm.groups import look_up

STRIPPED = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, th, drops): for each document, the positions of the lines to drop."""
    lines = _rows(docs, id_col, text_col).filter(F.col("id").isNotNull())
    lines = lines.select("id", "th", F.posexplode("lines").alias("pos", "line")).select("id", "th", "pos", _key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    lines = lines.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if min_docs <= 2:
        counted = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        counted = counted.filter(F.col("first") < F.col("last") if min_docs == 2 else F.lit(True))
    else:
        counted = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("k")).groupBy("h1", "h2")
        counted = counted.agg(F.min("id").alias("first"), F.count("*").alias("docs"), F.sum("k").alias("n")).filter(F.col("docs") >= min_docs)
    repeated = saved(counted.select("h1", "h2", "first", "n"), "lines")
    found = look_up(lines, repeated, ["h1", "h2"], "first", "n").filter(F.col("first") != F.col("id"))
    return found.groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """Positions are set operations on integers, so a document of many lines takes time in proportion to them."""
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    return F.when(drops.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row for each row of docs: the id, n_lines, n_dropped and the text that is kept."""
    drops = _dropped(docs, id_col, text_col, min_chars, min_docs)
    out = _rows(docs, id_col, text_col).join(drops, ["id", "th"], "left")
    return out.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept(F.col("lines"), F.col("drops")).alias("kept"),
    )


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the dropped lines gone from the text; all other columns stay as they are."""
    drops = _dropped(docs, id_col, text_col, min_chars, min_docs)
    drops = drops.select(F.col("id").alias("__marrow_id"), F.col("th").alias("__marrow_th"), F.col("drops").alias("__marrow_drops"))
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.join(drops, (docs[id_col] == drops["__marrow_id"]) & (F.xxhash64(text) == drops["__marrow_th"]), "left")
    new = F.when(drops["__marrow_drops"].isNull(), docs[text_col]).otherwise(_kept(F.split(text, "\n", -1), drops["__marrow_drops"]))
    return out.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
