"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.

For every stage: rows with a null id are judged by their own text where a text decides (toxicity, decontamination) and
kept where documents are compared (line dedup, near-dedup); null and empty texts are kept and have no ids but the end id;
rows that repeat an id and a text are treated alike; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import decontam, line_dedup, near_dedup, piece_table, toxicity
from marrow.llm.common import delete, gathered, saved, ship, table
from marrow.llm.groups import without_ids
from marrow.llm.training import remainder, score_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic (score of 0.5 or more) go.  It learns from the rows of the original
    table that op2 learns from.  A null text scores as an empty one."""
    ship(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return docs.filter(score_of(model, spark, docs["text"]) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that an earlier document holds go; n_chars counts what is left (null for a
    null text).  Rows with a null id neither lose lines nor take any from others."""
    ship(spark)
    out = line_dedup.rewrite(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, with all of its rows; so do rows with
    a null id.  Texts without words are copies if they are equal."""
    ship(spark)
    groups = near_dedup.classes(docs)
    return without_ids(docs, groups.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct(), "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of eight words, or a whole shorter item, with the benchmark go.  Rows are judged
    by their text, whatever their id."""
    ship(spark)
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row's ids with an end id, and digests of them and of what they decode to."""
    import public_tokenizers

    ship(spark)
    coded = piece_table.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL expresses neither a trained classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with gathered() as tables:
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, [*before, *tables[:-1]])
        before = tables[-1:]
    return docs
