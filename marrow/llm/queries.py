"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import decontam, language, line_dedup, near_dedup, piece_table, quality, style_tree, token_files, toxicity, vector_graph
from marrow.llm.common import shared_dir, table
from marrow.llm.training import remainder, scored


def _classified(spark: SparkSession, sf_dir: str, operator, by: int, held_out: int) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = operator.train(docs, labels, remainder("doc_id", by) != held_out)
    out = scored(docs, model)
    held = F.coalesce(remainder("doc_id", by) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, 3, 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, 5, 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/marrow-tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = style_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_graph.links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "audited_recall")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_of", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = piece_table.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_attention_quality, op2_toxicity, op3_token_files, op4_winnowing, op5_style_tree, op6_vector_graph, op7_language, op8_bagminhash, op9_sentencepiece, op10_line_dedup)}

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
seen AS (SELECT k, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(docs >= 2 AND first <> keyed.doc_id, false) AS dropped
  FROM keyed LEFT JOIN seen ON keyed.k = seen.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(words, p0, p0 + n - 1), ' ') AS w
  FROM (SELECT item_id, words, least(len(words), 8) AS n, unnest(range(1, len(words) - least(len(words), 8) + 2)) AS p0 FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p0, array_to_string(list_slice(words, p0, p0 + n - 1), ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p0 FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, item_id, p0, dw.n FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM (SELECT DISTINCT doc_id, p0, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE_SQL = {"op4_winnowing": OP4_SQL, "op10_line_dedup": OP10_SQL}
