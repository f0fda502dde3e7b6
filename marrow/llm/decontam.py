"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of WINDOW words that a document shares with a benchmark item has GRAM-word hashes in common with
it, and both sides keep the smallest of each window, so that a join of the kept hashes finds every shared
window of WINDOW words or more: none can be missed.  Hits are extended in place: in a text that shares a hash, the
windows around the places where it has that hash, and no others, are compared word by word with the items' windows.
Items shorter than a window are one window of their own length, which is looked up whole.

Equal texts are judged once, by 128 bits of hash.  What is joined with the documents is broadcast while it has at
most BROADCAST_ROWS rows (checked by counting) and shuffled beyond that; the result is the same.

Defined results: null and empty texts have no words, no hits and no items; null item texts and null item ids hit
nothing.  An empty benchmark leaves every document clean, and an empty table gives an empty result.  Every row is
judged by its own text, whatever its id, a null or repeated one too.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import saved, words_of

WINDOW, GRAM = 8, 4
#: The benchmark's hashes are broadcast up to so many rows of 16 to 200 bytes; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words; none if there are fewer than k."""
    run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), run)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(hashes: Column, window: int, k: int) -> Column:
    """The smallest k-gram hash of each window of that many words, each once."""
    width = window - k + 1
    grams = _grams(hashes, k)
    least = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (width - 1)), lambda i: F.array_min(F.slice(g, i, width)))
    # a one-element transform binds the gram array to a variable, so that it is computed once
    return F.when(F.size(hashes) >= window, F.array_distinct(F.get(F.transform(F.array(grams), least), 0))).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small, counted up to the limit only."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _texts(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*([F.col(id_col).alias("id")] if id_col else []), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _whole(hashes: Column, n: int) -> Column:
    """Marks of all runs of n words, for items of n words."""
    return F.transform(_grams(hashes, n), lambda g: F.xxhash64(g, F.lit(-n)))


def _found(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, gram: int) -> DataFrame:
    """(t1, t2, n_hit, items) of every text that has a hit."""
    d = _texts(docs, None, text_col)
    bench = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words")).filter((F.size("words") > 0) & F.col("item").isNotNull())
    length = F.least(F.size("words"), F.lit(window))
    at = F.sequence(F.lit(1), F.size("words") - length + 1)
    bench = bench.select("item", "words", length.alias("len"), F.explode(at).alias("at")).select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("run")).distinct()
    bench = saved(_hashed(bench.withColumnRenamed("run", "words")).withColumn("wh", F.xxhash64("words")), "bench")
    lengths = sorted(r[0] for r in bench.select("len").distinct().collect())  # at most `window` different lengths
    short = [n for n in lengths if n < window]
    none = F.array().cast("array<bigint>")

    # candidates: texts that share a winnowed hash with a window, or a whole short window
    marks = [_winnowed(F.col("hashes"), window, gram)] * (window in lengths) + [F.array_distinct(_whole(F.col("hashes"), n)) for n in short]
    prints = bench.filter(F.col("len") == window).select(F.explode(_winnowed(F.col("hashes"), window, gram)).alias("fp"))
    for n in short:
        prints = prints.union(bench.filter(F.col("len") == n).select(F.explode(_whole(F.col("hashes"), n)).alias("fp")))
    marked = _hashed(d.select("t1", "t2", words_of(F.col("text")).alias("words"))).select("t1", "t2", F.explode(F.flatten(F.array(*marks)) if marks else none).alias("fp"))
    shared = marked.join(_small(saved(prints.distinct(), "prints")), "fp", "left_semi").distinct()
    candidates = saved(shared.groupBy("t1", "t2").agg(F.collect_set("fp").alias("fps")), "candidates")

    # extension: the windows around a shared hash against the items' windows, word by word
    runs = bench.select(F.col("wh").alias("bwh"), F.col("words").alias("bwords"), F.col("len").alias("blen")).distinct()
    runs = saved(runs.withColumn("run", F.xxhash64("bwh", "bwords")), "runs")
    texts = d.join(_small(candidates), ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("fps").alias("fps"))
    texts = _hashed(texts.select("t1", "t2", "fps", words_of(F.col("text")).alias("words")))

    def places(grams: Column) -> Column:
        """Positions of the marks that are shared."""
        return F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains("fps", g), i)), lambda i: i.isNotNull())

    last = F.size("words") - window
    around = lambda p: F.sequence(F.greatest(F.lit(0), p - (window - gram)), F.least(p, last))
    spanning = lambda at, n: F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))
    starts = []
    if window in lengths:
        near = F.array_distinct(F.flatten(F.transform(places(_grams(F.col("hashes"), gram)), around)))
        starts.append(spanning(F.when(last >= 0, near).otherwise(F.array().cast("array<int>")), window))
    starts += [spanning(places(_whole(F.col("hashes"), n)), n) for n in short]
    spans = texts.select("t1", "t2", "words", F.explode(F.flatten(F.array(*starts)) if starts else F.array().cast("array<struct<start:int,n:int>>")).alias("s"))
    spans = spans.select("t1", "t2", "s.start", F.slice("words", F.col("s.start") + 1, F.col("s.n")).alias("w")).withColumn("wh", F.xxhash64("w"))
    hits = spans.join(_small(runs), (F.col("wh") == F.col("bwh")) & (F.col("w") == F.col("bwords"))).select("t1", "t2", "start", "blen", "run")
    hits = saved(hits, "hits")

    ends = hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("blen")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    covered = ends.select("t1", "t2", F.aggregate("spans", zero, step)["n"].alias("n_hit"))
    owners = bench.select(F.xxhash64("wh", "words").alias("run"), "item").distinct()
    named = hits.select("t1", "t2", "run").distinct().join(_small(saved(owners, "owners")), "run").groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return saved(covered.join(named, ["t1", "t2"]), "hit-texts")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items (sorted as strings)."""
    found = _found(docs, items, text_col, item_col, item_text_col, window, gram)
    d = _texts(docs, id_col, text_col).select("id", "t1", "t2", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = d.join(_small(found), ["t1", "t2"], "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def without_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs whose text has no hit, with all their columns."""
    found = _small(_found(docs, items, text_col, item_col, item_text_col, window, gram).select("t1", "t2"))
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(found, (F.xxhash64(text) == found["t1"]) & (F.xxhash64(F.lit(1), text) == found["t2"]), "left_anti")
