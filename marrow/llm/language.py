"""Language identification with word-first backoff.

A word is a letter of the lower-cased text (Unicode category L) with the letters and marks (M) after it.  A known word costs -log10 of its relative frequency in each
language; an unseen word is looked up by its character n-grams (with a mark at each end), the longest that are
known in any language, and costs their mean.  What a language lacks costs PENALTY.  A text is given the language
with the lowest mean cost.

The tables are learned from a bounded sample: PER_LANG texts of each of the MAX_LANGS commonest languages, MAX_ROWS
texts in all, of training.MAX_CHARS characters at most; words and n-grams seen once are left out.  Costs of unseen words are remembered in the task up to MEMORY words,
which changes no result.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing
could be learned.  A tie goes to the first language in alphabetical order.  Repeated rows get equal results; a null
id is kept.  Columns other than id and text are ignored, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from marrow.llm import training
from marrow.llm.common import saved

LONGEST, PENALTY, MEMORY, MIN_COUNT = 5, 7.0, 500_000, 2
PER_LANG, MAX_LANGS, MAX_ROWS = 750, 200, 6000


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Words; and what Python's ``\\w`` holds besides letters, digits and _ (numerals such as a half), in the basic plane and in all."""

    def ranges(wanted: Callable[[str], bool], upto: int) -> str:
        inside = [i for i in range(upto) if wanted(chr(i))]
        starts = [i for k, i in enumerate(inside) if k == 0 or inside[k - 1] != i - 1]
        ends = [i for k, i in enumerate(inside) if k + 1 == len(inside) or inside[k + 1] != i + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))

    marks = ranges(lambda c: unicodedata.category(c)[0] == "M", 0x110000)
    numeral = lambda c: c.isnumeric() and not c.isdecimal() and not c.isalpha()
    return re.compile(rf"[^\W\d_](?:[^\W\d_]|[{marks}])*"), re.compile(f"[{ranges(numeral, 0x10000)}]"), re.compile(f"[{ranges(numeral, 0x110000)}]")


def words_of(text: str) -> list[str]:
    word, numeral, any_numeral = _patterns()
    text = text.lower()
    if not text.isascii():
        if max(text) > "\uffff":
            numeral = any_numeral
        if numeral.search(text):
            text = numeral.sub(" ", text)
    return word.findall(text)


def _grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class BackoffModel:
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)  # word -> its row of word_costs
    word_costs: np.ndarray | None = None
    grams: list[dict[str, int]] = field(default_factory=list)  # by length - 1
    gram_costs: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self._seen: dict = {}

    def cost(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return self.word_costs[found]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [c for g in _grams(word, n) if (c := self.grams[n - 1].get(g)) is not None]
            if known:
                return self.gram_costs[n - 1][known].mean(0)
        return np.full(len(self.langs), PENALTY)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        sizes = np.array([len(s) for s in split], int)
        langs, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if not self.langs or not sizes.sum():
            return langs.tolist(), score
        codes, distinct = pd.factorize(np.array([w for s in split for w in s], object))
        if len(self._seen) > MEMORY:
            self._seen = {}
        table = np.empty((len(distinct), len(self.langs)))
        for i, w in enumerate(distinct):
            c = self._seen.get(w)
            if c is None:
                c = self._seen[w] = self.cost(w)
            table[i] = c
        has = sizes > 0
        starts = np.r_[0, np.cumsum(sizes[has])[:-1]]
        cost = np.add.reduceat(table[codes], starts) / sizes[has][:, None]
        best = cost.argmin(1)
        gap = (cost - cost.min(1, keepdims=True)) * np.log(10) * np.minimum(sizes[has], 20)[:, None]
        langs[has] = np.array(self.langs, object)[best]
        score[has] = 1 / np.exp(-np.minimum(gap, 700)).sum(1)
        return langs.tolist(), score


def fit(texts: list[str], langs: list[str]) -> BackoffModel:
    names = sorted(set(langs))
    words = {lang: Counter() for lang in names}
    for t, lang in zip(texts, langs, strict=True):
        words[lang].update(words_of(t))
    total = Counter()
    for c in words.values():
        total.update(c)

    def costs(by: dict[str, Counter], seen: Counter) -> tuple[dict[str, int], np.ndarray]:
        keep = [k for k, n in seen.items() if n >= MIN_COUNT]
        share = np.array([[by[x][k] for k in keep] for x in names], float).T / [max(1, sum(by[x].values())) for x in names]
        with np.errstate(divide="ignore"):
            return {k: i for i, k in enumerate(keep)}, np.minimum(PENALTY, -np.log10(share)).reshape(len(keep), len(names)).astype(np.float32)

    model = BackoffModel(names, *costs(words, total))
    for n in range(1, LONGEST + 1):
        by = {lang: Counter() for lang in names}
        for lang in names:
            for w, k in words[lang].items():
                for g in _grams(w, n):
                    by[lang][g] += k
        seen = Counter()
        for c in by.values():
            seen.update(c)
        for kept, one in zip((model.grams, model.gram_costs), costs(by, seen), strict=True):
            kept.append(one)
    return model


def train(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = training.MAX_CHARS) -> BackoffModel:
    """Learns from the allowed rows of each language with the smallest id hashes; of rows that repeat an id the smallest text counts."""
    d = docs.select(F.col(id_col), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col(id_col).isNotNull() & (F.char_length("t") <= max_chars))
    d = (d if allowed is None else d.filter(allowed)).withColumnRenamed(id_col, "id")
    ids = saved(d.select("id", "l"), "languages")
    counts = ids.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGS).collect()
    if not counts:
        return fit([], [])
    each = max(1, min(PER_LANG, max_rows // len(counts)))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    upto = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, int((1 << 30) * min(1.0, 1.2 * each / n + 50 / n)))])
    some = ids.filter(h < F.try_element_at(upto, F.col("l")))  # hardly more than are wanted of each language
    picked = some.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(h, "id"))).filter(F.col("n") <= each).select("id", "l").distinct()
    rows = sorted(d.join(F.broadcast(picked), ["id", "l"]).groupBy("id", "l").agg(F.min("t").alias("t")).collect())  # at most max_rows rows of max_chars
    return fit([r["t"] for r in rows], [r["l"] for r in rows])


def identify(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    like, kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from marrow.llm.piece_table import blocks

        for keys, texts in blocks(batches, limit=1_000_000):
            langs, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, like), pa.array(langs, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
