"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed run of 3 to 6 characters of the lower-cased text.  Counts over toxic and
other documents give each feature its log-count ratio; the features that tell the classes apart (chi-square
of MIN_CHI at least, less where few rows teach) are scaled by it and weighted by L2-regularised logistic regression.  A
text is read to its end in blocks of BLOCK characters that overlap by one run, so memory stays bounded.

Defined results: a null or empty text has no features and gets the score of the bias alone.  With no labelled
rows, or rows of one class only, every score is that class's share (0.5 without rows).  A score of exactly 0.5 counts as
toxic.  Repeated rows get equal scores; a null id is kept.  Columns other than id and text are ignored, whatever
their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from marrow.llm import training

SIZES, BITS, BLOCK = (3, 4, 5, 6), 22, 1 << 20
MAX_FEATURES, MIN_CHI, MIN_DOCS, MIN_SHARE, SMOOTHING, L2, ROUNDS = 4096, 30.0, 4, 0.02, 1.0, 0.01, 500
#: A feature must be in MIN_DOCS texts and in as many as MIN_SHARE of the smaller class has.  With fewer rows than MIN_CHI / CHI_SHARE the chi-square wanted is this share of the rows (it can't exceed their number).
CHI_SHARE, LEAST_CHI = 0.1, 8.0


def _runs(data: np.ndarray):
    """Hashed runs of each size."""
    h = data
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in SIZES:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of the text, those in the bitmap ``wanted`` only."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for at in range(0, len(data), BLOCK):
        for h in _runs(data[at : at + BLOCK + max(SIZES) - 1]):
            found.append(np.unique(h if wanted is None else h[wanted[h]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class NaiveBayesScaledModel:
    bias: float
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self._wanted = None

    def score(self, texts: list[str]) -> np.ndarray:
        if self._wanted is None:
            self._wanted = np.zeros(1 << BITS, bool)
            self._wanted[self.ids] = True
        z = [self.bias + self.weights[np.searchsorted(self.ids, features(t, self._wanted))].sum() for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z), -50, 50)))


def fit(texts: list[str], labels: list[int]) -> NaiveBayesScaledModel:
    once = dict(zip(texts, labels, strict=True))  # copies would make their rarest runs look telling
    texts, labels = list(once), list(once.values())
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return NaiveBayesScaledModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = np.zeros((2, 1 << BITS), np.int32)
    for t, label in zip(texts, labels, strict=True):
        counts[int(label > 0)][features(t)] += 1
    seen = np.flatnonzero(counts.sum(0) >= max(MIN_DOCS, MIN_SHARE * min(y.sum(), (1 - y).sum())))
    neg, pos = counts[:, seen].astype(float)
    n_neg, n_pos = float((y == 0).sum()), float((y > 0).sum())
    expected = (pos + neg) * n_pos / len(y)
    chi = (pos - expected) ** 2 / expected + (neg - (pos + neg - expected)) ** 2 / (pos + neg - expected)
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    best = np.sort(best[chi[best] >= min(MIN_CHI, max(LEAST_CHI, CHI_SHARE * len(y)))])
    ids = seen[best].astype(np.uint32)
    ratio = np.log((pos[best] + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg[best] + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    wanted = np.zeros(1 << BITS, bool)
    wanted[ids] = True
    rows = [np.searchsorted(ids, features(t, wanted)) for t in texts]
    sizes = np.array([len(r) for r in rows])
    if not len(ids) or not sizes.sum():  # nothing tells the classes apart
        return NaiveBayesScaledModel(float(np.log(n_pos / n_neg)))
    col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    x = ratio[col]
    w, b = np.zeros(len(ids)), float(np.log(n_pos / n_neg))
    balance = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    gw, gb, rate = np.full(len(ids), 1e-8), 1e-8, 0.3
    for _ in range(ROUNDS):  # AdaGrad over all rows
        z = np.bincount(row, x * w[col], len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - (y > 0)) * balance
        dw = np.bincount(col, e[row] * x, len(ids)) + L2 * w / len(ids)
        gw += dw**2
        gb += e.sum() ** 2
        w -= rate * dw / np.sqrt(gw)
        b -= rate * e.sum() / np.sqrt(gb)
    return NaiveBayesScaledModel(float(b), ids, w * ratio)


def train(docs: DataFrame, labels: DataFrame, allowed=None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = training.MAX_ROWS, max_chars: int = training.MAX_CHARS) -> NaiveBayesScaledModel:
    from pyspark.sql import functions as F

    return fit(*training.labelled(docs, labels, F.lit(True) if allowed is None else allowed, label_col, id_col, text_col, max_rows, max_chars))
