"""Quality: attention-based multiple-instance learning over a document's passages.

A passage is PASSAGE bytes of the text.  It is encoded from its hashed byte trigrams and a few shares (letters,
capitals, digits, marks, distinct trigrams) by a learned layer; gated attention (a tanh branch times a sigmoid
branch) weights the passages of a document; the weighted sum is scored by logistic regression.  All parts are
learned together from document labels.  A text of any length is read in blocks of BLOCK passages: the attention's
softmax is carried along as a running maximum and sum, so memory stays bounded.

Defined results: a null or empty text is one empty passage.  With no labelled rows, or rows of one class only,
every score is that class's share (0.5 without rows).  A score of exactly 0.5 counts as good.  Repeated rows get equal
scores; a null id is kept.  Columns other than id and text are ignored, whatever their names, and an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from marrow.llm import training

PASSAGE, BLOCK, BUCKETS, SHARES = 512, 2048, 256, 10
WIDTH, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 16, 64, 0.005, 1e-4

_KIND = np.zeros(256, np.uint8)  # 0 marks, 1 small letters and bytes of other scripts, 2 capitals, 3 digits, 4 white space
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def passages(data: np.ndarray) -> np.ndarray:
    """A row for each PASSAGE bytes of data."""
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, BUCKETS + SHARES), np.float32)
    if not len(data):
        return out
    size = np.full(n, PASSAGE, np.float32)
    size[-1] = len(data) - (n - 1) * PASSAGE
    where = np.arange(len(data), dtype=np.int64) // PASSAGE
    if len(data) >= 3:
        d = data.astype(np.uint32)
        h = (d[:-2] * np.uint32(65599) + d[1:-1]) * np.uint32(65599) + d[2:]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)
        grams = np.bincount(where[:-2] * BUCKETS + (h >> np.uint32(24)), minlength=n * BUCKETS).reshape(n, BUCKETS)
        fine = np.unique(where[:-2] << 14 | (h >> np.uint32(18)).astype(np.int64))
        out[:, BUCKETS] = np.bincount(fine >> 14, minlength=n) / size
        out[:, :BUCKETS] = np.sqrt(grams / size[:, None])
    kinds = np.bincount(where * 5 + _KIND[data], minlength=n * 5).reshape(n, 5) / size[:, None]
    out[:, BUCKETS + 1 : BUCKETS + 6] = kinds
    out[:, BUCKETS + 6] = np.bincount(where, data == 10, n) / size * 20
    out[:, BUCKETS + 7] = kinds[:, 2] / (kinds[:, 1] + kinds[:, 2] + 0.01)
    out[:, BUCKETS + 8] = size / PASSAGE
    out[:, BUCKETS + 9] = n == 1
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


@dataclass
class AttentionModel:
    """p: parameters by name; share: the constant score where nothing could be learned."""

    p: dict = field(default_factory=dict)
    share: float | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        p, out = self.p, np.zeros(len(texts))
        for k, text in enumerate(texts):
            data, most, total, mixed = _bytes(text), -np.inf, 0.0, np.zeros(WIDTH)
            for at in range(0, max(1, len(data)), PASSAGE * BLOCK):
                x = (passages(data[at : at + PASSAGE * BLOCK]) - p["mean"]) / p["std"]
                e = np.tanh(x @ p["W"] + p["c"])
                a = (np.tanh(e @ p["V"]) / (1 + np.exp(-(e @ p["U"])))) @ p["w"]
                top = max(most, float(a.max()))
                g = np.exp(a - top)
                keep = np.exp(most - top) if total else 0.0
                total, mixed, most = total * keep + g.sum(), mixed * keep + g @ e, top
            out[k] = mixed / total @ p["o"] + p["b"]
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> AttentionModel:
    if len(set(labels)) < 2:
        return AttentionModel(share=float(np.mean(labels)) if labels else 0.5)
    y = (np.array(labels) > 0).astype(np.float32)
    bags = [passages(_bytes(t)) for t in texts]
    x = np.concatenate(bags)
    mean, std = x.mean(0), x.std(0) + 0.01
    bags = [(b - mean) / std for b in bags]
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"W": draw(x.shape[1], WIDTH), "c": np.zeros(WIDTH, np.float32), "V": draw(WIDTH, GATE), "U": draw(WIDTH, GATE), "w": draw(GATE), "o": draw(WIDTH), "b": np.zeros(1, np.float32)}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            bag = np.repeat(np.arange(len(pick)), sizes)
            xb = np.concatenate([bags[i] for i in pick])
            e = np.tanh(xb @ p["W"] + p["c"])
            t, s = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
            a = (t * s) @ p["w"]
            g = np.exp(a - np.maximum.reduceat(a, starts)[bag])
            alpha = g / np.add.reduceat(g, starts)[bag]
            z = np.add.reduceat(alpha[:, None] * e, starts)
            q = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -50, 50)))
            dz = ((q - y[pick]) * weight[pick] / len(pick))[:, None]
            grad = {"o": (dz * z).sum(0), "b": dz.sum(0)}
            dbag = dz * p["o"]
            dalpha = (dbag[bag] * e).sum(1)
            da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
            dt, ds = da[:, None] * p["w"] * s * (1 - t**2), da[:, None] * p["w"] * t * s * (1 - s)
            de = alpha[:, None] * dbag[bag] + dt @ p["V"].T + ds @ p["U"].T
            dh = de * (1 - e**2)
            grad |= {"w": (da[:, None] * t * s).sum(0), "V": e.T @ dt, "U": e.T @ ds, "W": xb.T @ dh, "c": dh.sum(0)}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k in p:  # Adam with decoupled decay
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * p[k] * (p[k].ndim > 1))
    return AttentionModel(p | {"mean": mean, "std": std, "b": float(p["b"][0])})


def train(docs: DataFrame, labels: DataFrame, allowed=None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = training.MAX_ROWS, max_chars: int = training.MAX_CHARS) -> AttentionModel:
    from pyspark.sql import functions as F

    return fit(*training.labelled(docs, labels, F.lit(True) if allowed is None else allowed, label_col, id_col, text_col, max_rows, max_chars))
