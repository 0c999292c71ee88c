"""Operator 8, quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document's features are its distinct lower-cased words, hashed, each with weight
1 / sqrt(words); statistics of its structure, as numbers and as one-hot bins; and
numeric metadata. The score is the logistic of b + sum w_i x_i + sum_{i<j} <v_i, v_j>
x_i x_j, the last term in linear time as half of (sum v x)^2 - sum (v x)^2 over the
factors. It is trained by AdaGrad on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .labelled import sample

#: Slots for words, bins of a statistic, factors, labelled documents used at most.
WORDS, BINS, FACTORS, SAMPLE = 1 << 15, 8, 6, 6000

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GROUPS = (_UPPER, b"0123456789", b"!", b"|", b"#$%&*", b"<>{}[]=\\/_~^@+", b".", b",", b"\n", b'"\'()')
STATS = len(_GROUPS) + 9


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """Figures of a text's structure, each from 0 to 1."""
    size, n = max(len(data), 1), max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    out = [((size - len(data.translate(None, g)) if data else 0) / size) ** 0.5 for g in _GROUPS]
    out += [
        min(np.log1p(len(words)) / 10, 1.0),
        len(counts) / n,
        min(len(data) / n / 16, 1.0),
        (max(counts.values()) / n) ** 0.5 if counts else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(w[:1].isupper() for w in words) / n,
        sum(w.isupper() for w in words) / n,
        (len(data) - len(data.decode())) / size,
    ]
    return out


def features(text: str, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    data = text.encode()
    words = data.split()
    distinct = {w.lower() for w in words}
    idx = [zlib.crc32(w) & (WORDS - 1) for w in distinct]
    val = [1 / max(len(distinct), 1) ** 0.5] * len(idx)
    numbers = statistics(data, words) + [0.0 if m is None or m != m else min(float(np.log1p(max(m, 0.0))) / 16, 1.0) for m in meta]
    for i, x in enumerate(numbers):
        at = WORDS + i * (BINS + 1)
        idx += [at, at + 1 + min(int(x * BINS), BINS - 1)]
        val += [x, 0.5]
    return np.array(idx, np.int32), np.array(val, np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        idx = np.concatenate([i for i, _ in rows])
        val = np.concatenate([x for _, x in rows])
        at = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        vx = self.v[idx] * val[:, None]
        inter = np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx**2, at)
        return self.bias + np.add.reduceat(self.w[idx] * val, at) + 0.5 * inter.sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows).astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss in small batches. Without rows, or with one label only,
    the machine scores the (smoothed) share of label 1."""
    r = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    m = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), (r.normal(size=(size, FACTORS)) * 0.02).astype(np.float32))
    if not len(rows) or labels.min() == labels.max():
        m.v[:] = 0
        return m
    gw, gv = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            batch = [rows[i] for i in some]
            idx, val = np.concatenate([i for i, _ in batch]), np.concatenate([x for _, x in batch])
            n = np.array([len(i) for i, _ in batch])
            err = (m.scores(batch) - labels[some]).astype(np.float32)
            m.bias -= 0.05 * float(err.mean())
            e = np.repeat(err, n)
            vx = m.v[idx] * val[:, None]
            s = np.repeat(np.add.reduceat(vx, np.cumsum([0, *n[:-1]])), n, axis=0)
            dw = e * val + decay * m.w[idx]
            dv = (e * val)[:, None] * (s - vx) + decay * m.v[idx]
            u, back = np.unique(idx, return_inverse=True)
            sw = np.bincount(back, dw, len(u)).astype(np.float32)
            sv = np.stack([np.bincount(back, dv[:, k], len(u)) for k in range(FACTORS)], axis=1).astype(np.float32)
            gw[u] += sw**2
            gv[u] += sv**2
            m.w[u] -= rate * sw / np.sqrt(gw[u])
            m.v[u] -= rate * sv / np.sqrt(gv[u])
    return m


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), most: int = SAMPLE) -> FactorisationMachine:
    """``use`` says, over columns k (the id) and label, which labels may be learned from."""
    rows = sample(docs, labels, label, use, most, extra=metadata)

    def extract(columns: list[pa.Array]) -> list[pa.Array]:
        texts, *meta = (c.to_pylist() for c in columns)
        got = [features(t, list(m)) for t, *m in zip(texts, *meta, strict=True)]
        return [pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())]

    numbers = [F.col(f"extra{i}").cast("double") for i in range(len(metadata))]
    # at most ``most`` rows of features
    kept = mapped(rows, ["label"], [F.col("text"), *numbers], extract, "i binary, x binary").collect()
    kept.sort(key=lambda r: (bytes(r.i), r.label))
    pairs = [(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32)) for r in kept]
    return fit(pairs, np.array([r.label for r in kept], np.float32), WORDS + (STATS + len(metadata)) * (BINS + 1))


def score(docs: DataFrame, model: FactorisationMachine, keep: list[str], metadata: tuple[str, ...] = ("n_chars",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score, the probability of label 1 for each whole text. Null
    texts are empty, null metadata count as zero; rows come back as often as they came, an
    empty table gives an empty one, and other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def apply(columns: list[pa.Array]) -> list[pa.Array]:
        texts, *meta = (c.to_pylist() for c in columns)
        return [pa.array(shared.value.scores([features(t, list(m)) for t, *m in zip(texts, *meta, strict=True)]), pa.float64())]

    return mapped(docs, keep, [F.coalesce(F.col(text_col), F.lit("")), *(F.col(m).cast("double") for m in metadata)], apply, "score double")
