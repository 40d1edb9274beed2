"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The features approximate a Gaussian kernel: cosines of random projections of standardised
statistics. Partitions sum their part of the normal equations, whose size depends on the number of
features alone; the driver solves them. Training scores are then counted in fixed bins, and
adjacent violators pooled into a rising step function from scores to the share of good documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import summed, training_texts

#: Labelled documents of each class that are fitted on at most, about.
PER_CLASS = 15_000
FEATURES, WIDTH, RIDGE, BINS = 384, 4.0, 1e-3, 2000
MARKS = "!|*$%&#"
STATISTICS = 20


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all but the sizes are shares. Null is as empty."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, nw = len(text), len(words)
    chars, counts = Counter(text), Counter(words)
    letters = upper = digits = spaces = marks = other = 0
    entropy = 0.0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
        elif c.isspace():
            spaces += k
        elif c.isdigit():
            digits += k
        elif c in MARKS:
            marks += k
        elif c not in ".,":
            other += k
        entropy -= k / n * math.log(k / n)
    lines = text.split("\n")
    sizes = [len(w) for w in counts]
    mean = sum(sizes) / len(sizes)
    return [
        math.log1p(nw),
        (n - spaces) / nw,
        math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)),
        math.log1p(max(sizes)),
        letters / n,
        upper / max(letters, 1),
        digits / n,
        spaces / n,
        marks / n,
        other / n,
        entropy,
        len(counts) / nw,
        len(counts) / math.sqrt(nw),
        counts.most_common(1)[0][1] / nw,
        sum(map(str.__eq__, words, words[1:])) / nw,
        sum(w.isupper() for w in counts) / len(counts),
        sum(not w[-1].isalnum() for w in counts) / len(counts),
        len(set(lines)) / len(lines),
        math.log1p(nw / len(lines)),
        (chars["."] + chars[","]) / nw,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.directions + self.shifts) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def pool(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rising values nearest to `value` by weighted squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 4, rest: int = 2, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from a bounded sample of labelled documents that are not held out; only their texts are read as input.

    Without any labelled document every score is 0.5.
    """
    taken = training_texts(docs, labels, label, modulus, rest, per_class, key=key, text=text)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    rows = taken.select(described("text").alias("x"), "y").persist()
    try:
        d = STATISTICS
        moments = summed(rows, lambda f: np.array([[len(f)] * d, np.stack(f.x).sum(0), (np.stack(f.x) ** 2).sum(0)]), (3, d))
        n = max(moments[0, 0], 1)
        mean = moments[1] / n
        scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 0))
        random = np.random.default_rng(11)
        m = Model(mean, np.where(scale > 1e-9, scale, 1.0), random.normal(size=(d, FEATURES)) / WIDTH, random.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        if not moments[0, 0]:
            return m

        # Each class weighs as much as the other in the fit; calibration below uses their true shares.
        ones = summed(rows, lambda f: np.array([f.y.sum()], dtype=float), (1,))[0]
        weigh = {1: n / (2 * max(ones, 1)), 0: n / (2 * max(n - ones, 1))}

        def equations(f: pd.DataFrame) -> np.ndarray:
            z, w = m.expand(np.stack(f.x)), f.y.map(weigh).to_numpy()[:, None]
            return (z * w).T @ np.hstack([z, f.y.to_numpy()[:, None]])

        sums = summed(rows, equations, (FEATURES + 1, FEATURES + 2))
        m.weights = np.linalg.solve(sums[:, :-1] + np.eye(FEATURES + 1) * RIDGE * n / FEATURES, sums[:, -1])

        def binned(f: pd.DataFrame) -> np.ndarray:
            at = np.clip(((m.raw(np.stack(f.x)) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            return np.array([np.bincount(at, minlength=BINS), np.bincount(at, weights=f.y, minlength=BINS)], dtype=float)

        counts = summed(rows, binned, (2, BINS))
        full = counts[0] > 0
        centres = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[full]
        m.knots, m.levels = centres, np.clip(pool(counts[0][full], counts[1][full] / counts[0][full]), 0.001, 0.999)
        # Beyond and between the steps the scores keep rising a little, so that ties stay rare.
        m.levels = 0.99 * m.levels + 0.01 * np.clip((centres + 0.5) / 2, 0, 1)
        return m
    finally:
        rows.unpersist()


def score(text: Column, model: Model) -> Column:
    """Probability that a whole text has label 1; null and empty texts are scored like a text without words."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], dtype=float).reshape(-1, STATISTICS)))

    return scored(text.cast("string"))
