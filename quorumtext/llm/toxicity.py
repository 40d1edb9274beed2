"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters and their marks, described by itself and by its first four to six characters. Which
of these features count is told by how often they occur in toxic and in clean labelled documents; all
telling ones form the lexicon, whose size the sample of documents bounds. They also label tokens: those of toxic
documents that hold a telling feature are toxic, all others are clean. On such labelled tokens, with
their neighbours, the field's weights are learned by ascent of the conditional likelihood: partitions sum
their part of its gradient, and the driver holds one number for each feature.

For a document, forward and backward passes over all tokens give each token's marginal. The score
combines those of tokens with evidence, as the probability that one of them at least is toxic,
calibrated on the labelled documents; tokens whose marginal is half or more give the offsets.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import drawn, summed, training_texts

#: Labelled documents of each class, and labelled windows, that are fitted on at most, about; tokens beside a window's own.
PER_CLASS, WINDOWS, REACH = 10_000, 60_000, 6
#: Partitions of the windows; steps of the ascent.
PARTS, STEPS = 8, 30
#: A feature is telling from so many toxic documents, this log odds ratio and this log likelihood gain on.
LEAST_DOCS, LEAST_ODDS, LEAST_GAIN = 4, 2.5, 12.0
PREFIXES = (4, 5, 6)
#: Features that a task counts before it hands them on, and tokens whose evidence it remembers.
HELD, REMEMBERED = 50_000, 150_000


def _marks() -> str:
    """The code points of combining marks, as ranges of a character class."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)).startswith("M"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_TOKEN = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")
SPANS = "struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>"


def features(token: str) -> list[str]:
    """A lower-cased token's own feature and those of its beginnings."""
    return [token] + [f"{n}:{token[:n]}" for n in PREFIXES if len(token) > n]


@dataclass
class Field:
    """Weights of features (summed per token), bias and transitions between clean (0) and toxic (1)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    slope: float = 1.0
    offset: float = -6.0
    known: dict[str, float] = field(default_factory=dict)

    def evidence(self, token: str) -> float:
        """Weight of a token for being toxic, beside the bias; 0 for one without lexicon features."""
        if (e := self.known.get(token)) is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            e = self.known[token] = sum(self.weights.get(f, 0.0) for f in features(token))
        return e

    def marginals(self, evidence: list[float]) -> list[float]:
        """Every token's probability of being toxic, by forward and backward passes over all tokens."""
        (a, b), (c, d) = ((math.exp(x) for x in row) for row in self.moves)
        bias = math.exp(self.bias)
        emit = [bias * math.exp(min(e, 60.0)) for e in evidence]
        p, forward = 1.0, []  # share of clean, normalised at each token
        q = 0.0
        for i, e in enumerate(emit):
            p, q = (p * a + q * c, (p * b + q * d) * e) if i else (1.0, e)
            total = p + q
            p, q = p / total, q / total
            forward.append(q)
        r, s, out = 1.0, 1.0, [0.0] * len(emit)
        for i in range(len(emit) - 1, -1, -1):
            q = forward[i] * s
            out[i] = q / (q + (1 - forward[i]) * r)
            e = emit[i]
            r, s = a * r + b * e * s, c * r + d * e * s
            total = r + s
            r, s = r / total, s / total
        return out

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, [(start, end, marginal)]) of a whole text; offsets are code points, neighbouring tokens one span."""
        text = text or ""
        low = text.lower()
        evidence = [self.evidence(t) for t in _TOKEN.findall(low)]
        if not any(evidence):
            return self.calibrated(0.0), []
        p = self.marginals(evidence)
        held = sum(-math.log(max(1 - x, 1e-12)) for x, e in zip(p, evidence, strict=True) if e)
        spans: list[tuple[int, int, float]] = []
        if max(p) >= 0.5:
            at = [m.span() for m in _TOKEN.finditer(low)]
            back = _offsets(text) if len(low) != len(text) else None
            for i, x in enumerate(p):
                if x >= 0.5:
                    begin, end = (back[at[i][0]], back[at[i][1] - 1] + 1) if back else at[i]
                    if spans and i and p[i - 1] >= 0.5:
                        spans[-1] = (spans[-1][0], end, max(spans[-1][2], x))
                    else:
                        spans.append((begin, end, x))
        return self.calibrated(held), spans

    def calibrated(self, held: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(100 * held) + self.offset))))


def _offsets(text: str) -> list[int]:
    """For each character of the lower-cased text, where it comes from (some letters become two)."""
    return [i for i, c in enumerate(text) for _ in c.lower()]


def _telling(counts: DataFrame, toxic: int, documents: int) -> DataFrame:
    """Of (f, t, c), the features that tell enough, with their odds; t and c count toxic and clean uses."""
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (documents - toxic + 1.0))
    gain = t * F.log(t * documents / ((t + c) * max(toxic, 1)))
    return counts.where(t >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (gain >= LEAST_GAIN))


def lexicon(taken: DataFrame) -> dict[str, float]:
    """Log odds ratios of the telling features of labelled texts (doc, text, y), a bounded sample.

    Candidates are found by the documents that hold them, counted in each batch before they are
    shuffled. Copies of a toxic document would make any of its rare words telling, so candidates are
    counted again by the distinct pairs of neighbours between which they stand, and have to pass by these counts too.
    """
    totals = taken.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: tuple[Counter, Counter] = Counter(), Counter()

        def counted() -> pd.DataFrame:
            names = list(sums[0].keys() | sums[1].keys())
            out = pd.DataFrame({"f": names, "t": [sums[1][f] for f in names], "c": [sums[0][f] for f in names]})
            sums[0].clear()
            sums[1].clear()
            return out

        for frame in frames:
            for body, y in zip(frame.text, frame.y, strict=True):
                sums[y].update({f for t in set(_TOKEN.findall(body.lower())) for f in features(t)})
                if len(sums[0]) + len(sums[1]) > HELD:
                    yield counted()
        yield counted()

    counts = taken.select("text", "y").mapInPandas(held, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    likely = {r["f"] for r in _telling(counts, totals["t"], totals["n"]).select("f").collect()}  # at most a LEAST_DOCS-th of the sample's features

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for body, y in zip(frame.text, frame.y, strict=True):
                t = ["", *_TOKEN.findall(body.lower()), ""]
                rows += [(f, t[i - 1], t[i + 1], y) for i in range(1, len(t) - 1) for f in features(t[i]) if f in likely]
            yield pd.DataFrame(rows, columns=["f", "before", "after", "y"])

    uses = taken.select("text", "y").mapInPandas(placed, "f string, before string, after string, y int").distinct()
    counts = uses.groupBy("f").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    return {r["f"]: r["odds"] for r in _telling(counts, totals["t"], totals["n"]).select("f", "odds").collect()}


def likelihood(f: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
    """Log likelihood of labelled windows and its gradient by w: features' weights, bias and four transitions.

    f has the tokens' feature indices (-1: none), y their labels (-1: outside the text), a row for each window;
    a window counts as often as `times` says.
    """
    n = len(w) - 5
    width, k = y.shape[1], len(y)
    times = np.broadcast_to(times, k)[:, None]
    inside = y >= 0
    pairs = inside[:, 1:] & inside[:, :-1]
    at = np.where(f < 0, n, f)
    emit = np.where(inside, np.append(w[:n], 0.0)[at].sum(2) + w[n], 0.0)
    t = w[n + 1 :].reshape(2, 2)
    score = np.stack([np.zeros_like(emit), emit], 2)
    forward, backward = np.zeros((k, width, 2)), np.zeros((k, width, 2))
    forward[:, 0] = score[:, 0]
    for i in range(1, width):
        step = forward[:, i - 1, :, None] + np.where(pairs[:, i - 1, None, None], t, 0.0)
        forward[:, i] = np.logaddexp(step[:, 0], step[:, 1]) + score[:, i]
    for i in range(width - 2, -1, -1):
        step = np.where(pairs[:, i, None, None], t, 0.0) + (score[:, i + 1] + backward[:, i + 1])[:, None, :]
        backward[:, i] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    # A place outside the text has both labels of the same weight, which counts each labelling twice.
    outside = (~inside).sum(1) * math.log(2)
    p = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
    miss = np.where(inside, y - p, 0.0) * times
    out = np.zeros(n + 6)
    out[0] = (emit * (y == 1) * times).sum() - ((whole - outside) * times[:, 0]).sum()
    out[1 : n + 1] = np.bincount(at.ravel(), np.repeat(miss.ravel(), at.shape[2]), n + 1)[:n]
    out[n + 1] = miss.sum()
    for a in (0, 1):
        for b in (0, 1):
            expected = np.exp(forward[:, :-1, a] + t[a, b] + (score[:, 1:] + backward[:, 1:])[:, :, b] - whole[:, None])
            seen = (y[:, :-1] == a) & (y[:, 1:] == b)
            out[n + 2 + 2 * a + b] = ((seen - expected) * pairs * times).sum()
            out[0] += t[a, b] * (seen * pairs * times).sum()
    return out


def ascend(evaluate: Callable[[np.ndarray], np.ndarray], w: np.ndarray, penalty: float = 0.01, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """The maximum of evaluate(w)[0] less penalty / 2 times squared weights, by steps along the gradient that past steps' curvature scales (L-BFGS)."""

    def full(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = evaluate(w)
        return found[0] - penalty / 2 * (w @ w), found[1:] - penalty * w

    value, slope = full(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, held = slope.copy(), []
        for s, d in reversed(past):
            a = (s @ q) / (s @ d)
            q -= a * d
            held.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(np.abs(slope).max(), 1e-9)
        for (s, d), a in zip(past, reversed(held), strict=True):
            q += (a - (d @ q) / (s @ d)) * s
        size = min(1.0, 4.0 / max(np.abs(q).max(), 1e-9))  # no weight moves further than this at once
        for _ in range(6):
            new, new_slope = full(w + size * q)
            if new > value:
                break
            size /= 4
        else:
            break
        s, d = size * q, slope - new_slope
        if s @ d > 1e-10:
            past = [*past, (s, d)][-memory:]
        done = new - value < 1e-5 * abs(value)
        w, value, slope = w + s, new, new_slope
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 3, rest: int = 1, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Field:
    """Learn a field from a bounded sample of labelled documents that are not held out.

    Which windows are learned from, and what is learned, depends on labels and texts alone. Without toxic
    labelled documents the lexicon is empty and every score near 0.
    """
    taken = training_texts(docs, labels, label, modulus, rest, per_class, key=key, text=text)
    odds = lexicon(taken)
    if not odds:
        return Field()
    names = sorted(odds)
    places = {f: i for i, f in enumerate(names)}
    width, depth = 2 * REACH + 1, 1 + len(PREFIXES)

    def label_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for body, toxic in zip(frame.text, frame.y, strict=True):
                draw = zlib.crc32(body.encode())
                tokens = _TOKEN.findall(body.lower())
                held = [[places[x] for x in features(t) if x in places] for t in tokens]
                spots = [i for i, h in enumerate(held) if h]
                if tokens and not spots:
                    spots = [draw % len(tokens)]  # clean surroundings are learned from too
                for i in spots:
                    around = range(i - REACH, i + REACH + 1)
                    own = [held[j] if 0 <= j < len(tokens) else [] for j in around]
                    f = np.array([x for h in own for x in h + [-1] * (depth - len(h))], dtype=np.int32)
                    y = np.array([-1 if not 0 <= j < len(tokens) else int(toxic and bool(held[j])) for j in around], dtype=np.int8)
                    rows.append((draw, i, f.tobytes(), y.tobytes()))
            yield pd.DataFrame(rows, columns=["draw", "spot", "features", "labels"])

    marked = cut(taken.select("text", "y").mapInPandas(label_tokens, "draw long, spot int, features binary, labels binary"))
    share = min(1.0, WINDOWS / max(marked.count(), 1))
    some = marked.where(drawn(share, F.col("draw"), F.col("spot"))).groupBy("features", "labels").agg(F.count("*").alias("times"))
    some = cut(some.repartition(PARTS))  # WINDOWS rows at most, about, however many documents there are
    n = len(names)

    def evaluate(w: np.ndarray) -> np.ndarray:
        def own(frame: pd.DataFrame) -> np.ndarray:
            f = np.frombuffer(b"".join(frame.features), dtype=np.int32).reshape(len(frame), width, -1)
            return likelihood(f, np.frombuffer(b"".join(frame.labels), dtype=np.int8).reshape(len(frame), width), w, frame.times.to_numpy())

        return summed(some, own, (n + 6,), pools=0)  # PARTS rows

    start = np.array([*(odds[f] for f in names), -4.0, 0.0, 0.0, 0.0, 0.0])
    w = ascend(evaluate, start)
    model = Field(dict(zip(names, w.tolist(), strict=False)), float(w[n]), ((float(w[n + 1]), float(w[n + 2])), (float(w[n + 3]), float(w[n + 4]))), 1.0, 0.0)

    # Calibration by logistic regression of the labels on the pooled evidence, counted in fixed bins.
    @F.pandas_udf("double")
    def pooled(texts: pd.Series) -> pd.Series:
        scores = np.array([model.tag(t)[0] for t in texts])
        return pd.Series(np.log(scores / (1 - scores)))

    counts = taken.groupBy(F.round(pooled("text") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()  # 300 bins at most
    x, k, t = (np.array([r[c] for r in counts], dtype=float) for c in ("bin", "n", "t"))
    model.slope, model.offset = _logistic(x / 10, k, t)
    model.known = {}
    return model


def _logistic(x: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to slope 1 that keeps separable data finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = n * p * (1 - p)
        g = np.array([((t - n * p) * x).sum() - 0.1 * (a - 1), (t - n * p).sum() - 0.1 * b])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -3, 3)
    return float(max(a, 0.0)), float(b)


def tag(text: Column, model: Field) -> Column:
    """(score, spans) of every whole text as a struct; null and empty texts have the lowest score and no spans."""

    @F.pandas_udf(SPANS)
    def tagged(texts: pd.Series) -> pd.DataFrame:
        found = [model.tag(t) for t in texts]
        return pd.DataFrame({"score": [s for s, _ in found], "spans": [[{"start": a, "end": b, "marginal": p} for a, b, p in spans] for _, spans in found]})

    return tagged(text.cast("string"))


def score(text: Column, model: Field) -> Column:
    """The scores of tag() alone."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.tag(t)[0] for t in texts], dtype="float64")

    return scored(text.cast("string"))
