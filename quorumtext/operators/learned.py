"""A learned choice in every column: features, labels by forced costs, ridge logistic regression, cross-validation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..plans.storage import kept, summed
from .network import Networks, by_networks, forced_of
from .script import constrain as constrained_line
from .script import constrained

#: Penalty of squared weights; Newton steps of the fit at most; length of a plain step, of which 1,500 were the usual fit.
RIDGE, STEPS, RATE, DESCENT = 1e-2, 12, 0.5, 1500


def feature_names(models: list[str]) -> list[str]:
    base = ["bias", "n_agree", "conf_sum", "conf_max", "is_gap", "is_special", "is_mark", "is_space", "n_candidates", "position", "other_language"]
    return base + [f"{kind}_{m}{end}" for m in models for kind, end in (("from", ""), ("conf", ""), ("conf", "_x_language"), ("from", "_x_gap"))]


@dataclass
class _Candidates:
    """The candidates of all disputed columns of a batch of lines, by line, column and first proposal; `letter` is a code point, -1 for a gap."""

    line: np.ndarray
    col: np.ndarray
    place: np.ndarray
    letter: np.ndarray
    n_c: np.ndarray
    features: np.ndarray


def _candidates(networks: Networks, other: np.ndarray, special: str) -> _Candidates:
    """Candidates with their features. Sums run in member order."""
    members = networks.letters.shape[1]
    n, sizes, own = float(members), networks.sizes, networks.disputed
    line, col, letters, confs = networks.line[own], networks.col[own], networks.letters[own], networks.confs[own]
    first = np.stack([(letters[:, :m] != letters[:, m, None]).all(1) for m in range(members)], 1)
    at, m = np.nonzero(first)
    letter, n_c = letters[at, m], first.sum(1)[at]
    v = (letters[at] == letter[:, None]).astype(float)
    s = np.where(v > 0, confs[at], 0.0)
    add = lambda x: reduce(lambda a, k: a + x[:, k], range(members), np.zeros(len(x)))
    gap = (letter == -1).astype(float)
    known, where = np.unique(letter, return_inverse=True)
    chars = ["" if c < 0 else chr(c) for c in known.tolist()]
    kinds = np.array([[bool(c) and c in special, bool(c) and unicodedata.category(c) == "Mn", c == " "] for c in chars], float).reshape(-1, 3)[where]
    told = other[line[at]].astype(float)
    base = [np.ones(len(at)), add(v) / n, add(s), s.max(1, initial=0.0), gap, *kinds.T, n_c / n, col[at] / np.maximum(1, sizes[line[at]]), told]
    by_member = [x for k in range(members) for x in (v[:, k], s[:, k], s[:, k] * told, v[:, k] * gap)]
    return _Candidates(line[at], col[at], (np.cumsum(first, 1) - 1)[at, m], letter, n_c, np.stack(base + by_member, 1))


def _of(networks: Networks, models: list[str]) -> Networks:
    """Networks of all models; a line without any column may tell of no members."""
    if len(networks.letters) and networks.letters.shape[1] != len(models):
        raise ValueError(f"lines of {networks.letters.shape[1]} members, models {models}")
    return networks if len(networks.letters) else Networks(networks.sizes, np.zeros((0, len(models)), np.int32), np.zeros((0, len(models))), np.zeros((0, len(models)), bool))


#: A row of choices() without its line's keys; `least` and `most` are the costs of the column's best and worst candidates.
CHOICE, COSTS = "col int, place int, ch string, is_gap boolean, n_c int, features array<double>", "cost int, least int, most int"


def _other(df: DataFrame, lang: str, language: str) -> Column:
    return F.coalesce(F.col(lang) == language, F.lit(False))


def choices(df: DataFrame, keys: list[str], models: list[str], *, special: str, language: str, lang: str = "lang", ref: str | None = None) -> DataFrame:
    """One row per candidate of every disputed column: keys, col, place (in first-proposed order), ch, is_gap, n_c, features and, with `ref`, cost, and least and most of the column's costs.

    Columns with one candidate need no choice and have no rows. Counts are by the number of members; positions by that of columns. A line's
    rows are made where it is, in Arrow batches.
    """

    def made(own: Networks, batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        found = _candidates(_of(own, models), batch.column("__other").to_numpy(zero_copy_only=False), special)
        d = found.features.shape[1]
        features = pa.ListArray.from_arrays(pa.array(np.arange(len(found.col) + 1) * d, pa.int32()), pa.array(found.features.ravel(), pa.float64()))
        columns = [pa.array(found.col, pa.int32()), pa.array(found.place, pa.int32()), pa.array(["" if c < 0 else chr(c) for c in found.letter.tolist()], pa.string()), pa.array(found.letter < 0), pa.array(found.n_c, pa.int32()), features]
        if ref:
            costs = forced_of(own, batch.column("__ref").to_pylist(), found.line, found.col, found.letter)
            starts = np.flatnonzero(found.place == 0)
            counts = np.diff(np.append(starts, len(costs)))
            columns += [pa.array(x, pa.int32()) for x in (costs, *(np.repeat(f.reduceat(costs, starts) if len(starts) else costs, counts) for f in (np.minimum, np.maximum)))]
        return found.line, columns

    more = [_other(df, lang, language).alias("__other"), *([text(ref).alias("__ref")] if ref else [])]
    return by_networks(df, keys, f"{CHOICE}, {COSTS}" if ref else CHOICE, made, *more)


def examples(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of columns whose candidates are not equally good, with label y: 1 where forcing a candidate costs least."""
    return chosen.where("least < most").withColumn("y", (F.col("cost") == F.col("least")).cast("double")).drop("least", "most")


@dataclass
class Scorer:
    """Weights of standardised features; the first feature is the bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: str = "features") -> Column:
        """Linear score, summed in feature order."""
        terms = [(F.col(features)[i] - float(m)) * float(w) for i, (m, w) in enumerate(zip(self.mean, self.weights / self.scale, strict=True))]
        return reduce(lambda a, t: a + t, terms, F.lit(0.0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """score() of rows of features, summed in the same order."""
        return reduce(lambda a, i: a + (x[:, i] - self.mean[i]) * (self.weights[i] / self.scale[i]), range(x.shape[1]), np.zeros(len(x)))

    def top(self, names: list[str], n: int = 10) -> list[tuple[str, float]]:
        """The features of the largest weights by size, the earlier one of equals."""
        order = sorted(range(len(self.weights)), key=lambda i: -abs(self.weights[i]))
        return [(names[i], float(self.weights[i])) for i in order[:n]]


def _problem(sums: np.ndarray) -> Scorer:
    """Mean and population deviation from (count, sum, sum of squares) of every feature; weights 0."""
    mean = sums[1] / max(sums[0, 0], 1)
    scale = np.sqrt(np.maximum(sums[2] / max(sums[0, 0], 1) - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    mean[0], scale[0] = 0.0, 1.0
    return Scorer(mean, scale, np.zeros(len(mean)))


#: A row of packed(): so many candidates at most, their d features as one matrix, feature by feature and compressed, with labels and folds. A core's cache holds it.
PACKED, PACK = "d int, x binary, y binary, fold binary", 1024


def _packs(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[pa.Array]:
    """Columns of PACKED; alike values stand beside each other, so they compress well."""
    cuts = [slice(k, k + PACK) for k in range(0, len(y), PACK)]
    columns = [[pa.compress(np.ascontiguousarray(x[c].T, np.float64).tobytes(), "zstd", asbytes=True) for c in cuts], [y[c].astype(np.float64).tobytes() for c in cuts], [fold[c].astype(np.int32).tobytes() for c in cuts]]
    return [pa.array([x.shape[1]] * len(cuts), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)]


def packed(df: DataFrame, models: list[str], *, special: str, language: str, lang: str = "lang", ref: str = "ref", fold: str = "fold") -> DataFrame:
    """examples() of df's choices() for a fit, packed where their lines are."""

    def made(own: Networks, batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        own = _of(own, models)
        found = _candidates(own, batch.column("__other").to_numpy(zero_copy_only=False), special)
        costs = forced_of(own, batch.column("__ref").to_pylist(), found.line, found.col, found.letter)
        starts = np.flatnonzero(found.place == 0)
        if not len(starts):
            return np.zeros(0, np.int64), _packs(found.features, costs, costs)
        counts = np.diff(np.append(starts, len(costs)))
        least, most = (np.repeat(f.reduceat(costs, starts), counts) for f in (np.minimum, np.maximum))
        told = least < most
        columns = _packs(found.features[told], (costs == least)[told], batch.column("__fold").to_numpy(zero_copy_only=False)[found.line[told]])
        return np.zeros(len(columns[0]), np.int64), columns

    return by_networks(df, [], PACKED, made, _other(df, lang, language).alias("__other"), text(ref).alias("__ref"), F.col(fold).cast("int").alias("__fold"))


def fit_all(rows: DataFrame, k: int, *, fold: str = "fold", descent: int = 0) -> list[Scorer | None]:
    """fit_packed() of rows (features, y, fold)."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, own = batch.columns
            yield pa.RecordBatch.from_arrays(_packs(x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 0)), y.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)), ["d", "x", "y", "fold"])

    own = rows.select("features", F.col("y").cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    return fit_packed(own.mapInArrow(packs, PACKED), k, descent=descent)


def fit_packed(rows: DataFrame, k: int, *, descent: int = 0) -> list[Scorer | None]:
    """For each of k folds the scorer that all other folds' examples, packed(), give; fold -1 is in no fold. None without rows.

    Minimises mean logistic loss plus half RIDGE times squared weights, the bias unpenalised, for all
    folds in one pass a step: Newton steps to the minimum, or `descent` plain gradient steps of
    RATE. A pass sums one matrix for each fold and partition, and partitions' matrices are added up before the driver. Features are
    standardised once for all folds; what is summed of them is brought to each fold's own means and deviations afterwards.
    """
    rows = kept(rows)
    first = rows.select("d").first()
    if first is None:
        return [None] * k
    d = first["d"]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features (feature by feature), labels and, for each fold, whether a row is outside it."""
        for x, y, own in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            x = np.frombuffer(pa.decompress(x, d * len(y), "zstd", asbytes=True)).reshape(d, -1)
            yield x, np.frombuffer(y), (np.frombuffer(own, np.int32) != np.arange(k)[:, None]).astype(float)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.stack([np.repeat(outside.sum(1)[:, None], d, 1), outside @ x.T, outside @ (x**2).T], 1) for x, _, outside in parts(batch))

    sums = summed(rows, moments, (k, 3, d), batches=True)
    found = [_problem(s) for s in sums]
    common = found[0]
    to_own = []
    for now in found:
        t = np.diag(common.scale / now.scale)
        t[0, 1:] = (common.mean - now.mean)[1:] / now.scale[1:]
        to_own.append(t)
    penalty = np.full(d, RIDGE)
    penalty[0] = 0.0
    for _ in range(descent or STEPS):
        weights = np.stack([t @ now.weights for t, now in zip(to_own, found, strict=True)], 1)

        def step(batch: pa.RecordBatch, weights: np.ndarray = weights) -> np.ndarray:
            out = np.zeros((k, 1 if descent else d + 1, d))
            for x, y, outside in parts(batch):
                z = (x - common.mean[:, None]) / common.scale[:, None]
                p = 1 / (1 + np.exp(-np.clip(weights.T @ z, -30, 30)))
                out[:, 0] += ((p - y) * outside) @ z.T
                if not descent:
                    curve = p * (1 - p) * outside
                    for f in range(k):
                        out[f, 1:] += (z * curve[f]) @ z.T
            return out

        moves = []
        for s, m, now, t in zip(summed(rows, step, (k, 1 if descent else d + 1, d), batches=True), sums, found, to_own, strict=True):
            slope = t.T @ s[0] / max(m[0, 0], 1) + penalty * now.weights
            moves.append(RATE * slope if descent else np.linalg.solve(t.T @ s[1:] @ t / max(m[0, 0], 1) + np.diag(penalty) + 1e-9 * np.eye(d), slope))
        found = [Scorer(now.mean, now.scale, now.weights - move) for now, move in zip(found, moves, strict=True)]
        if not descent and max(np.abs(move).max() for move in moves) < 1e-8:
            break
    return [scorer if m[0, 0] else None for scorer, m in zip(found, sums, strict=True)]


def fit(rows: DataFrame, descent: int = 0) -> Scorer | None:
    """The scorer of all rows (features, y)."""
    return fit_all(rows.withColumn("fold", F.lit(-1)), 1, descent=descent)[0]


def fit_lines(df: DataFrame, models: list[str], *, special: str, language: str, lang: str = "lang", ref: str = "ref") -> Scorer | None:
    """The scorer of all of df's lines."""
    return fit_packed(packed(df.withColumn("__all", F.lit(-1)), models, special=special, language=language, lang=lang, ref=ref, fold="__all"), 1)[0]


def decode(df: DataFrame, chosen: DataFrame, keys: list[str], scorers: list[Scorer | None], fold: str | None = None, constrain: bool = True) -> DataFrame:
    """(keys.., text) of df (with `network`): in every disputed column the best-scored candidate, the earlier one of equals.

    `chosen` are df's choices(). The scorer is that of the row's fold, or the only one; without one the share of members decides.
    """
    by = [s.score() if s else F.col("features")[1] for s in scorers]
    score = reduce(lambda rest, f: F.when(F.col(fold) == f, by[f]).otherwise(rest), range(len(by) - 1), by[-1]) if fold else by[0]
    best = chosen.withColumn("__s", score).groupBy(*keys, "col").agg(F.max(F.struct("__s", (-F.col("place")).alias("p"), "ch")).alias("b"))
    lines = best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("b.ch").alias("ch")))).alias("__c"))
    whole = F.array_join(F.expr("transform(network, (cells, j) -> coalesce(__c[j], cells[0].ch))"), "")
    return df.join(lines, keys, "left").select(*keys, (constrained(whole) if constrain else whole).alias("text"))


def decoded(df: DataFrame, keys: list[str], models: list[str], scorers: list[Scorer | None], *, special: str, language: str, lang: str = "lang", fold: str | None = None, constrain: bool = True) -> DataFrame:
    """decode() of df under its choices(), which are made, scored and put into their line where it is."""

    def made(networks: Networks, batch: pa.RecordBatch) -> tuple[None, list[pa.Array]]:
        networks = _of(networks, models)
        found = _candidates(networks, batch.column("__other").to_numpy(zero_copy_only=False), special)
        own = np.where((own := batch.column("__fold").to_numpy(zero_copy_only=False)) < len(scorers), own, len(scorers) - 1)[found.line]
        score = np.empty(len(own))
        for f in np.unique(own).tolist():
            x, scorer = found.features[own == f], scorers[f]
            score[own == f] = scorer.scores(x) if scorer else x[:, 1]
        starts = np.flatnonzero(found.place == 0)
        chosen = networks.letters[:, 0].copy()
        if len(starts):
            column = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(score))))
            best = np.flatnonzero(score == np.maximum.reduceat(score, starts)[column])
            best = best[np.unique(column[best], return_index=True)[1]]  # the earlier one of equals
            chosen[(np.cumsum(networks.sizes) - networks.sizes)[found.line[best]] + found.col[best]] = found.letter[best]
        texts = networks.texts(chosen)
        return None, [pa.array([constrained_line(t) for t in texts] if constrain else texts, pa.string())]

    own_fold = F.coalesce(F.col(fold).cast("int"), F.lit(len(scorers) - 1)) if fold else F.lit(0)
    return by_networks(df, keys, "text string", made, _other(df, lang, language).alias("__other"), own_fold.alias("__fold"))


def cross_validated(df: DataFrame, keys: list[str], models: list[str], *, special: str, language: str, ref: str = "ref", fold: str = "fold", k: int = 5, descent: int = 0) -> DataFrame:
    """(keys.., text): df decoded in every fold by a scorer fitted on the choices of the others; `fold` is one of the keys."""
    examples_ = packed(df, models, special=special, language=language, ref=ref, fold=fold)
    return decoded(df, keys, models, fit_packed(examples_, k, descent=descent), special=special, language=language, fold=fold)
