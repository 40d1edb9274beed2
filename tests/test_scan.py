"""Scans of sequences that lie in many ranges, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtext.operators import scan


@pytest.fixture(params=[1, 7])
def parts(request, spark):
    """Few rows in many ranges, and all in one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def sequences(rnd):
    """Groups of very different lengths, one of them null."""
    return {g: [(rnd.choice([0, 1, 1, 2, None]), rnd.choice([None, 1.0, 2.0, 3.0, 4.0, 0.5])) for _ in range(n)] for g, n in {0: 90, 1: 1, 2: 7, None: 12}.items()}


def frame(spark, found):
    rows = [(g, i, s, v) for g, own in found.items() for i, (s, v) in enumerate(own)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g int, i int, symbol int, conf double").repartition(3)


def test_runs(spark, parts):
    found = sequences(random.Random(2))
    want = []
    for g, own in found.items():
        start = None
        for i, (s, _) in enumerate([*own, (0, None)]):
            if s == 1 and start is None:
                start = i
            elif s != 1 and start is not None:
                want.append((g, start, i))
                start = None
    got = scan.runs(frame(spark, found), "g", "i", F.col("symbol").eqNullSafe(F.lit(1))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_symbol_runs(spark, parts):
    found = sequences(random.Random(3))
    want = []
    for g, own in found.items():
        run, left, best = 0, object(), {}
        for s, c in own:
            run += s != left
            left = s
            if s not in (0, None):
                best.setdefault((run, s), []).append(c)
        want += [(g, r, s, max((c for c in cs if c is not None), default=None)) for (r, s), cs in best.items()]
    got = scan.symbol_runs(frame(spark, found), "g", "i").select("g", "run", "symbol", "conf").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("k, block", [(1, 1), (3, 4), (4, 4), (5, 8), (40, 3)])
def test_smoothed(spark, parts, k, block):
    found = {g: [(s, v or 0.0) for s, v in own] for g, own in sequences(random.Random(4)).items()}
    rows = scan.smoothed(frame(spark, found), "conf", "g", "i", k, block=block).collect()
    for g, own in found.items():
        # numpy's same mode trims to the longer of both, so windows longer than a sequence are summed by hand.
        values = [v for _, v in own]
        want = [sum(values[max(0, i - k // 2) : i + (k - 1) // 2 + 1]) / k for i in range(len(values))]
        assert np.allclose([r["smooth"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["i"])], want)


def test_best_so_far(spark, parts):
    found = sequences(random.Random(5))
    rows = scan.best_so_far(frame(spark, found), "g", "i", "conf", 3).collect()
    assert len(rows) == sum(map(len, found.values()))
    for g, own in found.items():
        best, misses, stopped, want = None, 0, False, []
        for n, (_, v) in enumerate(own):
            improved = v is not None and (best is None or v < best)
            improved_or_first = improved or n == 0
            best = v if improved else best
            misses = 0 if improved_or_first else misses + 1
            want.append((best, misses, stopped))
            stopped = stopped or misses >= 3
        got = [(r["best"], r["misses"], r["stopped"]) for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["i"])]
        assert got == want


def test_nothing(spark):
    df = frame(spark, {0: [(1, 1.0)]}).limit(0)
    assert scan.runs(df, "g", "i", F.col("symbol") == 1).collect() == scan.symbol_runs(df, "g", "i").collect() == scan.smoothed(df, "conf", "g", "i", 3).collect() == scan.best_so_far(df, "g", "i", "conf", 2).collect() == []
