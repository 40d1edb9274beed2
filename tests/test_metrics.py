import pytest
from pyspark.sql import functions as F

from quorumtext.functions import text as T
from quorumtext.operators import metrics, selection


def one(spark, refs_hyps, aggregate):
    return spark.createDataFrame(refs_hyps, "ref string, hyp string").agg(aggregate.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, n", [("kitten", "sitting", 3), ("", "abc", 3), (None, "ab", 2), ("éé", "ee", 2), ("same", "same", 0)])
def test_char_distance(spark, a, b, n):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.char_distance("a", "b")).first()[0] == n


def test_corpus_rate_is_no_mean(spark):
    assert one(spark, [("abcdefghij", "abcdefghiX"), ("ab", "aX")], metrics.cer("ref", "hyp")) == pytest.approx(2 / 12)
    assert one(spark, [("", "")], metrics.cer("ref", "hyp")) == 0.0
    assert one(spark, [], metrics.cer("ref", "hyp")) == 0.0


def test_word_rate(spark):
    assert one(spark, [("a b c", "a b X")], metrics.wer("ref", "hyp")) == pytest.approx(1 / 3)
    assert one(spark, [("a b", "a b")], metrics.wer("ref", "hyp")) == 0.0
    assert one(spark, [("a", "x y z")], metrics.wer("ref", "hyp")) == 3.0


def test_restricted_rate(spark):
    c = T.SPECIAL[0] + T.SPECIAL[5]
    assert one(spark, [(f"a{c}b", "ab")], metrics.restricted_cer("ref", "hyp", T.SPECIAL)) == 1.0


def test_distances_against_brute_force(spark):
    import random

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(3)
    rows = [("".join(rnd.choices("ab éَ ", k=rnd.randint(0, 12))), "".join(rnd.choices("ab éَ ", k=rnd.randint(0, 12)))) for _ in range(80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.char_distance("a", "b").alias("c"), T.token_distance("a", "b").alias("t")).collect()
    for r in got:
        assert r["c"] == brute(r["a"], r["b"]) and r["t"] == brute(r["a"].split(), r["b"].split())
        for first in (False, True):
            places = metrics.error_positions(r["a"], r["b"], first)
            assert len(places) <= r["c"] and all(k in ("sub", "del", "ins") for k, _ in places)


def test_insertions_at_one_place_are_one():
    assert metrics.error_positions("ab", "aXYb") == [("ins", 1)]


def test_improvements_and_counts(spark):
    df = spark.createDataFrame([("1", "abcd", "axxd", "abcd"), ("2", "ab", "ab", "ab"), ("3", "ab", "ab", "xb")], "id string, ref string, base string, best string")
    picks = [(r["kind"], r["id"]) for r in metrics.improvements(df, "base", "best", "id", 1, 1).collect()]
    assert picks == [("better", "1"), ("worse", "3")]
    assert tuple(metrics.improvement_counts(df, "base", "best").first()) == (1, 1, 1, 1)


def test_bootstrap_is_repeatable_and_signed(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("abcdef").alias("ref"), F.when(F.col("id") % 3 == 0, "abXdef").otherwise("abcdef").alias("a"), F.lit("XbcdeX").alias("b"))
    r = metrics.bootstrap(df, "a", "b", "id", reps=200).first()
    assert r["mean_diff"] == pytest.approx((100 - 600) / 1800, abs=0.02) and r["low"] < r["mean_diff"] < r["high"] and r["share_below"] == 1.0
    again = metrics.bootstrap(df.repartition(7), "a", "b", "id", reps=200).first()
    assert again["mean_diff"] == pytest.approx(r["mean_diff"])


def test_overlap(spark):
    df = spark.createDataFrame([("1", "abcd", 0, "m", "Xbcd"), ("1", "abcd", 1, "n", "XbcY")], "line string, ref string, member int, model string, hyp string")
    r = metrics.error_overlap(df, "line").first()
    assert (r["model_a"], r["both"], r["either"], r["jaccard"]) == ("m", 1, 2, 0.5)


def test_protocol_and_subsets(spark):
    df = spark.createDataFrame([("abc", "abX", "abc")], "ref string, m string, n string")
    found = selection.protocol(df, ["m", "n"], {"first": lambda d, ms: d.withColumn("hyp", F.col(ms[0])), "last": lambda d, ms: d.withColumn("hyp", F.col(ms[-1]))})
    assert [f["method"] for f in found] == ["last", "first"]


def test_part_and_confidence(spark):
    df = spark.createDataFrame([("abc", [0.1]), ("a", [0.1, 0.2]), (None, None)], "t string, c array<double>")
    assert [r[0] for r in df.select(T.padded_confidence("c", "t")).collect()] == [[0.1, 0.5, 0.5], [0.1], []]
    with pytest.raises(ValueError):
        T.in_part("s", "i", "dev")


def test_distances_of_many_pairs_together():
    """Pairs of all sizes around the words of bits, compared at once, have the distances of whole tables."""
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(1)
    made = lambda: ["".join(rnd.choices("abé😀", k=rnd.choice((0, 1, 5, 63, 64, 65, 128, 129)))) for _ in range(60)]
    a = made()
    b = [y if k % 2 else x[3:50] + "b" + x[51:] for k, (x, y) in enumerate(zip(a, made(), strict=True))]
    assert T.distances(a, b).tolist() == [table(x, y) for x, y in zip(a, b, strict=True)]


def test_long_and_missing_texts_beside_lines(spark):
    rows = [(1, "a" * 300, "a" * 299 + "b"), (2, None, "xy"), (3, "kitten", "sitting"), (4, "", ""), (5, "a" * 256, "b")]
    got = spark.createDataFrame(rows, "i int, a string, b string").orderBy("i").select(T.char_distance("a", "b")).collect()
    assert [r[0] for r in got] == [1, 2, 3, 0, 256]
