"""Alignment in linear memory: equal to whole tables, and to edits walked back cell by cell."""

import random
import tracemalloc

import numpy as np

from quorumtext.operators import alignment, metrics, network, script


def whole(profile, seq):
    column, character, count = alignment._steps_back(alignment.tables(profile[None], seq[None]), np.array([profile.shape[1]]), np.array([len(seq)]))
    return column[0, : count[0]].tolist(), character[0, : count[0]].tolist()


def walked(ref, hyp, insertion_first):
    """Pairs of places by the full table, from the end."""
    table = [[i + j if not i * j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            table[i][j] = min(table[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
    i, j, out = len(ref), len(hyp), []
    while i or j:
        both = i and j and table[i][j] == table[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1])
        delete, insert = i and table[i][j] == table[i - 1][j] + 1, j and table[i][j] == table[i][j - 1] + 1
        if both:
            i, j = i - 1, j - 1
            out.append([i, j])
        elif delete and not (insertion_first and insert):
            i -= 1
            out.append([i, -1])
        else:
            j -= 1
            out.append([-1, j])
    return out[::-1]


def test_divided_tables_keep_every_choice():
    rnd = random.Random(1)
    for _ in range(800):
        members, columns, n = rnd.choice([1, 2, 3]), rnd.randint(0, 14), rnd.randint(0, 14)
        profile = np.array([[rnd.choice([-1, 1, 2, 3]) for _ in range(columns)] for _ in range(members)], dtype=np.int32).reshape(members, columns)
        profile[0, (profile == -1).all(0)] = 1  # no column is all gaps
        seq = np.array([rnd.choice([1, 2, 3]) for _ in range(n)], dtype=np.int32)
        column, character = alignment.divided(profile, seq, part=rnd.choice([1, 10, 60, 10**6]), band=rnd.choice([1, 2, 64]))
        assert (column.tolist(), character.tolist()) == whole(profile, seq)


def test_edits_equal_the_walk_through_the_table():
    rnd = random.Random(2)
    refs, hyps = (["".join(rnd.choices("abé", k=rnd.randint(0, 11))) for _ in range(200)] for _ in range(2))
    for first in (False, True):
        assert [p.tolist() for p in alignment.letter_pairs(refs, hyps, first)] == [walked(r, h, first) for r, h in zip(refs, hyps, strict=True)]


def test_long_lines_need_little_memory(monkeypatch):
    rnd = random.Random(3)
    ref = "".join(rnd.choices("abcdefgh ", k=33_047))
    hyp = "".join(c for c in ref if rnd.random() > 0.001)
    tracemalloc.start()
    pairs = alignment.letter_pairs([ref], [hyp])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    both = (pairs >= 0).all(1)
    assert all(ref[i] == hyp[j] for i, j in pairs[both]) and (pairs[:, 0] >= 0).sum() == len(ref) and (pairs[:, 1] >= 0).sum() == len(hyp)
    # Lines beyond a pass are divided like others.
    short = [["abcabcab", "abcbcaab", "bcabab"]] * 2
    expected = network.merged_columns(short, [(0, 1)] * 2)
    monkeypatch.setattr(alignment, "CELLS", 10)
    assert [x.tolist() for x in network.merged_columns(short, [(0, 1)] * 2)] == [x.tolist() for x in expected]


def test_costs_of_long_lines_need_little_memory():
    rnd = random.Random(4)
    ref = "".join(rnd.choices("abcd", k=3_000))
    columns = [c + (rnd.choice("abcd") if rnd.random() < 0.1 else "") for c in ref]
    tracemalloc.start()
    costs = network.candidate_costs([columns], [ref])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and network.oracle_costs([columns], [ref]) == [0] and all(min(c) == 0 for c in costs)


def test_wrong_letters_and_places():
    assert script.wrong_letters(["abc", "abcd", "ab", "ab", "", ""], ["abc", "bxd", "abcc", "", "x", ""]) == [
        ([False] * 3, [0] * 4), ([False, True, False], [1, 0, 0, 0]), ([False, False, True, True], [0] * 5), ([], [2]), ([True], [0, 0]), ([], [0]),
    ]
    assert metrics.error_positions("ab", "aXYb") == [("ins", 1)] and metrics.error_positions("abc", "xc") == [("del", 0), ("sub", 1)]


def test_edit_counts_of_odd_rows(spark):
    rows = [("a", "a"), (None, "ab"), ("ab", None), ("", ""), (None, None), ("a", "a")]
    got = spark.createDataFrame(rows, "ref string, hyp string").select(metrics.edit_counts("ref", "hyp").alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 2), (0, 2, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_tables_hold_a_band_and_give_the_whole_tables_ways():
    random = np.random.default_rng(3)
    lines = []
    for k in range(60):
        t = "".join(random.choice(list("abcd "), 300))
        lines.append([t.replace("a", "x") if k % 2 else t[1:], t, t.replace("b", "")[:280] if k % 7 == 0 else t[:100] + "q" + t[100:]])
    sizes, whole = [], alignment.tables

    def seen(*args):
        moves, begin = whole(*args)
        sizes.append(moves.nbytes / moves.shape[1])
        return moves, begin

    alignment.tables = seen
    try:
        narrow = alignment.merged_columns(lines, [(0, 1)] * len(lines))
    finally:
        alignment.tables = whole
    assert min(sizes) < 301 * 301 / 8
    bounds, alignment.cost_bounds = alignment.cost_bounds, lambda profile, seq, size, length: np.full(len(size), 1000.0)
    try:
        wide = alignment.merged_columns(lines, [(0, 1)] * len(lines))
    finally:
        alignment.cost_bounds = bounds
    assert all(np.array_equal(a, b) for a, b in zip(narrow, wide, strict=True))


def test_texts_that_differ_in_letters_of_their_own_need_no_table(monkeypatch):
    """Such lines are aligned as tables would, without one; so are their distances."""
    from quorumtext.functions import text

    rnd = random.Random(17)
    lines = []
    for _ in range(300):
        ref = "".join(rnd.choices("aab c", k=rnd.randint(1, 12)))
        other = ref[rnd.choice([0, 0, 1, 2]) :].translate({97: "x"} if rnd.random() < 0.7 else {97: "b"})
        lines.append([other, ref] if rnd.random() < 0.5 else [ref, other])
    with monkeypatch.context() as without:
        without.setattr(alignment, "straight", lambda line, letters, n: np.zeros(n, bool))
        want = alignment.merged_columns(lines, [(0, 1)] * len(lines))
    assert [x.tolist() for x in alignment.merged_columns(lines, [(0, 1)] * len(lines))] == [x.tolist() for x in want]
    a, b = [x for x, _ in lines], [x for _, x in lines]
    assert text.distances(a, b).tolist() == text.tabled(a, b).tolist() == [text.distance(x, y) for x, y in lines]
    own = [["xbc" * 40, "abc" * 40], ["bxc" * 30, "abac" * 30][:1] + ["b" + "ayc" * 20]]
    monkeypatch.setattr(alignment, "_merge", None)
    monkeypatch.setattr(text, "tabled", None)
    assert len(alignment.merged_columns(own[:1], [(0, 1)])[0]) == 120 and text.distances(*([x] for x in own[0])).tolist() == [40]
