"""Conversation repair, repeats and resampling against brute force, with odd rows of every kind."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtext.llm import repair, repeats, resample

# --- repair ---------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, repaired turns) over all edits, up to two insertions before every row, from the end."""

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in repair.ACCEPTED:
            options.append((0, "", ()))
        if inserted < 2:
            for (s, letter), to in repair.NEXT.items():
                if s == state and letter in repair.ROLES:
                    options.append(joined(5, "I", (f"{repair.ROLES[letter]}:",), best(i, to, inserted + 1)))
        if i < len(rows):
            role, text, gone, truncated = rows[i]
            options.append(joined(2, "D", (), best(i + 1, state, 0)))
            for (s, letter), to in repair.NEXT.items():
                if s == state and not gone:
                    late = 5 * truncated
                    if role[:1] == letter:
                        options.append(joined(late, "K", (f"{role}:{text}",), best(i + 1, to, 0)))
                    if letter in repair.ROLES:
                        options.append(joined(1 + late, "R", (f"{repair.ROLES[letter]}:{text}",), best(i + 1, to, 0)))
        return min((o for o in options if o), default=None)

    def joined(cost, edit, said, rest):
        return rest and (cost + rest[0], edit + rest[1], said + rest[2])

    return best(0, 0, 0)


def repaired(rows):
    """What repair() should say of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    counts, seen, turns = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit, said = cheapest(tuple(turns))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repair(spark, given):
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, cost string, conv string, at int")
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in repair.repair(df).collect()}
    groups = {}
    for c, t, r, x, *_ in given:
        groups.setdefault(c, []).append((t, r, x))
    assert got == {c: repaired(rows) for c, rows in groups.items()}


@pytest.mark.parametrize("bits", [1, 8])
def test_repair_equals_all_edits(spark, monkeypatch, bits):
    """Short and long segments; null keys, turns, roles and texts, odd roles, ties, repeated rows and clashing columns."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rnd = random.Random(bits)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "useless", "Assistant"], ["Yes.", "No", "", None, "\t\n", "Ok! ", "a ", "b. ", "Hm?\x0b"]
    rows = []
    for c in [*range(25), None]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t + 2, None]), rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts) if rnd.random() < 0.4 else f"Text {c} {t}.", "x", "y", 1))
        if rnd.random() < 0.3:
            rows.append(rows[-1])
    long = [(99, t, rnd.choice(roles[:3]), rnd.choice(["Fine.", "no", f"Turn {t}!"]), None, None, None) for t in range(60)]
    check_repair(spark, rows + long)


def test_repair_of_nothing_and_of_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []
    given = spark.createDataFrame([(1, 0, "user", "a."), (2, None, None, None)], schema)
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in repair.repair(given.limit(0), conversations=given).collect()}
    empty = hashlib.sha256().hexdigest()
    assert got == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 0, 0, 0, 0, 0, "", empty)}


def test_damage(spark):
    given = [(c, t, r, x) for c in (1, None) for t in (*range(30), None) for r, x in (("assistant", "a.b!"), (None, None))]
    got = sorted(map(repr, map(tuple, repair.damaged(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, r, x in given:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        r, x = "user" if fault == 4 else r or " ", "" if fault == 1 else x or " "
        x = re.sub("[.!?]", "", x) if fault == 2 else x
        want += [repr((c, t, r, x))] * {0: 0, 3: 2}.get(fault, 1)
    assert got == sorted(want)


# --- repeats --------------------------------------------------------------------------------------


def without_repeats(docs, size):
    """Results by comparing all windows; docs is a list of (order, text)."""
    seen, out = {}, {}
    split = {o: (t or "").encode().split() for o, t in docs}
    for o in sorted(split):
        w = split[o]
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), (o, i))
    for o, w in split.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] != (o, i):
                gone |= set(range(i, i + size))
        runs, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and j in gone:
                j += 1
            if j > i:
                runs.append((i, j - i))
            i = max(j, i + 1)
        out[o] = (len(w), len(gone), runs, b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def texts_with_repeats(rnd, n, words, longest):
    passages = [" ".join(rnd.choices(words, k=rnd.randint(4, 14))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choices(words, k=rnd.randint(0, 8))) for _ in range(rnd.randint(0, longest))]
        out.append(rnd.choice([" ", "\n\t", "  "]).join(parts))
    return out + [rnd.choice(out) for _ in range(n // 3)]


def found_in(df, size, seed):
    return [(r[0], (r["n_words"], r["n_removed"], [tuple(x) for x in r["repeats"]], r["kept"])) for r in repeats.without_repeats(df, size, seed=seed).collect()]


@pytest.mark.parametrize("size, seed, words", [(5, 2, "ab"), (6, 3, "abcdefgh"), (6, 6, "abc"), (20, 8, "abcdefghij")])
def test_repeats_equal_all_windows(spark, monkeypatch, size, seed, words):
    """Few words, so that anchors are common, windows overlap and texts repeat within themselves."""
    monkeypatch.setattr(repeats, "STEP", 7)
    rnd = random.Random(size)
    docs = list(enumerate(texts_with_repeats(rnd, 40, list(words), 6)))
    rnd.shuffle(docs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, no string, g int").repartition(5)
    assert dict(found_in(df, size, seed)) == without_repeats(docs, size)


def test_repeats_of_hot_anchors(spark, monkeypatch):
    """A seed in every document, with other surroundings each time, and dealt as hot."""
    monkeypatch.setattr(repeats, "_hot", lambda docs, size, seed: np.array([r["g"] for r in repeats.anchors(docs, size, seed, np.zeros(0, np.int64)).select("g").distinct().collect()], np.int64))
    rnd = random.Random(2)
    docs = [(i, " ".join([*rnd.choices("pqr", k=rnd.randint(0, 4)), *"abcde", *rnd.choices("pqr", k=4)])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert dict(found_in(df, 6, 3)) == without_repeats(docs, 6)


def test_repeats_of_odd_rows(spark):
    """Nulls, repeated rows, ids with several texts, ids of text, very long words, other white space and an empty table."""
    a, b = "a b c d e f g", "x y a b c d e f   h" + " " + "w" * 5000
    schema = "doc_id long, text string"
    rows = [(1, a), (1, a), (2, None), (3, ""), (None, a), (4, b), (5, a + " " + a), (6, "a\x1cb c d e f g h i")]
    got = found_in(spark.createDataFrame(rows, schema), 5, 2)
    order = {(1, a): 0, (2, None): 1, (3, ""): 2, (4, b): 3, (5, rows[6][1]): 4, (6, rows[7][1]): 5, (None, a): 6}
    want = without_repeats([(o, t) for (_, t), o in order.items()], 5)
    assert sorted(map(repr, got)) == sorted(repr((i, want[order[i, t]])) for i, t in rows)
    # Rows that share an id alone stand in the order of a hash of their texts.
    shared = [(7, "k " + a), (7, a + " l")]
    df = spark.createDataFrame(shared, schema)
    marks = {r["text"]: r["m"] for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
    want = without_repeats([(marks[t], t) for _, t in shared], 5)
    assert sorted(repr(x) for _, x in found_in(df, 5, 2)) == sorted(map(repr, want.values()))
    named = spark.createDataFrame([("b", a), ("a", a)], "doc_id string, text string")
    assert {i: x[1] for i, x in found_in(named, 5, 2)} == {"a": 0, "b": 7}
    assert found_in(spark.createDataFrame([], schema), 5, 2) == []
    with pytest.raises(ValueError):
        repeats.without_repeats(df, 5, seed=6)


# --- resampling -----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features_of(text, n, buckets):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def resampled(docs, target, n, buckets, percent, least):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features_of(text, n, buckets)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features_of(text, n, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted(repr(tuple(r[:5])) for r in rows)


@pytest.mark.parametrize("n, chunk", [(1, 1 << 16), (1, 24), (3, 24), (2, 1 << 16)])
def test_resampling_equals_brute_force(spark, n, chunk):
    """Texts of one chunk and of many, nulls, repeated rows, words longer than a chunk, letters beyond ASCII."""
    rnd = random.Random(n)
    words = ["Ab", "ab", "éa", "x9", "-", "zz", "q" * 40, "ñ", "a b"]
    docs = [(i, rnd.choice([" ", ", ", "--"]).join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(60)] + [(None, "ab x9 " * 5), (100, None), (101, ""), (102, "...")]
    docs += [docs[3], docs[3], docs[60]]
    target = ["ab zz x9 ab", None, "", "É éa " * 9]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, weight string").repartition(3)
    other = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resample.resample(df, other, n=n, buckets=50, percent=30, least_words=6, chunk=chunk)
    assert sorted(repr(tuple(r)) for r in got.collect()) == resampled(docs, target, n, 50, 30, 6)


def test_resampling_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    assert resample.resample(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in resample.resample(one, items, least_words=1, percent=100, buckets=10).collect()][0][4] == 1


def test_chunks_own_every_word_once():
    rnd = random.Random(4)
    for _ in range(200):
        data = " ".join("x" * rnd.randint(0, 9) for _ in range(rnd.randint(0, 20))).encode()
        for n in (1, 2, 4):
            words, own, runs = data.split(), [], []
            for piece, k in resample.chunks(data, rnd.randint(1, 12), n):
                w = piece.split()
                own += w[:k]
                runs += [w[i : i + m] for m in range(1, n + 1) for i in range(min(k, len(w) - m + 1))]
            assert own == words and sorted(runs) == sorted(words[i : i + m] for m in range(1, n + 1) for i in range(len(words) - m + 1))
