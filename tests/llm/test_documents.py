"""Operators on documents against brute force, and their defined results for odd rows."""

import hashlib
import json
import random
import re
import tracemalloc

import pytest

from quorumtext.llm import bpe, decontaminate, minhash, queries, sharding, unigram
from quorumtext.llm.common import components

DOCS = "doc_id long, text string, size string, mark string, words string"
LONG = "Lorem ipsum dolor " * 4000


def table(spark, texts):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three four"), (6, LONG), (7, LONG), (8, "one two three four")]


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 6)))
    out = []
    for g in range(12):
        base = [word() for _ in range(rnd.randint(3, 80))]
        for _ in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            out.append((len(out), " ".join(own)))
    return out


def groups(texts, size, threshold):
    sets = {}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t.lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("size, threshold", [(3, 85), (5, 80)])
def test_near_duplicates(spark, prose, size, threshold):
    sets, label = groups(prose, size, threshold)
    got = minhash.near_duplicates(table(spark, prose), size=size, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_blocks_find_links_that_heads_miss(spark):
    # A chain: neighbours are linked, ends are not.
    words = [f"w{i}" for i in range(60)]
    chain = [(k, " ".join([f"x{j}" for j in range(k * 3)] + words[k * 3 :])) for k in range(4)]
    _, label = groups(chain, 3, 85)
    got = minhash.near_duplicates(table(spark, chain), size=3, threshold=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, ODD), size=3, threshold=85).collect()))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [g[1:] for g in got if g[0] == 4] == [(1, 4, True)] * 2 and [g for g in got if g[0] == 0] == [(0, 0, None, True)]
    assert [(g[2], g[3]) for g in got if g[0] in (6, 7)] == [(6, True), (6, False)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    twice = [(1, "a b c d"), (5, "a b c d"), (5, "e f g h"), (5, ""), (3, "e f g h"), (5, "i j k l")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, twice), size=3).collect()}
    assert got == {(1, 2, 1, True), (5, 2, 1, False), (5, 2, 3, False), (5, 0, 5, True), (3, 2, 3, True), (5, 2, 5, True)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 30), (30, 31), (31, 32), (32, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 31: 1, 32: 1, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- tokenizers -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def test_encoding_equals_the_library(spark, prose, reference):
    rnd = random.Random(1)
    letters = "abcdeéßñ 0123'\n\t,.!?<|endoftext|>日本語😀क्\r²½'s've ABC"
    texts = [t for _, t in prose] + ["".join(rnd.choices(letters, k=rnd.randint(0, 150))) for _ in range(300)]
    newer = "".join(chr(c) for a, b in bpe.LATER for c in (a, b)) + "\u0378\U000e0fff\u1c89\U00010d4a"
    texts += ["".join(rnd.choices(letters + newer, k=rnd.randint(0, 40))) for _ in range(200)] + [newer, "a" + newer, " 1".join(newer)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "aaaa" * 200, " " * 300, "\n" * 40 + "x", "don't we'll I'VE", "abc" * 1000]
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = table(spark, list(enumerate(texts)))
    want = {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in bpe.encode(rows, path).collect()}
    assert all(list(got[i]["ids"]) == want[i] and got[i]["round_trip"] for i in want)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(rows, path), path).collect()}
    assert back == dict(enumerate(texts))
    for r in bpe.digests(rows, path).collect():
        ids = want[r["doc_id"]]
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_of_odd_rows(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    got = [(r["doc_id"], len(r["ids"])) for r in bpe.encode(table(spark, ODD), path).collect()]
    assert len(got) == len(ODD) and (1, 0) in got and (2, 0) in got and got.count((4, 1)) == 2
    assert bpe.encode(table(spark, []), path).count() == bpe.digests(table(spark, []), path).count() == 0
    broken = spark.createDataFrame([(1, [172]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe.decode(broken, path).orderBy("doc_id").collect()] == ["�", None, ""]


def brute_tokens(word, logp, byte):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        ways = [(best[e - 1][0] + size * byte, best[e - 1][1] + size)] + [(best[b][0] + logp[word[b:e]], best[b][1] + 1) for b in range(e) if word[b:e] in logp]
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    return best[-1][1]


def test_token_counts(spark, prose):
    path = queries.tokenizer("piece_bpe_32k.model")
    with open(path, "rb") as f:
        trie = unigram.loaded(f.read())
    texts = prose + [(900, "日本 x"), (901, "a\n\nb  c")]
    for r in unigram.token_counts(table(spark, texts), path).collect():
        t = dict(texts)[r["doc_id"]]
        pieces = unigram.pretokens(t)
        assert "".join(pieces) == unigram.SPACE + t.replace(" ", unigram.SPACE)
        assert r["n_tokens"] == sum(brute_tokens(p, trie.logp, trie.byte) for p in pieces) and r["n_pretokens"] == len(pieces)
    odd = unigram.token_counts(table(spark, ODD), path).collect()
    assert len(odd) == len(ODD) and [r["n_tokens"] for r in odd if r["doc_id"] in (1, 2)] == [0, 0]
    assert unigram.token_counts(table(spark, []), path).count() == 0


def test_a_worker_keeps_few_bytes_of_many_words():
    """What stays of several batches of new words is bounded: a worker shares an executor's memory with the stages before."""
    spec = bpe.tokenizer_spec(queries.tokenizer("byte_bpe_50k.json"))
    rnd = random.Random(4)
    words = bpe.Trie(bpe.Vocabulary(json.loads(spec)))
    tracemalloc.start()
    for _ in range(6):
        words.add({"".join(rnd.choices("abcdeginorst", k=8)) for _ in range(45_000)})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 92 << 20


def test_long_words_take_memory_in_proportion(reference):
    """Words without a break: ids and counts as ever, and no memory that grows with the square of their length."""
    rnd = random.Random(8)
    word = "".join(rnd.choices("abcdeginorst", k=20_000))
    spec = bpe.tokenizer_spec(queries.tokenizer("byte_bpe_50k.json"))
    with open(queries.tokenizer("piece_bpe_32k.model"), "rb") as f:
        pieces = unigram.loaded(f.read())
    words = bpe.loaded(spec)[1]
    tracemalloc.start()
    words.add({word})
    pieces.add({word})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    assert [int(i) for i in words.seen[word][0].split(",")] == reference.encode(word, add_special_tokens=False).ids
    for n in (63, 64, 65, 300):
        short = "".join(rnd.choices("abeinrst日é", k=n))
        pieces.add({short})
        assert pieces.counts[short] == brute_tokens(short, pieces.logp, pieces.byte)
        assert bpe.encode_texts([short], spec) == [reference.encode(short, add_special_tokens=False).ids]
    words.add({"next"})
    pieces.add({"next"})
    assert word not in words.seen and word not in pieces.counts


# --- sharding -------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, prose):
    rows = prose + [(7, "same")] * 500
    got = sharding.assign(table(spark, rows), 5, bins=256, virtual_nodes=8).toPandas()
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == len(rows) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()


def test_odd_rows_have_a_shard(spark):
    import zlib

    got = sharding.assign(table(spark, ODD), 3).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 4} == {zlib.crc32(b"one")}
    assert sharding.assign(table(spark, []), 3).count() == 0


def test_overflow_goes_clockwise_and_little_moves():
    owner = sharding.owners(10, 64, 4096)
    assert set(owner) == set(range(10))
    flows = sharding.settle([(0, 10), (1, 0), (2, 3)], [0, 1, 1], [4, 9])
    assert flows == [[(0, 4), (1, 6)], [], [(1, 3)]]
    more = sharding.owners(11, 64, 4096)
    moved = [b for b in range(4096) if owner[b] != more[b]]
    assert all(more[b] == 10 for b in moved) and len(moved) < 4096 * 0.2


# --- decontamination ------------------------------------------------------------------------------


def brute_hits(docs, items, size):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, names = find(t), set(), set()
        for item, x in items:
            y = find(x)
            n = min(size, len(y))
            for k in range(len(y) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == y[k : k + n]:
                        hit |= set(range(p, p + n))
                        names |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:  # as if nothing were small enough, and every word of a hundredth frequent
        monkeypatch.setattr(decontaminate, "fits", lambda *_: False)
        monkeypatch.setattr(decontaminate, "sized", lambda df, *_: df)
        monkeypatch.setattr(decontaminate, "FREQUENT", 100)
    rnd = random.Random(8)
    vocabulary = ["the", "of", "a"] * 6 + [f"w{i}é" for i in range(40)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(k, text(rnd.randint(1, 40)) if k % 4 else text(3)) for k in range(25)] + [(30, None), (31, "!!"), (3, text(15)), (40, "the of the of the of the of the of the of"), (None, "w1é the w2é of w3é a w4é the w5é of w6é")]
    docs = []
    for i in range(80):
        parts = [text(rnd.randint(0, 30))]
        if i % 2:
            x = (rnd.choice(items)[1] or "").split()
            b = rnd.randint(0, max(0, len(x) - 12))
            parts += [" ".join(x[b : b + rnd.randint(5, 30)]).upper().replace("É", "é"), text(5)]
        docs.append((i, ", ".join(parts)))
    docs += [(81, items[-1][1] + " the"), (1, None), (2, ""), (None, docs[1][1]), (5, docs[5][1]), (90, "the of " * 300)]
    rows = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(table(spark, docs), rows, size=10).collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items, 10)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.report(table(spark, ODD), none).collect())
    assert decontaminate.report(table(spark, []), none).count() == 0


def test_proximity(spark):
    docs = table(spark, [(1, "red big house by the lake"), (2, "house one two three four five six seven red big"), (3, None)])
    items = spark.createDataFrame([(7, "big red house"), (8, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity_matches(docs, items, 1).collect()}
    assert found == {(1, 7)}
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choices("abcdefg", k=60))) for i in range(12)]
    phrases = [(k, " ".join(rnd.choices("abcdefgz", k=rnd.randint(1, 4)))) for k in range(12)]
    got = {tuple(r) for r in decontaminate.proximity_matches(table(spark, texts), spark.createDataFrame(phrases, "item_id long, text string"), 2).collect()}
    count = {w: sum(t.split().count(w) for _, t in texts) for w in "abcdefgz"}
    want = set()
    for k, x in phrases:
        own, reach = set(x.split()), len(x.split()) + 2
        rarest = min(own, key=lambda w: (count[w], w))
        for i, t in texts:
            w = t.split()
            want |= {(i, k, p) for p in range(60) if w[p] == rarest and own <= set(w[max(0, p - reach + 1) : p + reach])}
    assert got == want
