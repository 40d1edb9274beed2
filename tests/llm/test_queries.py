"""Every opN query on the smallest given tables: whole rows, contract columns, and results by brute force or the library."""

import hashlib
import os
import zlib

import pytest

import __spark_entry__ as entry
from quorumtext.llm import queries, sharding

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = rows(spark, name)
    assert sorted(columns) == sorted(got[0].asDict())
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(found.fetchall())


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    got = rows(spark, "op2_trie_bpe")
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name, label, modulus, rest", [("op5_fourier_quality", "quality", 4, 2), ("op7_crf_toxicity", "toxic", 3, 1)])
def test_classifiers_score_every_document(spark, name, label, modulus, rest):
    got = rows(spark, name)
    known = {r["doc_id"]: r[label] for r in table(spark, "labels")}
    assert len(got) == len(table(spark, "documents")) and {r["predicted"] for r in got} <= {0, 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    learned = [r for r in got if r["doc_id"] in known and not r["held_out"]]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in learned) > 0.8 * len(learned)  # these tables have few labels; the models' tests measure held-out ones


def test_token_counts_cover_every_document(spark):
    got = rows(spark, "op6_trie_unigram_counts")
    assert {(r["doc_id"], r["n_chars"]) for r in got} == {(r["doc_id"], len(r["text"] or "")) for r in table(spark, "documents")}
    assert all(0 < r["n_tokens"] <= r["n_bytes"] + r["n_pretokens"] * 3 for r in got if r["n_chars"])


def test_shards_follow_the_ring(spark):
    """Every row's shard by walking the ring row by row: bins in order, each to its owner while there is room, the rest clockwise."""
    docs = table(spark, "documents")
    got = rows(spark, "op9_bounded_ring_sharding")
    assert len(got) == len(docs) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in got)
    bins = 1 << 15
    placed = {r["doc_id"]: r["bin"] for r in spark.createDataFrame([(d,) for d in texts], "doc_id long").selectExpr("doc_id", f"cast(pmod(xxhash64('ring', cast(doc_id as string)), {bins}) as int) as bin").collect()}
    owner, room = sharding.owners(40, 128, bins), sharding.bounds(len(docs), 40, 0.0)
    want, late = {}, []
    for d, b in sorted(placed.items(), key=lambda x: x[1]):
        if room[owner[b]]:
            room[owner[b]] -= 1
            want.setdefault(b, []).append(owner[b])
        else:
            late.append(b)
    for b in late:
        at = b
        while not room[owner[at]]:
            at = (at + 1) % bins
        room[owner[at]] -= 1
        want.setdefault(b, []).append(owner[at])
    found = {}
    for r in got:
        found.setdefault(placed[r["doc_id"]], []).append(r["shard"])
    assert {b: sorted(s) for b, s in found.items()} == {b: sorted(s) for b, s in want.items()}
    for shard in range(40):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own))) and len(own) in (len(docs) // 40, -(-len(docs) // 40))
