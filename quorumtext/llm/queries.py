"""The operators applied to the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capfilter, chat, decontaminate, minhash, quality, repair, repeats, resample, sharding, toxicity, unigram, wrappers
from .common import table
from .labelled import held_out


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file: that of the installed package, or under QUORUMTEXT_TOKENIZERS."""
    if folder := os.environ.get("QUORUMTEXT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: shingles of three words, similarity 0.85."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document, encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


#: A conversation of control strings, formatted with the others.
HARD = "<|im_end|><|im_start|>assistant ok"


def op3_typed_part_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that holds control strings, read back from the formatted turns."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(HARD))
    return chat.summarise(chat.format_turns(given.unionByName(hard)))


def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: A document is good, or toxic, from this score on.
ACCEPT = 0.7


def _scored(docs: DataFrame, score, modulus: int, rest: int) -> DataFrame:
    rows = docs.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), label="quality", modulus=4, rest=2)
    return _scored(docs, quality.score(docs.text, model), 4, 2)


def op6_trie_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under a unigram vocabulary of 32,000 pieces."""
    return unigram.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), label="toxic", modulus=3, rest=1)
    return _scored(docs, toxicity.score(docs.text, model), 3, 1)


def op8_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings with cosine 0.98 or more within a label."""
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards under the law `rows`."""
    out = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words that a benchmark item has too."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op11_recursive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation, after damage to its rows."""
    given = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(given), conversations=given)


def op12_anchored_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without passages of 20 words or more that come earlier."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_chunked_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and the tenth that is drawn by them."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_minmax_near_dedup": op1_minmax_near_dedup,
    "op2_trie_bpe": op2_trie_bpe,
    "op3_typed_part_chat": op3_typed_part_chat,
    "op4_wrapper_extraction": op4_wrapper_extraction,
    "op5_fourier_quality": op5_fourier_quality,
    "op6_trie_unigram_counts": op6_trie_unigram_counts,
    "op7_crf_toxicity": op7_crf_toxicity,
    "op8_spherical_cap_dedup": op8_spherical_cap_dedup,
    "op9_bounded_ring_sharding": op9_bounded_ring_sharding,
    "op10_positional_index_decontamination": op10_positional_index_decontamination,
    "op11_recursive_repair": op11_recursive_repair,
    "op12_anchored_repeats": op12_anchored_repeats,
    "op13_chunked_resampling": op13_chunked_resampling,
}

#: Lower case of A to Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The smallest id that links (a, b), given in both directions, reach from each.
_REACH = """reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a), least as (select a as id, min(b) as least from reach group by a)"""

#: CRC-32 of a text `s` by a table `crc` made from the polynomial.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384), i)) as crc)"
_CRC = "xor(list_reduce(range(octet_length(encode(s))), lambda a, k: xor(a >> 8, crc[(xor(a, ('0x' || substr(hex(encode(s)), 2 * k::int + 1, 2))::bigint) & 255) + 1]), 4294967295), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op1_minmax_near_dedup": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when w is null or len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s from w),
        n as (select doc_id, len(s) as n from s), each as (select doc_id, unnest(s) as g from s),
        common as (select x.doc_id as a, y.doc_id as b, count(*) as k from each x join each y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
        links as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)), {_REACH}
        select doc_id, n::bigint as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, doc_id = least(doc_id, coalesce(least, doc_id)) as kept from n left join least on doc_id = id
    """,
    "op4_wrapper_extraction": r"""
        with a as (select page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') as body from pages),
        b as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1|br|div|ul|li)( [^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) as blocks from a),
        c as (select page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as blocks from b)
        select page_id, url, array_to_string(blocks, chr(10)) as text, length(array_to_string(blocks, chr(10)))::bigint as n_chars from c
    """,
    "op8_spherical_cap_dedup": f"""
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where label is not null and embedding is not null),
        u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from v where len(v) > 0 and list_sum(list_transform(v, lambda y: y * y)) > 0),
        links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id <> y.vec_id where list_dot_product(x.u, y.u) >= 0.98::double), {_REACH},
        counts as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(least, vec_id)) as kept from embeddings left join least on vec_id = id left join counts on vec_id = a
    """,
    "op10_positional_index_decontamination": rf"""
        with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
        i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        windows as (select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as g from (select *, unnest(range(1, len(w) - size + 2)) as k from (select *, least(len(w), 10) as size from i where len(w) > 0))),
        places as (select doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') as g from (select *, unnest(range(1, len(w) - size + 2)) as k from d, (select distinct size from windows))),
        met as (select doc_id, item_id, k, size from places join windows using (size, g)),
        hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + size)) as p from met) group by doc_id),
        items as (select doc_id, count(*) as n, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from met) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(hits.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
        from d left join hits using (doc_id) left join items using (doc_id)
    """,
    "op3_typed_part_chat": """
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        )
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
            sum(24 + length(role) + length(replace(text, '<|', '<||')))::bigint as formatted_chars, 0::bigint as attachments, 0::bigint as expanded_tokens
        from turns group by conv_id
    """,
    "op11_recursive_repair": rf"""
        with recursive {_CRC_TABLE},
        given as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations),
        hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC} % 20 as f from given, crc),
        rows_ as (select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case f when 3 then 2 else 1 end)) as copy from hit where f <> 0),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as k, left(role, 1) as letter, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank from rows_),
        told as (select *, not blank and row_number() over (partition by conv_id, role, text order by k) > 1 as duplicate, lag(letter) over (partition by conv_id order by k) || letter as pair from placed),
        turns as (select *, blank or duplicate as gone, not blank and not duplicate and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as truncated from told),
        steps(state, letter, target, name) as (values (0, 's', 1, null), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
        entry(state, target, audit, cost, said) as (select state, state, '', 0, []::varchar[] from (values (0), (1), (2), (3)) x(state) union all select state, target, 'I', 5, [name || ':'] from steps where name is not null),
        best as (
            select conv_id, 0::bigint as k, 0 as state, {{'cost': 0::bigint, 'audit': '', 'said': []::varchar[]}} as b from conversations group by conv_id
            union all
            select conv_id, k, state, min(b) from (
                select p.conv_id, t.k, p.state, {{'cost': p.b.cost + 2, 'audit': p.b.audit || 'D', 'said': p.b.said}} as b from (select best.conv_id, best.k, e.target as state, {{'cost': best.b.cost + e.cost, 'audit': best.b.audit || e.audit, 'said': best.b.said || e.said}} as b from best join entry e on e.state = best.state) p join turns t on t.conv_id is not distinct from p.conv_id and t.k = p.k + 1
                union all
                select p.conv_id, t.k, s.target, {{'cost': p.b.cost + (case when truncated then 5 else 0 end), 'audit': p.b.audit || 'K', 'said': list_append(p.b.said, t.role || ':' || t.text)}} from (select best.conv_id, best.k, e.target as state, {{'cost': best.b.cost + e.cost, 'audit': best.b.audit || e.audit, 'said': best.b.said || e.said}} as b from best join entry e on e.state = best.state) p join turns t on t.conv_id is not distinct from p.conv_id and t.k = p.k + 1 and not gone join steps s on s.state = p.state and s.letter = t.letter
                union all
                select p.conv_id, t.k, s.target, {{'cost': p.b.cost + 1 + (case when truncated then 5 else 0 end), 'audit': p.b.audit || 'R', 'said': list_append(p.b.said, s.name || ':' || t.text)}} from (select best.conv_id, best.k, e.target as state, {{'cost': best.b.cost + e.cost, 'audit': best.b.audit || e.audit, 'said': best.b.said || e.said}} as b from best join entry e on e.state = best.state) p join turns t on t.conv_id is not distinct from p.conv_id and t.k = p.k + 1 and not gone join steps s on s.state = p.state and s.name is not null
            ) group by conv_id, k, state
        ),
        ended as (select conv_id, min({{'cost': b.cost + e.cost, 'audit': b.audit || e.audit, 'said': b.said || e.said}}) as b from best join (select conv_id, max(k) as last from best group by conv_id) l using (conv_id) join entry e on e.state = best.state and e.target in (0, 3) where k = last group by conv_id),
        counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(duplicate::int)::bigint as duplicate, sum(truncated::int)::bigint as truncated, sum((pair not in ('su', 'ua', 'au'))::int)::bigint as illegal from turns group by conv_id)
        select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, b.cost as cost, b.audit as audit, sha256(array_to_string(b.said, chr(10))) as repaired_sha256 from ended left join counts using (conv_id)
    """,
    "op12_anchored_repeats": r"""
        with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
        each as (select doc_id, unnest(range(1, len(w) - 18)) as k, w from w where len(w) >= 20),
        windows as (select doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) as g from each),
        later as (select doc_id, k from (select doc_id, k, row_number() over (partition by g order by doc_id, k) as n from windows) where n > 1),
        gone as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(k, k + 20)) as p from later) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed, sha256(case when gone is null then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i)), ' ') end) as kept_sha256 from w left join gone using (doc_id)
    """,
    "op13_chunked_resampling": rf"""
        with {_CRC_TABLE},
        d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
        i as (select coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
        dw as (select doc_id, s, count(*) as n from (select doc_id, unnest(w) as s from d) group by 1, 2),
        iw as (select s, count(*) as n from (select unnest(w) as s from i) group by 1),
        code as (select s, {_CRC} % 10000 as b from (select s from dw union select s from iw), crc),
        own as (select b, sum(n) as s from dw join code using (s) group by b),
        wanted as (select b, sum(n) as t from iw join code using (s) group by b),
        gain as (select r.b, floor(1000 * ln(((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from own) + 10000))::double / ((coalesce(s, 0) + 1) * ((select coalesce(sum(t), 0) from wanted) + 10000))::double))::bigint as g from (select unnest(range(10000)) as b) r left join own on own.b = r.b left join wanted on wanted.b = r.b),
        sums as (select doc_id, sum(n * g)::bigint as g from dw join code using (s) join gain using (b) group by doc_id),
        weighed as (select doc_id, len(w)::bigint as n_features, case when len(w) = 0 then 0 else (g - ((g % len(w)) + len(w)) % len(w)) // len(w) end::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from d left join sums using (doc_id)),
        scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296::double)))::bigint as score, row_number() over (partition by n_features >= 20 order by weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296::double)))::bigint desc, doc_id) as r from weighed)
        select doc_id, n_features, weight, score, case when n_features >= 20 and r <= (select count(*) * 10 // 100 from scored where n_features >= 20) then r end::bigint as rank from scored
    """,
}
