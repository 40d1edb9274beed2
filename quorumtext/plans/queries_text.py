"""N-grams, alphabets, and operators of the script on literal cases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPECIAL, first_difference, in_part, only, output_length, padded_confidence, percent, tokens
from ..operators import charlm, metrics, scan, script, signal
from ..streaming import tables as stream_tables
from . import views
from .queries_lines import ACCENTED
from .storage import cut, shared_folder, table

ORDER = 3


def ngram_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charlm.uses(views.lines(spark, sf_dir), "ref", ORDER)


def ngram_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charlm.continuations(charlm.uses(views.lines(spark, sf_dir), "ref", ORDER))


def kn_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every seen trigram."""
    raw = charlm.uses(views.lines(spark, sf_dir), "ref", ORDER)
    seen = raw.where(F.col("k") == ORDER).select("h", "c")
    return charlm.probabilities(seen, charlm.tables(raw, ORDER), ORDER, charlm.vocabulary_size(raw, ORDER)).withColumn("p", F.round("p", 9))


#: Lines of this part are ordinary ones; the others are learned as corrections, each of which weighs as much as three.
ORDINARY, CORRECTION = "test", 3


def incremental_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's tables of ordinary lines, brought up to date with corrections: only what these touch is made anew."""
    rows = views.lines(spark, sf_dir)
    raw = cut(charlm.uses(rows.where(F.col("part") == ORDINARY), "ref", ORDER))
    more = cut(charlm.uses(rows.where(F.col("part") != ORDINARY), "ref", ORDER, CORRECTION))
    counts, histories = (cut(t) for t in charlm.split_tables(raw, ORDER))
    new_counts, new_histories = charlm.touched(counts, histories, charlm.count_changes(raw, more, ORDER))
    return charlm.replaced(counts, new_counts, "k", "h", "c").join(charlm.replaced(histories, new_histories, "k", "h"), ["k", "h"])


def learned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables, kept by a stream of the lines that is read to its end in several batches."""
    rows = views.lines(spark, sf_dir).select("ref", F.when(F.col("part") == ORDINARY, 1).otherwise(CORRECTION).alias("weight"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    rows.write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema("ref string, weight int").option("maxFilesPerTrigger", max(1, -(-rows.rdd.getNumPartitions() // 4))).parquet(f"{folder}/lines")
    with stream_tables.rocksdb(spark):
        query = stream_tables.maintain(stream, "ref", ORDER, f"{folder}/state", weight=F.col("weight"), available_now=True)
        query.awaitTermination()
        return cut(stream_tables.tables_of(spark, f"{folder}/state"))


def alphabet_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.alphabet(table(spark, sf_dir, "documents"), "text")


def alphabet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of encoded lines, and whether they decode to themselves."""
    rows = views.lines(spark, sf_dir).select("line_id", "ref")
    letters = script.alphabet(rows, "ref")
    back = script.decode(script.encode(rows, "ref", letters), "codes", letters)
    return back.select("line_id", F.size("codes").cast("long").alias("n_codes"), (F.col("decoded") == F.col("ref")).alias("same"))


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("line_id", script.codec_round_trip("ref").alias("same"))


def lost_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).withColumn("after", F.regexp_replace("ref", f"[{ACCENTED}]", ""))
    return script.lost_characters(rows, "ref", "after")


def restricted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("line_id", only("ref", ACCENTED).alias("kept"))


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("line_id", script.normalise("ref").alias("plain"))


def mirrored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan order of every line, and whether mirroring twice restores it."""
    rows = views.lines(spark, sf_dir).select("line_id", "ref", script.mirror("ref").alias("scan"))
    return rows.select("line_id", "scan", (script.mirror("scan") == F.col("ref")).alias("restored"))


def constrained_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two scripts without marks that lack a base and without Latin letters in words of the other one."""
    return views.mixed(spark, sf_dir).select("line_id", script.constrained("mixed").alias("text"))


def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the script, in Latin letters."""
    return views.ajami(spark, sf_dir).select("line_id", script.transliterate("ajami").alias("latin"))


def spelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that meet the rules of long vowels, carriers, doubling, glides and the article, in Latin letters."""
    return views.spelled(spark, sf_dir).select("line_id", script.transliterate("ajami").alias("latin"))


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both directions in the order of a scan, and whether they come back."""
    rows = views.ordered(spark, sf_dir).withColumn("scan", script.mirror("logical"))
    return rows.select("line_id", "scan", (script.mirror("scan") == F.col("logical")).alias("restored"))


def _joined(column: str) -> Column:
    """Words joined by twos."""
    words = tokens(column)
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(2))
    return F.array_join(F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, F.lit(2)), "")), " ")


def divided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose words were joined by twos, divided again by all documents' words."""
    rows = views.lines(spark, sf_dir)
    words = rows.select(F.explode(tokens("ref")).alias("word")).where("length(word) > 1").groupBy("word").count()
    return script.divided(rows.select("line_id", _joined("ref").alias("joined")), "joined", words).select("line_id", "divided")


def boko_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the script, in Latin letters and divided by their own words: nothing is joined, so nothing is divided."""
    rows = views.ajami(spark, sf_dir).select("line_id", "ajami")
    words = rows.select(F.explode(F.split(script.transliterate("ajami"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.lit(1).alias("count"))
    return script.to_boko(rows, "ajami", words).select("line_id", (F.replace("boko", F.lit(" "), F.lit("")) == F.replace(script.transliterate("ajami"), F.lit(" "), F.lit(""))).alias("same_letters"))


def tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two scripts as they are shown, every character unsure."""
    rows = views.mixed(spark, sf_dir).select("line_id", script.tidied("mixed", F.array_repeat(F.lit(True), F.length("mixed"))).alias("t"))
    flags = F.array_join(F.transform("t.unsure", lambda f: F.when(f, "1").otherwise("0")), "")
    return rows.select("line_id", "t.text", flags.alias("unsure"), script.worth_keeping("t.text").alias("kept"))


def carried_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of lines in which a letter was corrected: all letters kept but the corrected ones, which are flagged."""
    rows = views.lines(spark, sf_dir).select("line_id", "ref", F.array_repeat(F.lit(False), F.length("ref")).alias("flags"), F.translate("ref", "q", "ʌ").alias("new"))
    made = rows.select("line_id", "ref", script.carried_flags("ref", "flags", "new").alias("f"))
    return made.select("line_id", F.size(F.filter("f", lambda x: x)).cast("long").alias("flagged"))


def error_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong and missing letters of every reading of the third reader."""
    rows = views.readings(spark, sf_dir).where("member = 2").select("line_id", script.flagged_errors("ref", "hyp").alias("f"))
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return rows.select("line_id", F.size(F.filter("f.wrong", lambda x: x)).cast("long").alias("wrong"), count("f.missing").cast("long").alias("missing"), F.element_at("f.missing", 1).cast("long").alias("missing_first"))


def shown_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third reader's readings with their errors marked."""
    return views.readings(spark, sf_dir).where("member = 2").select("line_id", script.shown_errors("ref", "hyp").alias("html"))


def highlighted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with every `e` marked as uncertain."""
    flags = F.transform(F.sequence(F.lit(1), F.length("ref")), lambda i: F.substr(F.col("ref"), i, F.lit(1)) == "e")
    return views.lines(spark, sf_dir).select("line_id", script.highlighted("ref", flags).alias("html"))


def numbered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text on one line sent as a numbered reply and read back, its third line left to the fallback."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    reply = F.concat(F.lit("1. "), F.col("t"), F.lit("\nnone\n2) x\n 2. "), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.array_join(script.with_fallback(reply, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), "|").alias("lines"))


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", script.split_pair(F.concat(F.col("lang"), F.lit(" ||| "), F.col("source"), F.lit(" ||| x"))).alias("p"))
    return rows.select("doc_id", "p.first", "p.second")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an edited document that the original lacks: every line with an `x` gets another letter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("a"), F.split(F.translate("text", "x", "ʌ"), "\n").alias("b"))
    return rows.select("doc_id", F.size(script.corrections("a", "b")).cast("long").alias("corrected"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, percentages, frames, first differences, line images and confidences of every document."""
    rows = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "train").otherwise("val"))
    parts = [in_part("split", "doc_id", p) for p in ("test", "train", "valA", "valB")]
    part = F.coalesce(*[F.when(x, p) for x, p in zip(parts, ("test", "train", "valA", "valB"), strict=True)])
    kept = padded_confidence(F.sequence(F.lit(1), F.expr("cast(doc_id % 7 + 1 as int)")).cast("array<double>"), "text")
    return rows.select(
        "doc_id", part.alias("part"), percent(F.col("n_chars") / 1000).alias("percent"), output_length(F.col("n_chars")).cast("long").alias("frames"), first_difference("text", F.translate("text", "t", "T")).cast("long").alias("differs"),
        signal.single_line(F.col("n_chars"), F.col("doc_id") * 30).alias("single"), F.array_join(F.transform(kept, lambda c: (c * 10).cast("int").cast("string")), ",").alias("conf"),
    )


def ctc_infeasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose images would be too narrow for their text."""
    rows = views.lines(spark, sf_dir).withColumn("width", (F.col("doc_id") * 7 + F.length("ref")) % 250)
    return signal.ctc_infeasible(rows, "line_id", "width", "ref").withColumns({c: F.col(c).cast("long") for c in ("width", "steps", "needed")})


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluations of their users' training: the best so far, and where waiting for five would end it."""
    return scan.best_so_far(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 5)


def _pieces(column: str) -> tuple[Column, Column]:
    """A toy tokenizer's pieces and texts: letters without accents, anything else unknown."""
    pieces = F.transform(metrics.characters(column), lambda c: F.when(c.rlike("^[\\x20-\\x7E]$"), c).otherwise("[UNK]"))
    return pieces, F.array_join(F.filter(pieces, lambda p: p != "[UNK]"), "")


def exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a tokenizer that knows ASCII only gives lines back, and whether that is good enough."""
    pieces, back = _pieces("ref")
    counts, _ = script.exact_report(views.lines(spark, sf_dir).select("ref", back.alias("back"), pieces.alias("pieces")), "ref", "back", "pieces")
    return script.vocabulary_gate(counts)


def exact_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that most lines lose in the same tokenizer."""
    pieces, back = _pieces("ref")
    return script.exact_report(views.lines(spark, sf_dir).select("ref", back.alias("back"), pieces.alias("pieces")), "ref", "back", "pieces")[1]


def added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that the same tokenizer has to learn, counted by their category."""
    letters = script.alphabet(table(spark, sf_dir, "documents"), "text")
    return script.category_counts(script.tokens_to_add(letters.withColumn("alone", _pieces("ch")[1]), "ch", "alone"))


def special_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accented letters the documents have."""
    return script.coverage(script.alphabet(table(spark, sf_dir, "documents"), "text"), ACCENTED)


def alphabet_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of documents and benchmark: in both, in either, in the first only."""
    a, b = (script.alphabet(table(spark, sf_dir, t), "text").select("ch") for t in ("documents", "benchmark"))
    sized = lambda df, name: df.agg(F.lit(name).alias("set"), F.count("*").alias("letters"))
    return sized(a.union(b).distinct(), "union").union(sized(a.intersect(b), "intersection")).union(sized(a.exceptAll(b), "difference"))


def ngram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By order, up to eight: distinct n-grams, their uses and squared uses, and how many continue shorter ones."""
    raw = charlm.uses(views.lines(spark, sf_dir), "ref")
    counts = raw.groupBy("k").agg(F.count("*").alias("grams"), F.sum("n").alias("uses"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    counts = cut(counts)  # a row for each order
    # Every n-gram continues the one without its first character, so the sum of continuations() is the number of longer n-grams.
    more = counts.where("k > 1").select((F.col("k") - 1).alias("k"), F.col("grams").alias("continuing"))
    return counts.join(more, "k", "left")


def nfc_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", script.nfc_changes("text").alias("changed"))


QUERIES = {f.__name__: f for f in (ngram_uses, ngram_continuations, kn_probabilities, incremental_tables, learned_tables, alphabet_build, alphabet_round_trip, codec_round_trip, lost_characters, restricted_texts, normalised_lines, mirrored_lines, constrained_lines, transliterated, spelled_lines, ordered_lines, divided_lines, boko_lines, tidy_lines, carried_flags, error_flags, shown_errors, highlighted_lines, numbered_replies, split_pairs, corrections, scalar_functions, ctc_infeasible, early_stopping, exact_report, exact_losses, added_tokens, special_coverage, alphabet_sets, ngram_totals, nfc_changed)}

_GRAMS = f"""{views.SQL}, padded as (select chr(2) || chr(2) || ref || chr(3) as s from lines),
    ends as (select s, unnest(range({ORDER}, length(s) + 1)) as i from padded),
    uses as (select k, substr(s, i - k + 1, k - 1) as h, substr(s, i, 1) as c, count(*)::bigint as n from ends, (select unnest(range(1, {ORDER} + 1)) as k) group by all),
    cont as (select k - 1 as k, substr(h, 2) as h, c, count(*)::bigint as n from uses where k > 1 group by 1, 2, 3)"""

_TABLES = f"""{views.SQL}, padded as (select chr(2) || chr(2) || ref || chr(3) as s, case when part = '{ORDINARY}' then 1 else {CORRECTION} end as w from lines),
    ends as (select s, w, unnest(range({ORDER}, length(s) + 1)) as i from padded),
    uses as (select k, substr(s, i - k + 1, k - 1) as h, substr(s, i, 1) as c, sum(w)::bigint as n from ends, (select unnest(range(1, {ORDER} + 1)) as k) group by all),
    counts as (select * from uses where k = {ORDER} union all select k - 1, substr(h, 2), c, count(*)::bigint from uses where k > 1 group by 1, 2, 3)
    select k::int as k, h, c, n, sum(n) over (partition by k, h)::bigint as total, count(*) over (partition by k, h)::bigint as types from counts"""
_PAIRS = "regexp_extract_all(ref, '[^ \\t\\n\\r\\f\\v]+')"
_DIVIDED = f"""{views.SQL}, words as (select line_id, {_PAIRS} as w from lines),
    lexicon as (select x, count(*) as n from (select unnest(w) as x from words) where length(x) > 1 group by x), total as (select sum(n)::double as total from lexicon),
    priced as (select x, -ln(n::double / total) as cost from lexicon, total),
    joined as (select line_id, list_transform(range(0, (len(w) + 1) // 2), lambda i: w[2 * i + 1] || coalesce(w[2 * i + 2], '')) as j from words),
    own as (select distinct unnest(j) as word from joined),
    begun as (select word, unnest(range(0, length(word))) as b from own), spans as (select word, b, unnest(range(b + 1, length(word) + 1)) as e from begun),
    costed as (select word, list(cost order by b, e) as costs from spans left join priced on x = substr(word, b + 1, e - b) group by word),
    best as (select word, list_reduce(list_transform(range(1, length(word) + 1), lambda e: [{{'c': e::double, 'b': 0::bigint, 'u': 0::bigint, 'p': ''}}]),
        lambda done, x: done || [coalesce(list_min(list_filter(list_transform(range(greatest(0, x[1].c::bigint - 20), x[1].c::bigint), lambda b:
            {{'c': done[b + 1].c + coalesce(costs[b * length(word) - b * (b - 1) // 2 + x[1].c::bigint - b], 12.0::double + 0.1::double * (x[1].c::bigint - b)),
            'b': case when x[1].c::bigint - b = 1 and substr(word, b + 1, 1) <> 'a' then -1 else b end,
            'u': done[b + 1].u + (costs[b * length(word) - b * (b - 1) // 2 + x[1].c::bigint - b] is null)::int,
            'p': done[b + 1].p || case when b = 0 then '' else ' ' end || substr(word, b + 1, x[1].c::bigint - b)}}), lambda w: w.c < 1e17 and w.b >= 0 and w.u <= 1)), {{'c': 1e18::double, 'b': 0::bigint, 'u': 0::bigint, 'p': ''}})],
        [{{'c': 0.0::double, 'b': -1::bigint, 'u': 0::bigint, 'p': ''}}])[-1] as d from costed),
    parts as (select word, case when d.c < 1e17 then d.p else word end as p from best),
    placed as (select line_id, unnest(j) as word, generate_subscripts(j, 1) as i from joined)
    select lines.line_id, coalesce(string_agg(p, ' ' order by i), '') as divided from lines left join placed using (line_id) left join parts using (word) group by lines.line_id"""
_LATIN, _ARABIC = "A-Za-zÀ-ÖØ-öø-ÿ", "ابدَرُ"
_HALF = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295::bigint)"
_SHOWN = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"

ORACLE_SQL = {
    "normalised_lines": f"""{views.SQL}, plain as (select line_id, replace(replace(translate(strip_accents(lower(ref)), 'ɓʿʼ' || chr(39) || '’-', 'b'), 'dh', 'z'), 'th', 'c') as x from lines)
        select line_id, trim(regexp_replace(regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) as plain from plain""",
    "mirrored_lines": f"""{views.SQL} select line_id, case when regexp_matches(ref, '[\\p{{L}}]') then array_to_string(list_reverse(list_filter(string_split(ref, ''), lambda c: c <> '')), '')
        else array_to_string(list_transform(regexp_extract_all(ref, '[0-9]+(?:[-+.,:/][0-9]+)*|[^0-9]'), lambda x: case when regexp_matches(x, '[0-9]') then reverse(x) else x end), '') end as scan, true as restored from lines""",
    "constrained_lines": f"""{views.SQL}, kept as (select line_id, string_split(regexp_replace(mixed, '(^| )[َُ]+', '\\1', 'g'), ' ') as words from mixed)
        select line_id, array_to_string(list_transform(words, lambda w: case when length(regexp_replace(w, '[^{_LATIN}]', '', 'g')) between 1 and length(regexp_replace(w, '[^{_ARABIC}]', '', 'g')) then regexp_replace(w, '[{_LATIN}]', '', 'g') else w end), ' ') as text from kept""",
    "tidy_lines": f"""{views.SQL}, toks as (select line_id, list_filter(string_split(regexp_replace(mixed, '[A-Za-z]', '', 'g'), ' '), lambda w: w <> '') as words from mixed),
        kept as (select line_id, list_filter(words, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{Nd}}]') and not (length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) = 1 and not regexp_matches(w, '[\\p{{Nd}}\\p{{M}}]'))) as words from toks),
        joined as (select line_id, array_to_string(words, ' ') as text from kept)
        select line_id, text, regexp_replace(regexp_replace(text, '[^ ]', '1', 'g'), ' ', '0', 'g') as unsure, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2 or length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) >= 2 as kept from joined""",
    "transliterated": f"""{views.SQL}, words as (select line_id, list_filter(list_transform(string_split(regexp_replace(lower(ref), '[^bdfklmnrstzaiu ]', '', 'g'), ' '), lambda w: regexp_replace(regexp_replace(w, '^[aiu]+', ''), '([aiu])[aiu]+', '\\1', 'g')), lambda w: w <> '') as w from lines)
        select line_id, array_to_string(w, ' ') as latin from words""",
    "boko_lines": f"{views.SQL} select line_id, true as same_letters from lines",
    "carried_flags": f"{views.SQL} select line_id, (length(ref) - length(replace(ref, 'q', '')))::bigint as flagged from lines",
    "error_flags": f"{views.SQL} select line_id, (length(body) - length(translate(body, 'eo', '')))::bigint as wrong, dropped::bigint as missing, dropped::bigint as missing_first from (select *, case when dropped then substr(ref, 2) else ref end as body from read)",
    "shown_errors": f"""{views.SQL}, b as (select line_id, dropped, case when dropped then substr(ref, 2) else ref end as body from read)
        select line_id, case when dropped then '{script.MISS}' else '' end || array_to_string(list_transform(list_filter(string_split(translate(body, 'eo', 'ɘɔ'), ''), lambda c: c <> ''), lambda c: case when c in ('ɘ', 'ɔ') then '<span class="err">' || c || '</span>' else replace({_SHOWN.format(c='c')}, ' ', '&nbsp;') end), '') as html from b""",
    "highlighted_lines": f"{views.SQL} select line_id, array_to_string(list_transform(list_filter(string_split(ref, ''), lambda c: c <> ''), lambda c: case when c = 'e' then '<mark>e</mark>' else {_SHOWN.format(c='c')} end), '') as html from lines",
    "numbered_replies": "select doc_id, coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), 'a') || '|' || doc_id || '|c' as lines from documents",
    "split_pairs": "select doc_id, lang as first, source || ' ||| x' as second from documents",
    "corrections": "select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'x')))::bigint as corrected from documents",
    "scalar_functions": f"""{views.SQL}, d as (select documents.*, {_HALF} as crc from documents, tbl)
        select doc_id, case doc_id % 3 when 0 then 'test' when 1 then 'train' else case when crc % 2 = 0 then 'valA' else 'valB' end end as part, printf('%.2f%%', n_chars / 1000 * 100) as percent, greatest(1, n_chars // 2)::bigint as frames,
            strpos(text, 't')::bigint as differs, n_chars <= 400 and doc_id * 30 >= 3 * n_chars as single,
            array_to_string(list_transform(range(1, length(text) + 1), lambda i: case when i <= doc_id % 7 + 1 then (i * 10)::int::varchar else '5' end), ',') as conf from d""",
    "ctc_infeasible": f"{views.SQL}, w as (select line_id, (doc_id * 7 + length(ref)) % 250 as width, length(ref) as needed from lines) select line_id, width::bigint as width, greatest(1, width // 2)::bigint as steps, needed::bigint as needed from w where greatest(1, width // 2) < needed",
    "early_stopping": """with o as (select user_id, event_id, value, min(value) over w as best, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before, row_number() over w as n from events window w as (partition by user_id order by event_id)),
        i as (select *, coalesce(value < before, value is not null) as improved from o), m as (select *, n - max(case when improved then n else 1 end) over (partition by user_id order by event_id) as misses from i)
        select user_id, event_id, value, best, improved, misses::int as misses, coalesce(max((misses >= 5)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) = 1, false) as stopped from m""",
    "exact_report": f"""{views.SQL}, c as (select count(*)::bigint as lines, count(*) filter (regexp_matches(ref, '[^ -~]'))::bigint as unknown from lines) select lines, unknown, unknown as mismatches, unknown = 0 and unknown <= lines * 0.005::double as passed from c""",
    "exact_losses": f"""{views.SQL} select ch, count(*)::bigint as lines from (select distinct line_id, unnest(string_split(regexp_replace(ref, '[ -~]', '', 'g'), '')) as ch from lines) where ch <> '' group by ch order by 2 desc, 1 limit 15""",
    "added_tokens": f"""with l as (select distinct unnest(string_split(text, '')) as ch from documents), a as (select ch from l where ch <> '' and not regexp_matches(ch, '[ -~]') union select unnest(string_split('{SPECIAL}▁', '')))
        select case when regexp_matches(ch, '\\p{{Lu}}') then 'Lu' when regexp_matches(ch, '\\p{{Ll}}') then 'Ll' when regexp_matches(ch, '\\p{{Lo}}') then 'Lo' when regexp_matches(ch, '\\p{{Mn}}') then 'Mn' when regexp_matches(ch, '\\p{{Cc}}') then 'Cc' when regexp_matches(ch, '\\p{{So}}') then 'So' when regexp_matches(ch, '\\p{{Po}}') then 'Po' when regexp_matches(ch, '\\p{{Sc}}') then 'Sc' else '?' end as category, count(*)::bigint as characters from a group by 1""",
    "special_coverage": f"select ch, exists(select 1 from documents where contains(text, ch)) as present from (select unnest(string_split('{ACCENTED}', '')) as ch)",
    "alphabet_sets": """with a as (select distinct unnest(string_split(text, '')) as ch from documents), b as (select distinct unnest(string_split(text, '')) as ch from benchmark)
        select 'union' as set, count(*)::bigint as letters from (select ch from a where ch <> '' union select ch from b where ch <> '') union all select 'intersection', count(*)::bigint from a semi join b using (ch) where ch <> '' union all select 'difference', count(*)::bigint from a anti join b using (ch) where ch <> ''""",
    "ngram_totals": f"""{views.SQL}, padded as (select repeat(chr(2), 7) || ref || chr(3) as s from lines), ends as (select s, unnest(range(8, length(s) + 1)) as i from padded),
        uses as (select k, substr(s, i - k + 1, k) as g, count(*)::bigint as n from ends, (select unnest(range(1, 9)) as k) group by all),
        counts as (select k, count(*)::bigint as grams, sum(n)::bigint as uses, sum(n * n)::bigint as squares from uses group by k)
        select counts.k::int as k, counts.grams, counts.uses, counts.squares, longer.grams as continuing from counts left join counts longer on longer.k = counts.k + 1""",
    "ngram_uses": f"{_GRAMS} select k::int as k, h, c, n from uses",
    "ngram_continuations": f"{_GRAMS} select k::int as k, h, c, n from cont",
    "spelled_lines": f"""{views.SQL}, words as (select line_id, list_filter(string_split(regexp_replace(lower(ref), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '') as w from lines),
        spelled as (select line_id, list_transform(w, lambda x: {{'n': length(x) % 4, 'k': length(x) % 4 = 3 or length(x) % 4 = 2 and x[1] = 'k',
            't': {[latin for _, latin in views.BEFORE]}[length(x) % 4 + 1] || array_to_string(list_transform(list_filter(string_split(x, ''), lambda c: c <> ''), lambda c: {[latin for _, latin in views.SYLLABLES.values()]}[unicode(c) - 96]), '')}}) as s from words)
        select line_id, array_to_string(list_transform(s, lambda x: case when x.k then 'al-' || substr(x.t, 3) else x.t end), ' ') as latin from spelled""",
    "ordered_lines": f"""{views.SQL}, p as (select line_id, doc_id, translate(regexp_replace(lower(ref), '[^a-z ]', '', 'g'), '{views.LETTERS[0]}', '{views.LETTERS[1]}') as a, regexp_replace(ref, '[^A-Za-z ]', '', 'g') as l, (length(ref) * 7 + doc_id)::varchar as n from lines)
        select line_id, 'ب ' || a || ' ب ' || reverse(n) || ' ' || reverse(doc_id::varchar) || ' م ' || reverse(n || '/12-3') || ' ب ' || translate(reverse(n), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' -١٢- ' || translate(reverse(n), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ب ' || reverse('x' || l || 'z') || ' ب' as scan, true as restored from p""",
    "divided_lines": _DIVIDED,
    "incremental_tables": _TABLES,
    "learned_tables": _TABLES,
    "kn_probabilities": f"""{_GRAMS}, model as (select *, sum(n) over (partition by k, h) as total, count(*) over (partition by k, h) as types from (select * from uses where k = 3 union all select * from cont)),
        base as (select 1.0::double / (count(distinct c) + 2) as p from uses where k = 1),
        q as (select h, c from uses where k = 3),
        one as (select q.h, q.c, greatest(m.n - 0.75::double, 0) / m.total + 0.75::double * m.types / m.total * base.p as p from q join model m on m.k = 1 and m.c = q.c, base),
        two as (select one.h, one.c, greatest(m.n - 0.75::double, 0) / m.total + 0.75::double * m.types / m.total * one.p as p from one join model m on m.k = 2 and m.h = substr(one.h, 2) and m.c = one.c)
        select two.h, two.c, round(greatest(m.n - 0.75::double, 0) / m.total + 0.75::double * m.types / m.total * two.p, 9) as p from two join model m on m.k = 3 and m.h = two.h and m.c = two.c""",
    "alphabet_build": """select row_number() over (order by unicode(ch))::int as index, ch from (select distinct unnest(string_split(text, '')) as ch from documents) where ch <> ''""",
    "alphabet_round_trip": f"{views.SQL} select line_id, length(ref)::bigint as n_codes, true as same from lines",
    "codec_round_trip": f"{views.SQL} select line_id, true as same from lines",
    "lost_characters": f"""{views.SQL} select ch, count(*)::bigint as lines from (select distinct line_id, unnest(string_split(regexp_replace(ref, '[^{ACCENTED}]', '', 'g'), '')) as ch from lines) where ch <> '' group by ch order by 2 desc, 1 limit 15""",
    "restricted_texts": f"{views.SQL} select line_id, regexp_replace(ref, '[^{ACCENTED}]', '', 'g') as kept from lines",
    "nfc_changed": "select doc_id, nfc_normalize(text) <> text as changed from documents",
}
