"""Lines and synthetic recogniser members derived from the given tables; every text is covered whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import spread, table

#: Characters of a line at most; longer ones continue on the next.
LINE = 100
MEMBERS = ("drop_h", "keep", "swap_e")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, doc_id, lang, source, part, ref): all text of documents in lines of 1 to LINE characters."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("row", "whole"))
    cut = docs.where(F.length("whole") > 0).withColumn("at", F.explode(F.expr(f"sequence(0, (length(whole) - 1) div {LINE})")))
    part = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, "valA").otherwise("valB")
    return cut.select(
        F.concat_ws("_", "doc_id", "row", "at").alias("line_id"), "doc_id", "lang", "source",
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise(part).alias("part"),
        F.expr(f"substring(whole, at * {LINE} + 1, {LINE})").alias("ref"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with one row per member: (model, member, hyp). The members make fixed edits, so both engines can derive them."""
    made = (("drop_h", F.replace("ref", F.lit("th"), F.lit("t"))), ("keep", F.replace("ref", F.lit("ou"), F.lit("u"))), ("swap_e", F.translate("ref", "eé", "ae")))
    edits = F.array(*[F.struct(F.lit(i).alias("member"), F.lit(m).alias("model"), h.alias("hyp")) for i, (m, h) in enumerate(made)])
    return lines(spark, sf_dir).select("*", F.inline(edits))


#: The recognisers of readings(), in member order.
READERS = ("schwa", "keep", "drop")
#: SQL: which lines miss their first letter in the last one's reading, and the texts that they read.
_DROPPED = "length(ref) > 1 and (doc_id + length(ref)) % 3 = 0"
_READ = ("translate(ref, 'e', 'ə')", "ref", "translate(if(dropped, substring(ref, 2), ref), 'eo', 'ɘɔ')")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with one row per member: (model, member, hyp, conf).

    The first writes another letter for `e`, the second reads all rightly, the third writes others again for
    `e` and `o` and misses the first letter of a third of the lines. No letter that they make up stands in a
    text, so columns of their alignment are the places of `ref`, and both engines can derive them.
    """
    own = lines(spark, sf_dir).withColumn("dropped", F.expr(_DROPPED))
    rows = own.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("member"), F.lit(m).alias("model"), F.expr(h).alias("hyp")) for i, (m, h) in enumerate(zip(READERS, _READ, strict=True))])))
    return rows.withColumn("conf", F.expr("transform(sequence(1, length(hyp)), i -> ((i * 7 + member * 31 + doc_id) % 101) / 100.0D)"))


#: The confidences that readings() have, in the order of letters, twice as long as their period and so at hand for every begin.
_CONFIDENCES = [(7 * j % 101) / 100.0 for j in range(101 + LINE)]


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with `hyps`, their readings() in member order: array<struct<member, model, text, conf>>."""
    own = lines(spark, sf_dir).withColumn("dropped", F.expr(_DROPPED))
    texts = own.select("*", *[F.expr(h).alias(f"__{i}") for i, h in enumerate(_READ)])

    def conf(i: int) -> Column:
        each = F.expr(f"transform(sequence(1, length(__{i})), i -> ((i * 7 + {i} * 31 + doc_id) % 101) / 100.0D)")
        # The same numbers as a part of a fixed list, as 29 * 7 is 1 modulo 101.
        part = F.slice(F.lit(_CONFIDENCES), F.expr(f"cast(({i} * 31 + doc_id) % 101 * 29 % 101 + 2 as int)"), F.length(f"__{i}"))
        return F.when(F.col("doc_id") >= 0, part).otherwise(each)

    hyps = F.array(*[F.struct(F.lit(i).alias("member"), F.lit(m).alias("model"), F.col(f"__{i}").alias("text"), conf(i).alias("conf")) for i, m in enumerate(READERS)])
    return texts.select(*own.columns, hyps.alias("hyps"))


#: Latin letters and the letters and marks of the script that mixed() and ajami() put in their place.
MIXED = ("abdeou", "ابدَرُ")
AJAMI = ("bdfklmnrstzaiu", "بدفكلمنرستزَُِ")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with `mixed`: some letters are those of the other script, some its vowel signs."""
    return lines(spark, sf_dir).withColumn("mixed", F.translate("ref", *MIXED))


def ajami(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with `ajami`: what of a line can be written in consonants and vowel signs of the script, and `latin`, the letters that these stand for."""
    rows = lines(spark, sf_dir).withColumn("latin", F.regexp_replace(F.lower("ref"), "[^bdfklmnrstzaiu ]", ""))
    return rows.withColumn("ajami", F.translate("latin", *AJAMI))


#: For each letter a syllable of the script and what it spells: short and long vowels, doubled and bare consonants, glides, nunation, both final forms of a long a.
SYLLABLES = {
    "a": ("بَ", "ba"), "b": ("بُو", "bo"), "c": ("بِي", "bi"), "d": ("بٜيٰ", "be"), "e": ("بَّ", "bba"), "f": ("با", "ba"), "g": ("بَيْ", "bai"), "h": ("بَوْ", "bau"), "i": ("رً", "ran"),
    "j": ("شࣷو", "sho"), "k": ("لَى", "la"), "l": ("تى", "ta"), "m": ("مٜ", "me"), "n": ("نْ", "n"), "o": ("وَ", "wa"), "p": ("يِ", "yi"), "q": ("ڢ", "f"), "r": ("ذِ", "zi"), "s": ("ࢽَا", "na"),
    "t": ("طُ", "ɗu"), "u": ("بࣸو", "bo"), "v": ("قِ", "ƙi"), "w": ("حَا", "ha"), "x": ("خّ", "khh"), "y": ("ݒُ", "bu"), "z": ("كٌ", "kun"),
}
#: What stands before a word, by its length modulo 4: nothing, a marked carrier, a bare one, the article.
BEFORE = (("", ""), ("إِ", "i"), ("ا", "a"), ("ال", "al"))


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, ajami): every line's Latin letters as SYLLABLES of the script, each word with one of BEFORE."""
    rows = lines(spark, sf_dir).select("line_id", F.expr("filter(split(regexp_replace(lower(ref), '[^a-z ]', ''), ' '), w -> w <> '')").alias("words"))
    of = F.create_map(*[F.lit(x) for letter, (ajami, _) in SYLLABLES.items() for x in (letter, ajami)])
    first = F.array(*[F.lit(a) for a, _ in BEFORE])
    word = lambda w: F.concat(F.get(first, F.length(w) % 4), F.array_join(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: of[c]), ""))
    return rows.select("line_id", F.array_join(F.transform("words", word), " ").alias("ajami"))


#: The Latin alphabet and one letter of the script for each.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, logical): lines of the script's letters with numbers, joined numbers, both kinds of digits and Latin phrases in between."""
    rows = lines(spark, sf_dir).withColumns({"a": F.translate(F.regexp_replace(F.lower("ref"), "[^a-z ]", ""), *LETTERS), "l": F.regexp_replace("ref", "[^A-Za-z ]", ""), "n": F.length("ref") * 7 + F.col("doc_id")})
    arabic = F.translate(F.col("n").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    n = F.col("n").cast("string")
    logical = F.concat(F.lit("ب "), "a", F.lit(" ب "), n, F.lit(" "), F.col("doc_id").cast("string"), F.lit(" م "), n, F.lit("/12-3 ب "), arabic, F.lit(" -٢١- "), arabic, F.lit(" ب x"), "l", F.lit("z ب"))
    return rows.select("line_id", logical.alias("logical"))


#: Readers of words(), all of whose errors are letters that words hold: (name, letters put in others' place). None is always right.
WORD_READERS = (("doubling", (("e", "ee"), ("th", "t"))), ("missing", (("an", "n"), ("o", ""))), ("swapping", (("he", "eh"), ("s", "t"))))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, model, member, hyp, conf): every different word of documents as the WORD_READERS read it."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word"))

    def read(edits: tuple[tuple[str, str], ...]) -> Column:
        out = F.col("word")
        for old, new in edits:
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    made = F.array(*[F.struct(F.lit(i).alias("member"), F.lit(name).alias("model"), read(edits).alias("hyp")) for i, (name, edits) in enumerate(WORD_READERS)])
    rows = docs.where("word <> ''").distinct().select("word", F.inline(made))
    return rows.withColumn("conf", F.expr("if(hyp = '', array(), transform(sequence(1, length(hyp)), i -> ((i * 7 + member * 31 + length(word)) % 101) / 100.0D))"))


def whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, ref, hyp): all lines of documents, of any length, as a reader that misses, doubles and swaps letters reads them."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "ref"))
    hyp = F.replace(F.replace(F.replace("ref", F.lit("th"), F.lit("t")), F.lit("er"), F.lit("re")), F.lit("on"), F.lit("oon"))
    return docs.where(F.length("ref") > 0).select(F.concat_ws("_", "doc_id", "row").alias("line_id"), "ref", hyp.alias("hyp"))


#: The same views for the oracle.
SQL = f"""
    with raw as (select doc_id, lang, source, unnest(string_split(text, chr(10))) as whole, generate_subscripts(string_split(text, chr(10)), 1) - 1 as row from documents),
    cuts as (select *, unnest(range(0, (length(whole) - 1) // {LINE} + 1)) as piece from raw where length(whole) > 0),
    tbl as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda acc, x: case when (acc & 1) = 1 then xor(acc >> 1, 3988292384::bigint) else acc >> 1 end)) as t),
    halves as (select doc_id, case when doc_id % 3 = 0 then 'test' when crc % 2 = 0 then 'valA' else 'valB' end as part, crc from (
        select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295::bigint) as crc from documents, tbl)),
    lines as (select doc_id || '_' || row || '_' || piece as line_id, doc_id, lang, source, part, substr(whole, piece * {LINE} + 1, {LINE}) as ref from cuts join halves using (doc_id)),
    preds as (
        select *, 0 as member, 'drop_h' as model, replace(ref, 'th', 't') as hyp from lines
        union all select *, 1, 'keep', replace(ref, 'ou', 'u') from lines
        union all select *, 2, 'swap_e', translate(ref, 'eé', 'ae') from lines),
    mixed as (select *, translate(ref, '{MIXED[0]}', '{MIXED[1]}') as mixed from lines),
    read as (select *, length(ref) > 1 and (doc_id + length(ref)) % 3 = 0 as dropped from lines),
    places as (select line_id, doc_id, lang, ref, dropped, unnest(range(1, length(ref) + 1)) as i from read),
    cells as (select line_id, doc_id, lang, ref, i, unnest([
        {{'m': 0, 'ch': translate(substr(ref, i, 1), 'e', 'ə'), 'gap': false, 'conf': ((i * 7 + doc_id) % 101) / 100.0::double}},
        {{'m': 1, 'ch': substr(ref, i, 1), 'gap': false, 'conf': ((i * 7 + 31 + doc_id) % 101) / 100.0::double}},
        {{'m': 2, 'ch': case when dropped and i = 1 then '' else translate(substr(ref, i, 1), 'eo', 'ɘɔ') end, 'gap': dropped and i = 1,
            'conf': case when dropped and i = 1 then null else (((i - dropped::int) * 7 + 62 + doc_id) % 101) / 100.0::double end}}]) as c from places)
"""
