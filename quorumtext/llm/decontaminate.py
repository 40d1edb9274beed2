"""Benchmark decontamination by a distributed positional inverted index.

The index keeps postings (term, document, position) of the corpus for the terms that searches
need. A phrase search starts from the rarest test terms: each window of an item is looked up by its
two rarest words, by counts over the whole corpus, and their posting lists are intersected after
subtracting the words' offsets, which leaves (document, item, diagonal) triples. Only their documents
are read again, to compare the remaining words of the windows on these diagonals.

Everything is DataFrame code: words are split, counted, indexed and compared in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, lower_ascii, sized, words

#: What ends words: every ASCII character but letters and digits; upper case is lowered before.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Bytes of a row's numbers beside its term or array, for the size check before a broadcast.
ROW_BYTES = 64
#: A term that is at least this share of all words is frequent; there are so many of them at most, whatever the corpus.
FREQUENT = 1000


def of_term(term: str = "term") -> Column:
    """A row's bytes if it holds a term and a few numbers."""
    return F.octet_length(term) + ROW_BYTES


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, words) of every row; mark tells texts of one id apart."""
    return df.select(df[key].alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), words(lower_ascii(F.col(text)), BREAKS).alias("words"))


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item, item_words, start, length): every run of `size` words, or the whole of a shorter item."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
    return items.where(n > 0).select(F.col("id").alias("item"), F.col("words").alias("item_words"), F.explode(starts).alias("start"), F.least(n, F.lit(size)).alias("length"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, id, mark, position) of the given terms (term, n): the part of the index that a search needs.

    Terms too many for a broadcast are joined by a shuffle, but for the frequent ones, which are FREQUENT at most.
    """
    each = docs.select("id", "mark", F.posexplode("words").alias("position", "term"))
    if fits(terms, of_term()):
        return each.join(F.broadcast(terms.select("term")), "term")
    total = docs.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    frequent = terms.where(F.col("n") * FREQUENT >= total).select("term")
    rest = terms.where(F.col("n") * FREQUENT < total).select("term")
    return each.join(F.broadcast(frequent), "term").unionByName(each.join(F.broadcast(frequent), "term", "left_anti").join(rest.hint("merge"), "term"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over the whole corpus; a term that does not occur has no row. Words are counted where they are before they are shuffled."""
    each = docs.select(F.explode("words").alias("term"))
    if fits(terms, of_term()):
        return each.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def probes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, start, length, first, second): offsets of the two rarest words of each window; windows with a word that the corpus lacks are left out."""
    at = wins.select("item", "start", "length", F.posexplode(F.expr("slice(item_words, start + 1, length)")).alias("offset", "term"))
    rated = at.join(sized(counts, of_term()), "term", "left").groupBy("item", "start", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("by"))
    first, second = F.col("by")[0], F.try_element_at("by", F.lit(2))
    base = F.col("start")
    return rated.where(first["n"] > 0).select("item", "start", "length", (base + first["offset"]).alias("first"), F.coalesce(base + second["offset"], base + first["offset"]).alias("second"))


def phrase_hits(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(id, mark, item, hits): for every document and item with a common window, the sorted positions it covers."""
    items = cut(items)
    wins = cut(windows(items, size).drop("item_words"))
    named = wins.join(items.select(F.col("id").alias("item"), F.col("words").alias("item_words")), "item")
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = cut(term_counts(docs, cut(terms)))
    found = cut(probes(named, counts))
    each = items.select(F.col("id").alias("item"), F.posexplode("words").alias("offset", "term"))
    needed = found.select("item", F.explode(F.array("first", "second")).alias("offset")).distinct().join(each, ["item", "offset"])
    needed = cut(needed)
    postings = index(docs, counts.join(needed.select("term").distinct(), "term"))
    lists = postings.join(sized(needed, of_term()), "term").select("id", "mark", "item", (F.col("position") - F.col("offset")).alias("diagonal"), "offset")
    met = lists.groupBy("id", "mark", "item", "diagonal").agg(F.collect_set("offset").alias("offsets"))
    pairs = found.groupBy("item").agg(F.collect_list(F.struct("start", "length", "first", "second")).alias("pairs"))
    both = "filter(pairs, p -> p.start + diagonal >= 0 and array_contains(offsets, p.first) and array_contains(offsets, p.second))"
    rated = met.join(sized(pairs, 48 * F.size("pairs") + ROW_BYTES), "item").select("id", "mark", "item", "diagonal", F.expr(f"transform({both}, p -> struct(p.start as start, p.length as length))").alias("open"))
    candidates = cut(rated.where(F.size("open") > 0))
    read = _wanted(docs, candidates)
    on = candidates.join(sized(items.select(F.col("id").alias("item"), F.col("words").alias("item_words")), 2 * F.octet_length(F.array_join("item_words", " ")) + 16 * F.size("item_words") + ROW_BYTES), "item")
    on = on.select(F.col("id").alias("cid"), F.col("mark").alias("cmark"), "item", "diagonal", "open", "item_words")
    full = read.join(on, F.col("id").eqNullSafe(F.col("cid")) & (F.col("mark") == F.col("cmark")))
    same = "filter(open, o -> slice(words, diagonal + o.start + 1, o.length) = slice(item_words, o.start + 1, o.length))"
    cover = f"flatten(transform({same}, o -> sequence(diagonal + o.start, diagonal + o.start + o.length - 1)))"
    hits = full.select("id", "mark", "item", F.expr(cover).alias("hits")).where(F.size("hits") > 0)
    return hits.groupBy("id", "mark", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))


def _wanted(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The documents of candidates, once for each id and text."""
    ids = candidates.select(F.col("id").alias("wid"), F.col("mark").alias("wmark")).distinct()
    on = F.col("id").eqNullSafe(F.col("wid")) & (F.col("mark") == F.col("wmark"))
    return docs.join(sized(ids, 40), on, "left_semi").dropDuplicates(["id", "mark"])


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, position) where all words of a phrase stand, in any order, within its length plus `slop` words.

    `position` is that of an occurrence of the phrase's rarest word, which each match must hold;
    every other word must occur at most length + slop - 1 positions from it. Words that the phrase
    repeats count once. Phrases without words, null texts and null keys match nothing.
    """
    docs, phrases = tokens(docs, key, text), cut(tokens(phrases, item, item_text).where(F.size("words") > 0))
    terms = phrases.select(F.col("id").alias("item"), F.size("words").alias("length"), F.explode(F.array_distinct("words")).alias("term"))
    counts = cut(term_counts(docs, cut(terms.select("term").distinct())))
    postings = cut(index(docs, counts))
    rated = terms.join(sized(counts, of_term()), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    needs = rated.groupBy("item", "length").agg(F.min(F.struct("n", "term")).alias("rarest"), F.count("*").alias("terms")).where("rarest.n > 0")
    # Positions are dealt to cells as wide as a match may reach, and an anchor meets its own cell and both neighbours.
    reach = F.col("length") + slop
    anchors = needs.select("item", "length", "terms", F.col("rarest.term").alias("term")).join(postings, "term").select("item", "length", "terms", "id", "mark", F.col("position").alias("anchor"))
    anchors = anchors.withColumn("cell", F.explode(F.array(*[F.floor(F.col("anchor") / reach) + k for k in (-1, 0, 1)])))
    other = terms.join(needs.select("item"), "item").join(postings, "term").select("item", "term", "id", "mark", "position", F.floor(F.col("position") / reach).alias("cell"))
    near = anchors.join(other, ["item", "id", "mark", "cell"]).where(F.abs(F.col("position") - F.col("anchor")) < reach)
    met = near.groupBy("item", "id", "mark", "anchor", "terms").agg(F.countDistinct("term").alias("found")).where("found = terms")
    return met.select(F.col("id").alias(key), F.col("item").alias(item), F.col("anchor").alias("position")).distinct()


def report(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A window is a run of `size` words of an item, or all words of a shorter one. n_hit counts the
    document's words inside any occurrence of a window, n_items the items with an occurring window;
    the digest is of their ids, sorted as strings and joined by commas. Null and empty texts have no
    words and no hits; items without words have no window. Null keys are reported like others, and
    repeated rows each. Repeated items count once by id; an id with several texts has all their windows.
    Windows of an item without an id are hits, but it is not among the items, having no id to list.
    Other columns are ignored, and an empty table on either side is no special case.
    """
    rows = tokens(docs, key, text)
    wanted = tokens(benchmark, item, item_text)
    # An id may have several texts: each is searched as an item of its own.
    listed = cut(wanted.dropDuplicates(["id", "mark"]))
    coded = listed.select(F.struct("id", "mark").alias("id"), "words")
    hits = phrase_hits(rows, coded, size).withColumn("item", F.col("item.id"))
    per_item = hits.groupBy("id", "mark").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    per_item = per_item.select(F.col("id").alias("hid"), F.col("mark").alias("hmark"), "n_hit", "items")
    counted = docs.select(docs[key].alias(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.size(words(lower_ascii(F.col(text)), BREAKS)).cast("long").alias("n_words"))
    all_rows = counted.join(per_item, F.col(key).eqNullSafe(F.col("hid")) & (F.col("mark") == F.col("hmark")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit: Column = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_rows.select(key, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
