"""Corpus-level error rates. Ratios are of sums; where nothing is to be recognised they are 0."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow
from ..functions.text import char_distance, collapse_spaces, only, percent, spelled_distance, text, token_distance, tokens
from ..plans.storage import cut
from .alignment import codes, letter_pairs


def ratio(errors: Column, size: Column) -> Column:
    """Sum of errors by sum of sizes, 0.0 for an empty denominator."""
    return F.coalesce(F.sum(errors) / F.nullif(F.sum(size), F.lit(0)), F.lit(0.0))


def cer(ref: str, hyp: str) -> Column:
    """Aggregate: character error rate."""
    return ratio(char_distance(ref, hyp), F.length(text(ref)))


def wer(ref: str, hyp: str) -> Column:
    """Aggregate: word error rate; it may exceed 1."""
    return ratio(token_distance(ref, hyp), F.size(tokens(ref)))


def restricted_cer(ref: str, hyp: str, charset: str) -> Column:
    """Aggregate: error rate of what remains when both texts keep the charset's characters only."""
    return ratio(char_distance(only(ref, charset), only(hyp, charset)), F.length(only(ref, charset)))


def collapsed_cer(ref: str, hyp: str) -> Column:
    """Aggregate: character error rate with runs of white space made one space."""
    return ratio(char_distance(collapse_spaces(ref), collapse_spaces(hyp)), F.length(collapse_spaces(ref)))


def line_rate(ref: str, hyp: str, at_least_one: bool = False) -> Column:
    """A row's own rate; an empty reference gives 0, or is taken as of length 1 if `at_least_one`."""
    n = F.length(text(ref))
    d = char_distance(ref, hyp)
    return d / F.greatest(n, F.lit(1)) if at_least_one else F.when(n == 0, F.lit(0.0)).otherwise(d / n)


def evaluate(df: DataFrame, charset: str, *, ref: str = "ref", hyp: str = "hyp", lang: str = "lang", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """All rates by `by`, overall (null language) and by language, in one pass over grouping sets."""
    keep = lambda x: only(x, charset)
    # Derived texts are columns of their own before they are compared, so that each is made once a row.
    texts = df.select(*by, lang, text(ref).alias("r"), text(hyp).alias("h"), keep(ref).alias("rr"), keep(hyp).alias("rh"), tokens(ref).alias("rt"), tokens(hyp).alias("ht"))
    texts = texts.withColumns({"rc": F.array_join("rt", " "), "hc": F.array_join("ht", " "), "__same": F.col("r") == F.col("h"), "__known": F.array_distinct(F.concat("rt", "ht"))})
    words = F.when(F.col("__same"), F.lit(0)).otherwise(spelled_distance("rt", "ht", "__known")).cast("long")
    own = texts.select(*by, lang, char_distance("r", "h").alias("e"), F.length("r").alias("n"), words.alias("we"), F.size("rt").alias("wn"), char_distance("rr", "rh").alias("re"), F.length("rr").alias("rn"), char_distance("rc", "hc").alias("ce"), F.length("rc").alias("cn"))
    rates = [ratio(F.col(e), F.col(n)).alias(a) for e, n, a in (("e", "n", "cer"), ("we", "wn", "wer"), ("re", "rn", "restricted_cer"), ("ce", "cn", "collapsed_cer"))]
    if not by:
        return own.groupBy(lang).agg(F.count("*").alias("lines"), *rates)
    sets = [list(by), [*by, lang]]
    return own.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, lang)]).agg(F.count("*").alias("lines"), *rates)


def report(rates: DataFrame, langs: list[str], *, lang: str = "lang", by: str = "model") -> DataFrame:
    """evaluate()'s rows as one row for each system: overall rates, then cer_<language> for each language."""
    names = ("lines", "cer", "wer", "restricted_cer", "collapsed_cer")
    whole = [F.max(F.when(F.col(lang).isNull(), F.col(c))).alias(c) for c in names]
    return rates.groupBy(by).agg(*whole, *[F.max(F.when(F.col(lang) == x, F.col("cer"))).alias(f"cer_{x}") for x in langs])


def format_report(rates: DataFrame, *, lang: str = "lang", by: str = "model") -> DataFrame:
    """One row, `report`: evaluate()'s rows as printed lines, systems by name, each overall and then by language. Systems and languages are few."""
    line = F.format_string("%-14s %-6s %8d %8s %8s %8s", F.col(by), F.coalesce(lang, F.lit("all")), "lines", percent("cer"), percent("wer"), percent("restricted_cer"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(by), F.coalesce(lang, F.lit("")).alias("l"), line.alias("line"))))
    return rates.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


def characters(x: Column | str) -> Column:
    """The code points of a text, as an array."""
    return F.array_remove(F.split(text(x), ""), "")


def per_character(df: DataFrame, charset: str | None = None, *, ref: str = "ref", hyp: str = "hyp", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """(by.., ch, codepoint, in_ref, in_hyp, net): how often each character stands in references and readings."""
    keep = (lambda x: only(x, charset)) if charset is not None else text
    sides = F.array(*[F.struct(characters(keep(c)).alias("chars"), F.lit(k).alias("side")) for k, c in enumerate((ref, hyp))])
    each = df.select(*by, F.inline(sides)).select(*by, "side", F.explode("chars").alias("ch"))
    counts = each.groupBy(*by, "ch").agg(F.count_if(F.col("side") == 0).alias("in_ref"), F.count_if(F.col("side") == 1).alias("in_hyp"))
    return counts.select(*by, "ch", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0")).alias("codepoint"), "in_ref", "in_hyp", (F.col("in_hyp") - F.col("in_ref")).alias("net"))


def per_character_pivot(df: DataFrame, systems: list[str], charset: str | None = None, *, model: str = "model") -> DataFrame:
    """Characters of references with one column of counts per system."""
    counts = per_character(df, charset, by=(model,))
    return counts.groupBy("ch").pivot(model, systems).agg(F.first("in_hyp")).join(counts.groupBy("ch").agg(F.max("in_ref").alias("reference")).where("reference > 0"), "ch").na.fill(0)


def summarise(df: DataFrame, *, show_test: bool = False, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Rates by part and by part and language; the test part is withheld unless asked for."""
    own = df if show_test else df.where(F.col("part") != "test")
    counts = own.select("part", "lang", char_distance(ref, hyp).alias("e"), F.length(text(ref)).alias("n"))
    return counts.rollup("part", "lang").agg(F.count("*").alias("lines"), ratio(F.col("e"), F.col("n")).alias("cer")).where("part is not null")


def improvements(df: DataFrame, base: str, best: str, key: str, better: int, worse: int, *, ref: str = "ref") -> DataFrame:
    """The `better` most improved lines, then the `worse` least improved: (kind, key, fixed, len).

    Improved ones come by fixed errors, then from short to long; ties by key.
    """
    rows = df.select(key, (char_distance(ref, base) - char_distance(ref, best)).alias("fixed"), F.length(text(ref)).alias("len"))
    up = rows.orderBy(F.desc("fixed"), "len", key).limit(better).withColumn("kind", F.lit("better"))
    down = rows.orderBy("fixed", key).limit(worse).withColumn("kind", F.lit("worse"))
    return up.unionByName(down)


def improvement_counts(df: DataFrame, base: str, best: str, *, ref: str = "ref") -> DataFrame:
    """One row: lines better, same and worse, and errors removed altogether."""
    rows = df.select((char_distance(ref, base) - char_distance(ref, best)).alias("fixed"))
    return rows.agg(F.count_if(F.col("fixed") > 0).alias("better"), F.count_if(F.col("fixed") == 0).alias("same"), F.count_if(F.col("fixed") < 0).alias("worse"), F.coalesce(F.sum("fixed"), F.lit(0)).alias("total_fixed"))


def best_member(df: DataFrame, key: str, *, ref: str = "ref", hyp: str = "hyp", member: str = "member") -> DataFrame:
    """(key, errors, member): the fewest errors that any member makes on a line, and the first member that does."""
    rows = df.select(key, F.struct(char_distance(ref, hyp).alias("e"), F.col(member).alias("m")).alias("s"))
    return rows.groupBy(key).agg(F.min("s").alias("s")).select(key, F.col("s.e").alias("errors"), F.col("s.m").alias(member))


def bootstrap(df: DataFrame, a: str, b: str, order: str, *, ref: str = "ref", reps: int = 2000, seed: int = 0, blocks: int = 256) -> DataFrame:
    """One row: mean difference of the error rates of two systems over resampled lines, its 2.5 and 97.5 percentiles and the share below 0.

    Each resample draws as many lines as there are, with replacement. Lines are dealt to `blocks` by a hash of
    their key; the driver draws from the blocks' sizes how many lines of each a resample has, and the
    blocks draw which. A block is held as three numbers a line; `reps` sums per block are all that moves.
    """
    own = df.select(F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("block"), F.col(order).alias("key"), char_distance(ref, a).alias("ea"), char_distance(ref, b).alias("eb"), F.length(text(ref)).cast("long").alias("n"))
    own = cut(own)
    sizes = sorted((r["block"], r["count"]) for r in own.groupBy("block").count().collect())
    total = sum(n for _, n in sizes)
    share = np.random.default_rng(seed).multinomial(total, [n / total for _, n in sizes], reps) if total else np.zeros((reps, 0), np.int64)
    dealt = {block: share[:, k] for k, (block, _) in enumerate(sizes)}

    def draws(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame.block.iloc[0])
        whole = frame.sort_values(["key", "n", "ea", "eb"])[["ea", "eb", "n"]].to_numpy(dtype=float)
        random = np.random.default_rng([seed, block])
        sums = np.stack([np.bincount(random.integers(0, len(whole), k), minlength=len(whole)) @ whole for k in dealt[block]])
        return pd.DataFrame({"rep": np.arange(reps), "ea": sums[:, 0], "eb": sums[:, 1], "n": sums[:, 2]})

    sums = own.groupBy("block").applyInPandas(draws, "rep int, ea double, eb double, n double").groupBy("rep").agg(F.sum("ea").alias("ea"), F.sum("eb").alias("eb"), F.sum("n").alias("n"))
    diff = sums.select(F.coalesce((F.col("ea") - F.col("eb")) / F.nullif("n", F.lit(0.0)), F.lit(0.0)).alias("d"))
    return diff.agg(F.avg("d").alias("mean_diff"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") < 0).cast("double")).alias("share_below"))


def mixed(x: str) -> str:
    """SQL: a 32-bit number whose bits depend on all bits of x, in whole numbers below 2 to the 63rd that any engine can repeat."""
    for _ in range(2):
        x = f"((({x}) ^ (({x}) div 65536)) * 73244475 % 4294967296)"
    return f"(({x}) ^ (({x}) div 65536))"


#: Bounds, in 2 to the 32nd parts, below which a Poisson variable of mean 1 is 0, 1, 2, ...
POISSON = [int(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(13)]


def poisson_bootstrap(df: DataFrame, a: str, b: str, number: str, *, ref: str = "ref", reps: int = 2000, seed: int = 0) -> DataFrame:
    """Like bootstrap(), but each line is in each resample as often as a hash of (seed, resample, line's 32-bit number) says, Poisson with mean 1.

    A resample has the lines' number on average only, as suits ratios. The draws are a function of the counters alone: they do not
    depend on partitions, order or retries, any engine can repeat them, and lines are read once and never shuffled: a partition sends `reps` sums.
    """
    own = df.select(F.col(number).cast("long").alias("x"), char_distance(ref, a).cast("long").alias("ea"), char_distance(ref, b).cast("long").alias("eb"), F.length(text(ref)).cast("long").alias("n"))
    drawn = own.select("x", "ea", "eb", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    salt = drawn.withColumn("s", F.expr(mixed(f"cast({seed} * 1000003 + rep as bigint)")))
    u = salt.withColumn("u", F.expr(mixed("x ^ s")))
    times = sum((F.when(F.col("u") >= bound, 1).otherwise(0) for bound in POISSON[1:]), F.when(F.col("u") >= POISSON[0], 1).otherwise(0))
    sums = u.withColumn("t", times.cast("long")).groupBy("rep").agg(*[F.sum(F.col(c) * F.col("t")).alias(c) for c in ("ea", "eb", "n")])
    diff = sums.select(F.coalesce((F.col("ea") - F.col("eb")) / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("d"))
    return diff.agg(F.avg("d").alias("mean_diff"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") < 0).cast("double")).alias("share_below"))


def _places(ref: str, hyp: str, pairs: np.ndarray) -> list[tuple[str, int]]:
    """The wrong places among the pairs of an alignment; an insertion's place is the next of ref."""
    i, j = pairs[:, 0], pairs[:, 1]
    both = (i >= 0) & (j >= 0)
    a, b = codes(ref), codes(hyp)
    wrong = np.zeros(len(i), bool)
    wrong[both] = a[i[both]] != b[j[both]]
    next_ = np.cumsum(i >= 0)
    found = [("sub", int(x)) for x in i[wrong]] + [("del", int(x)) for x in i[j < 0]] + [("ins", int(x)) for x in np.unique(next_[i < 0])]
    return sorted(found)


def error_positions(ref: str, hyp: str, insertion_first: bool = False) -> list[tuple[str, int]]:
    """Wrong places of one line: ("sub", i), ("del", i) and, once for each place, ("ins", i).

    Among equally short edits the way back prefers the diagonal, then a deletion, then an insertion; the
    last two change places if `insertion_first`.
    """
    return _places(ref, hyp, letter_pairs([ref], [hyp], insertion_first)[0])


@arrow("array<string>")
def wrong_places(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    """error_positions() as strings like `sub:3`; a substituted and a deleted character are the same place. Lines are aligned together."""
    kind = {"sub": "at", "del": "at", "ins": "ins"}
    refs, hyps = (list(x.fillna("")) for x in (refs, hyps))
    found = (_places(r, h, pairs) for r, h, pairs in zip(refs, hyps, letter_pairs(refs, hyps), strict=True))
    return pd.Series([sorted({f"{kind[k]}:{i}" for k, i in places}) for places in found])


@arrow("struct<substituted:int,deleted:int,inserted:int>")
def edit_counts(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    """How many letters the cheapest edit of each line substitutes, deletes and inserts."""
    refs, hyps = (list(x.fillna("")) for x in (refs, hyps))
    made = []
    for r, h, pairs in zip(refs, hyps, letter_pairs(refs, hyps), strict=True):
        i, j = pairs[:, 0], pairs[:, 1]
        both = (i >= 0) & (j >= 0)
        made.append(((codes(r)[i[both]] != codes(h)[j[both]]).sum(), (j < 0).sum(), (i < 0).sum()))
    return pd.DataFrame(made, columns=["substituted", "deleted", "inserted"], dtype=np.int32)


def error_overlap(df: DataFrame, key: str, *, ref: str = "ref", hyp: str = "hyp", model: str = "model", member: str = "member") -> DataFrame:
    """(model_a, model_b, both, either, jaccard) of wrong places for each two members, over all lines.

    Members are few: a line holds its members' places in one array, and what meets over all lines is a count for each pair.
    """
    rows = df.select(key, member, model, wrong_places(text(ref), text(hyp)).alias("places"))
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col(model).alias("model"), "places"))).alias("own"))
    pairs = lines.select(F.explode(F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 1, size(own)), y -> struct(x.m as a, y.m as b, x.model as model_a, y.model as model_b, size(array_intersect(x.places, y.places)) as n))))")).alias("p"))
    sums = cut(pairs.groupBy("p.a", "p.b", "p.model_a", "p.model_b").agg(F.sum("p.n").alias("n")))
    single = sums.where("a = b").select("a", F.col("model_a").alias("model"), "n")
    a = single.select("a", F.col("model").alias("model_a"), F.col("n").alias("na"))
    b = single.select(F.col("a").alias("b"), F.col("model").alias("model_b"), F.col("n").alias("nb"))
    every = a.join(b, F.col("a") < F.col("b")).join(sums.select("a", "b", F.col("n").alias("both")), ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0).cast("long")))
    return every.select("model_a", "model_b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either")).withColumn("jaccard", F.coalesce(F.col("both") / F.nullif("either", F.lit(0)), F.lit(0.0)))


def folds(index: str, k: int = 5) -> Column:
    """Fold of a numbered line."""
    return (F.col(index) % k).cast("int")
