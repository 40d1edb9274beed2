"""Error rates, splits and relational queries over lines of the given documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_distance, crc_half
from ..operators import metrics, selection
from . import views
from .storage import numbered, sized, table

#: The accented letters of the documents' languages play the part of a restricted alphabet.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñßÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÇÑ"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


def cer_by_model_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.evaluate(views.predictions(spark, sf_dir), ACCENTED)
    return _rounded(rows.select("model", "lang", "lines", "cer"), "cer")


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.evaluate(views.predictions(spark, sf_dir), ACCENTED), "cer", "wer", "restricted_cer", "collapsed_cer")


def cer_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).select("line_id", "model", F.round(metrics.line_rate("ref", "hyp"), 9).alias("rate"), F.round(metrics.line_rate("ref", "hyp", True), 9).alias("rate1"))


def best_member_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_member(views.predictions(spark, sf_dir), "line_id")


def per_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_character(views.predictions(spark, sf_dir)).select("model", "ch", "codepoint", "in_ref", "in_hyp", "net")


def per_char_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_character_pivot(views.predictions(spark, sf_dir), list(views.MEMBERS), ACCENTED)


def summarise_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summarise(views.predictions(spark, sf_dir)), "cer")


def _two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("line_id", "ref", F.replace("ref", F.lit("th"), F.lit("t")).alias("base"), F.translate("ref", "eé", "ae").alias("best"))


def improvement_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.improvements(_two_systems(spark, sf_dir), "base", "best", "line_id", 20, 10).withColumn("len", F.col("len").cast("long"))


def improvement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.improvement_counts(_two_systems(spark, sf_dir), "base", "best")


def bootstrap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(_two_systems(spark, sf_dir), "base", "best", "line_id")


def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same difference by draws that hashes of counters make, which SQL repeats."""
    rows = _two_systems(spark, sf_dir).withColumn("number", F.conv(F.substring(F.md5("line_id"), 1, 8), 16, 10).cast("long"))
    return _rounded(metrics.poisson_bootstrap(rows, "base", "best", "number"), "mean_diff", "low", "high", "share_below")


def val_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    half = F.when(crc_half("doc_id") == 0, "valA").otherwise("valB")
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "test").otherwise(half).alias("part"))


def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(views.lines(spark, sf_dir).select("part", "line_id"), "part", "line_id")
    return rows.select("part", "line_id", "index", metrics.folds("index").alias("fold"))


def member_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each two members read a line alike."""
    rows = views.predictions(spark, sf_dir).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("member", "model", "hyp"))).alias("h"))
    pairs = rows.select(F.inline(F.expr("flatten(transform(h, (a, i) -> transform(slice(h, i + 2, size(h)), b -> struct(a.model as model_a, b.model as model_b, a.hyp as x, b.hyp as y))))")))
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("lines"), F.count_if(F.col("x") == F.col("y")).alias("alike"), F.sum(char_distance("x", "y")).alias("edits"))


def complete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that every table of labels and lines covers: relational division over three label kinds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kinds = labels.select("doc_id", F.explode(F.array(F.lit("any"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 0, "clean"))).alias("kind")).where("kind is not null")
    return selection.complete(kinds.join(docs.select("doc_id", "lang"), "doc_id"), ["doc_id", "lang"], "kind", 3)


def uncovered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark items that documents hold as a line, with the number of documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return own.join(sized(items, 400), "line").groupBy("item_id", "line").agg(F.countDistinct("doc_id").alias("documents"))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).select("lang", F.length("ref").cast("long").alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("lines"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 9).alias("mean"))


def sampler_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return selection.sampling_weights(docs.select("doc_id", "lang"), "lang").select("doc_id", F.round("weight", 12).alias("weight"))


def sampler_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as there are, drawn with replacement so that languages are drawn alike."""
    docs = selection.sampling_weights(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")
    own = docs.withColumn("share", F.floor(F.col("weight") * 1e6 + 0.5).cast("long"))
    return selection.drawn(own, "share", own.count(), "doc_id", seed=3).select("draw", "doc_id", "lang")


def member_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of two or more members in best-first order, with their best member's errors."""
    single = views.predictions(spark, sf_dir).groupBy("member", "model").agg(F.sum(F.levenshtein("ref", "hyp")).alias("errors"))
    return selection.subsets(single, "model", "errors", "member")


QUERIES = {f.__name__: f for f in (cer_by_model_lang, error_rates, cer_per_line, best_member_per_line, per_char_counts, per_char_pivot, summarise_parts, improvement_picks, improvement_counts, bootstrap_diff, bootstrap_poisson, val_half_split, cv_folds, member_pairs, complete_lines, uncovered_docs, benchmark_lines, length_stats, sampler_weights, sampler_draws, member_subsets)}

_V = views.SQL


def _ascii(x: str) -> str:
    """SQL that maps every accented letter to a control character: levenshtein() counts bytes there."""
    codes = [c for c in range(1, 32) if c not in (9, 10, 13)]
    letters = "éèêçàâäöüßñóíáúÉÈÊÇÄÖÜÑÓÍÁÚ"
    to = " || ".join(f"chr({c})" for c in codes[: len(letters)])
    return f"translate({x}, '{letters}', {to})"


def _lev(a: str, b: str) -> str:
    return f"levenshtein({_ascii(a)}, {_ascii(b)})"


WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_RESTRICT = "regexp_replace({x}, '[^" + ACCENTED + "]', '', 'g')"
_COLLAPSE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

#: Distance of token lists a and b by rows of the table, each a list.
TOKENS = """list_reduce(
    list_prepend({{'w': '', 'r': range(0, len(b) + 1)}}, list_transform(a, lambda w: {{'w': w, 'r': []::bigint[]}})),
    lambda p, x: {{'w': '', 'r': list_reduce(list_prepend([p.r[1] + 1], list_transform(range(1, len(b) + 1), lambda j: [j])),
        lambda row, jj: row || [least(p.r[jj[1] + 1] + 1, row[jj[1]] + 1, p.r[jj[1]] + (case when x.w = b[jj[1]] then 0 else 1 end))])}}).r[-1]""".replace("{{", "{").replace("}}", "}")

def mixed_sql(x: str) -> str:
    """SQL of metrics' mixing of 32-bit numbers."""
    for _ in range(2):
        x = f"(xor({x}, ({x}) // 65536) * 73244475 % 4294967296)"
    return f"xor({x}, ({x}) // 65536)"


ORACLE_SQL = {
    "sampler_draws": f"""with w as (select doc_id, lang, floor(1.0::double / count(*) over (partition by lang) * 1000000 + 0.5)::bigint as w from documents),
        ends as (select doc_id, lang, sum(w) over (order by doc_id) as upto, w from w), n as (select sum(w)::bigint as total, count(*) as n from w),
        draws as (select j as draw, ({mixed_sql('(3000009 + 2 * j) % 4294967296')} * 1073741824 + {mixed_sql('(3000009 + 2 * j + 1) % 4294967296')} % 1073741824) % total as at_ from (select unnest(range(n))::bigint as j, total from n))
        select draw, doc_id, lang from draws join ends on at_ >= upto - w and at_ < upto""",
    "bootstrap_poisson": f"""{_V}, own as (select ('0x' || substr(md5(line_id), 1, 8))::bigint as x, {_lev('ref', "replace(ref, 'th', 't')")} as ea, {_lev('ref', "translate(ref, 'eé', 'ae')")} as eb, length(ref) as n from lines),
        salts as (select r, {mixed_sql('r')} as s from (select unnest(range(2000))::bigint as r)),
        drawn as (select r, ea, eb, n, {mixed_sql('xor(x, s)')} as u from own, salts),
        times as (select r, ea, eb, n, {' + '.join(f'(u >= {b})::int' for b in metrics.POISSON)} as t from drawn),
        sums as (select r, sum(ea * t) as ea, sum(eb * t) as eb, sum(n * t) as n from times group by r),
        diffs as (select coalesce((ea - eb) / nullif(n, 0), 0)::double as d from sums)
        select round(avg(d), 9) as mean_diff, round(quantile_cont(d, 0.025), 9) as low, round(quantile_cont(d, 0.975), 9) as high, round(avg((d < 0)::int), 9) as share_below from diffs""",
    "cer_by_model_lang": f"""{_V} select model, lang, count(*)::bigint as lines, round(coalesce(sum({_lev('ref', 'hyp')}) / nullif(sum(length(ref)), 0), 0), 9)::double as cer from preds group by grouping sets ((model), (model, lang))""",
    "error_rates": f"""{_V}, parts as (select model, lang, {_lev('ref', 'hyp')} as e, length(ref) as n, {WORDS.format(x='ref')} as a, {WORDS.format(x='hyp')} as b, {_RESTRICT.format(x='ref')} as rr, {_RESTRICT.format(x='hyp')} as rh, {_COLLAPSE.format(x='ref')} as cr, {_COLLAPSE.format(x='hyp')} as ch from preds),
        counted as (select model, lang, e, n, {TOKENS} as we, len(a) as wn, {_lev('rr', 'rh')} as re, length(rr) as rn, {_lev('cr', 'ch')} as ce, length(cr) as cn from parts)
        select model, lang, count(*)::bigint as lines, round(coalesce(sum(e) / nullif(sum(n), 0), 0), 9)::double as cer, round(coalesce(sum(we) / nullif(sum(wn), 0), 0), 9)::double as wer,
            round(coalesce(sum(re) / nullif(sum(rn), 0), 0), 9)::double as restricted_cer, round(coalesce(sum(ce) / nullif(sum(cn), 0), 0), 9)::double as collapsed_cer
        from counted group by grouping sets ((model), (model, lang))""",
    "cer_per_line": f"""{_V} select line_id, model, round({_lev('ref', 'hyp')} / length(ref), 9)::double as rate, round({_lev('ref', 'hyp')} / length(ref), 9)::double as rate1 from preds""",
    "best_member_per_line": f"""{_V} select line_id, min(e)::bigint as errors, min_by(member, e * 10 + member)::int as member from (select line_id, member, {_lev('ref', 'hyp')} as e from preds) group by line_id""",
    "per_char_counts": f"""{_V}, each as (select model, unnest(string_split(ref, '')) as ch, 0 as side from preds union all select model, unnest(string_split(hyp, '')), 1 from preds)
        select model, ch, 'U+' || lpad(upper(printf('%x', unicode(ch))), 4, '0') as codepoint, count(*) filter (side = 0)::bigint as in_ref, count(*) filter (side = 1)::bigint as in_hyp,
            (count(*) filter (side = 1) - count(*) filter (side = 0))::bigint as net from each where ch <> '' group by model, ch""",
    "per_char_pivot": f"""{_V}, each as (select model, unnest(string_split({_RESTRICT.format(x='hyp')}, '')) as ch from preds), refs as (select unnest(string_split({_RESTRICT.format(x='ref')}, '')) as ch from lines)
        select ch, coalesce(drop_h, 0)::bigint as drop_h, coalesce(keep, 0)::bigint as keep, coalesce(swap_e, 0)::bigint as swap_e, reference from
            (select ch, count(*)::bigint as reference from refs where ch <> '' group by ch)
            left join (select ch, count(*) filter (model = 'drop_h') as drop_h, count(*) filter (model = 'keep') as keep, count(*) filter (model = 'swap_e') as swap_e from each group by ch) using (ch)""",
    "summarise_parts": f"""{_V} select part, lang, count(*)::bigint as lines, round(sum({_lev('ref', 'hyp')}) / sum(length(ref)), 9)::double as cer from preds where part <> 'test' group by grouping sets ((part), (part, lang))""",
    "improvement_picks": f"""{_V}, rows as (select line_id, {_lev('ref', "replace(ref, 'th', 't')")} - {_lev('ref', "translate(ref, 'eé', 'ae')")} as fixed, length(ref)::bigint as len from lines)
        select * from (select line_id, fixed::bigint as fixed, len, 'better' as kind from rows order by fixed desc, len, line_id limit 20)
        union all select * from (select line_id, fixed::bigint, len, 'worse' from rows order by fixed, line_id limit 10)""",
    "improvement_counts": f"""{_V}, rows as (select {_lev('ref', "replace(ref, 'th', 't')")} - {_lev('ref', "translate(ref, 'eé', 'ae')")} as fixed from lines)
        select count(*) filter (fixed > 0)::bigint as better, count(*) filter (fixed = 0)::bigint as same, count(*) filter (fixed < 0)::bigint as worse, sum(fixed)::bigint as total_fixed from rows""",
    "val_half_split": f"""{_V} select doc_id, part from halves""",
    "cv_folds": f"""{_V}, numbered as (select part, line_id, row_number() over (order by part, line_id) - 1 as index from lines) select part, line_id, index::bigint as index, (index % 5)::int as fold from numbered""",
    "member_pairs": f"""{_V} select a.model as model_a, b.model as model_b, count(*)::bigint as lines, count(*) filter (a.hyp = b.hyp)::bigint as alike, sum({_lev('a.hyp', 'b.hyp')})::bigint as edits from preds a join preds b on a.line_id = b.line_id and a.member < b.member group by 1, 2""",
    "complete_lines": """select doc_id, lang from documents join labels using (doc_id) where quality = 1 and toxic = 0 group by doc_id, lang""",
    "uncovered_docs": """select doc_id, lang from documents where doc_id not in (select doc_id from labels)""",
    "benchmark_lines": """with items as (select distinct item_id, unnest(string_split(text, chr(10))) as line from benchmark), own as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        select item_id, line, count(distinct doc_id)::bigint as documents from items join own using (line) where line <> '' group by 1, 2""",
    "length_stats": f"""{_V} select lang, count(*)::bigint as lines, min(length(ref))::bigint as shortest, max(length(ref))::bigint as longest, round(avg(length(ref)), 9) as mean from lines group by lang""",
    "sampler_weights": """select doc_id, round(1.0::double / count(*) over (partition by lang), 12) as weight from documents""",
    "member_subsets": f"""{_V}, single as (select member, model, sum({_lev('ref', 'hyp')})::bigint as errors from preds group by 1, 2), ranked as (select *, row_number() over (order by errors, member) as r from single)
        select string_agg(model, '+' order by r) as members, count(*)::int as size, min(errors)::bigint as best_errors from ranked, (select unnest(range(1, 8)) as mask) where ((mask >> (r - 1)::int) & 1) = 1 group by mask having count(*) >= 2""",
}
