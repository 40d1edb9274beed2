"""Networks of all different words, whose readers err within the alphabet, and edits of lines of any length; SQL aligns them by the same rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, network
from . import views
from .queries_network import _lev, _sum, _vote


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.align(network.hypotheses(views.words(spark, sf_dir), ["word"], [], conf="conf", members=len(views.WORD_READERS)))


def word_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's columns, the readers' letters side by side, a gap written as `_`."""
    columns = F.transform("network", lambda c: F.array_join(F.transform(c, lambda x: F.when(x["is_gap"], "_").otherwise(x["ch"])), ""))
    return _networks(spark, sf_dir).select("word", F.size("network").cast("long").alias("n_columns"), F.array_join(columns, " ").alias("columns"))


def word_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both votes over every word's columns, and how many letters of the confidence vote are unsure."""
    unsure = F.size(F.filter(network.certainty(), lambda x: x["unsure"])).cast("long")
    return _networks(spark, sf_dir).select("word", network.vote("majority").alias("majority"), network.vote().alias("confidence"), unsure.alias("unsure"))


def word_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest errors of any choice for every word, and those when a candidate is forced, column by column."""
    forced = F.array_join(F.transform(network.forced_costs("word"), lambda c: F.array_join(c.cast("array<string>"), ",")), " ")
    return _networks(spark, sf_dir).select("word", network.oracle_errors("word").alias("oracle"), forced.alias("forced"))


def whole_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many letters of every line, however long, an alignment substitutes, misses and adds."""
    rows = views.whole_lines(spark, sf_dir).select("line_id", metrics.edit_counts("ref", "hyp").alias("e"))
    edits = sum((F.col(f"e.{c}") for c in ("deleted", "inserted")), F.col("e.substituted"))
    return rows.select("line_id", edits.cast("long").alias("edits"), (F.col("e.inserted") - F.col("e.deleted")).cast("long").alias("longer"))


QUERIES = {f.__name__: f for f in (word_networks, word_votes, word_costs, whole_line_edits)}

_GAP = "chr(1)"


def _share(column: str, letter: str, members: int) -> str:
    """SQL: the share of a column's members that are another letter."""
    return f"({' + '.join(f'(substr({column}, {m}, 1) <> {letter})::int' for m in range(1, members + 1))})::double / {members}"


def _path(profile: str, seq: str, members: int) -> str:
    """SQL: the steps of the cheapest alignment, d, u and l, by a table row for each column."""
    diagonal = f"prev[y[1].c::int].c + {_share('x[1].p', f'substr({seq}, y[1].c::int, 1)', members)}"
    up, left = f"prev[y[1].c::int + 1].c + {_share('x[1].p', _GAP, members)}", "own[y[1].c::int].c + 1"
    cell = f"case when {left} < least({diagonal}, {up}) then {{'c': {left}, 'p': own[y[1].c::int].p || 'l'}} when {up} < {diagonal} then {{'c': {up}, 'p': prev[y[1].c::int + 1].p || 'u'}} else {{'c': {diagonal}, 'p': prev[y[1].c::int].p || 'd'}} end"
    row = f"list_reduce(list_transform(range(1, length({seq}) + 1), lambda j: [{{'c': j::double, 'p': ''}}]), lambda own, y: own || [{cell}], [{{'c': prev[1].c + {_share('x[1].p', _GAP, members)}, 'p': prev[1].p || 'u'}}])"
    return f"list_reduce(list_transform({profile}, lambda col: [{{'c': 0::double, 'p': col}}]), lambda prev, x: {row}, list_transform(range(0, length({seq}) + 1), lambda j: {{'c': j::double, 'p': repeat('l', j)}}))[-1].p"


def _columns(profile: str, seq: str, path: str, members: int) -> str:
    """SQL: the columns with one more member, by the steps."""
    step, before = f"substr({path}, s::int, 1)", f"substr({path}, 1, s::int)"
    old = f"case when {step} = 'l' then repeat({_GAP}, {members}) else {profile}[length(replace({before}, 'l', ''))] end"
    new = f"case when {step} = 'u' then {_GAP} else substr({seq}, length(replace({before}, 'u', '')), 1) end"
    return f"list_transform(range(1, length({path}) + 1), lambda s: ({old}) || ({new}))"


def _reading(edits: tuple[tuple[str, str], ...]) -> str:
    out = "word"
    for old, new in edits:
        out = f"replace({out}, '{old}', '{new}')"
    return out


_TEXTS = "[t0, t1, t2]"
_MERGED = f"""
    with words as (select distinct unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as word from documents),
    read as (select word, {', '.join(f'{_reading(edits)} as t{m}' for m, (_, edits) in enumerate(views.WORD_READERS))} from words),
    near as (select *, {_lev('t0', 't1')} as d01, {_lev('t0', 't2')} as d02, {_lev('t1', 't2')} as d12 from read),
    placed as (select word, t0, t1, t2, case when d01 <= d02 and d01 <= d12 then '012' when d02 <= d12 then '021' else '120' end as o from near),
    ordered as (select *, {_TEXTS}[substr(o, 1, 1)::int + 1] as a, {_TEXTS}[substr(o, 2, 1)::int + 1] as b, {_TEXTS}[substr(o, 3, 1)::int + 1] as c from placed),
    lists as (select *, list_filter(string_split(a, ''), lambda x: x <> '') as first from ordered),
    path1 as (select *, {_path('first', 'b', 1)} as p1 from lists),
    two as (select *, {_columns('first', 'b', 'p1', 1)} as pair from path1),
    path2 as (select *, {_path('pair', 'c', 2)} as p2 from two),
    three as (select *, {_columns('pair', 'c', 'p2', 2)} as all_ from path2),
    networks as (select word, list_transform(all_, lambda x: substr(x, strpos(o, '0'), 1) || substr(x, strpos(o, '1'), 1) || substr(x, strpos(o, '2'), 1)) as cols from three)"""
_CELLS = f""", places as (select word, cols, unnest(range(1, len(cols) + 1)) as i from networks),
    letters as (select word, i, cols, unnest([0, 1, 2]) as m from places),
    cells as (select word as line_id, i, {{'m': m, 'ch': case when ch = {_GAP} then '' else ch end, 'gap': ch = {_GAP}, 'conf': case when ch = {_GAP} then null else ((k * 7 + m * 31 + length(word)) % 101) / 100.0::double end}} as c
        from (select *, substr(cols[i], m + 1, 1) as ch, len(list_filter(cols[1:i], lambda x: substr(x, m + 1, 1) <> {_GAP})) as k from letters))"""
_UNSURE = "count(*) filter (not gap and (support = 1 or s / (case when total = 0 then 1 else total end) < 0.5))::bigint"


def _cost(columns: str) -> str:
    """SQL: the fewest errors of any choice in the columns, by a table row for each of them."""
    cell = f"own || [least(prev[y[1] + 1] + (strpos(x, {_GAP}) = 0)::int, prev[y[1]] + (strpos(x, substr(word, y[1]::int, 1)) = 0)::int, own[y[1]] + 1)]"
    row = f"list_reduce(list_transform(range(1, length(word) + 1), lambda j: [j]), lambda own, y: {cell}, [prev[1] + (strpos(x, {_GAP}) = 0)::int])".replace("x,", "chosen[x[1]],")
    return f"list_reduce(list_transform(range(1, len({columns}) + 1), lambda i: [i]), lambda prev, x: {row.replace('chosen', columns)}, range(0, length(word) + 1))[-1]"


ORACLE_SQL = {
    "word_networks": f"{_MERGED} select word, len(cols)::bigint as n_columns, replace(array_to_string(cols, ' '), {_GAP}, '_') as columns from networks",
    "word_votes": f"""{_MERGED}{_CELLS}{_vote('majority', 'count(*)::double')}{_vote('confidence', _sum())},
        unsure as (select line_id, {_UNSURE} as unsure from confidence_best where r = 1 group by line_id)
        select line_id as word, majority.text as majority, confidence.text as confidence, unsure from majority join confidence using (line_id) join unsure using (line_id)""",
    "word_costs": f"""{_MERGED}, places as (select word, cols, unnest(range(1, len(cols) + 1)) as i from networks),
        options as (select word, cols, i, unnest(range(1, 4)) as m from places),
        single as (select word, cols, i, m, list_transform(cols, lambda x, k: case when k = i then substr(x, m, 1) else x end) as forced from options where strpos(cols[i], substr(cols[i], m, 1)) = m),
        costs as (select word, i, string_agg({_cost('forced')}::varchar, ',' order by m) as c from single group by word, i),
        joined as (select word, string_agg(c, ' ' order by i) as forced from costs group by word)
        select word, {_cost('cols')}::bigint as oracle, coalesce(forced, '') as forced from networks left join joined using (word)""",
    "whole_line_edits": f"""with raw as (select doc_id, unnest(string_split(text, chr(10))) as ref, generate_subscripts(string_split(text, chr(10)), 1) - 1 as row from documents),
        read as (select doc_id || '_' || row as line_id, ref, replace(replace(replace(ref, 'th', 't'), 'er', 're'), 'on', 'oon') as hyp from raw where length(ref) > 0)
        select line_id, {_lev('ref', 'hyp')}::bigint as edits, (length(hyp) - length(ref))::bigint as longer from read""",
}
