"""Frames, runs, histograms and boxes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, scan, signal
from .storage import spread, table


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of sequences of twenty; a frame's symbol is its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 20").alias("seq"), F.col("label").alias("symbol"), F.array_max("embedding").cast("double").alias("conf"))
    out = signal.ctc_decode(rows, "seq", "vec_id")
    return out.select("seq", F.array_join("symbols", " ").alias("symbols"), F.array_join(F.transform("confs", lambda c: F.round(c * 1e6).cast("long").cast("string")), " ").alias("confs"))


def frame_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.best_frame(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "symbol")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels: a page per ship mode of the part key, a level by price."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("page"), (F.floor("l_extendedprice").cast("long") % 256).cast("int").alias("level"))


def runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one kind in a user's numbering by event."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i"))
    return signal.runs(rows, "user_id", "i", F.col("event_type") == "click").select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed order sizes of each line number's items, ends counted as 0."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).withColumn("g", F.expr("l_orderkey div 1000"))
    return rows.select("l_orderkey", F.round(signal.moving_average("q", "g", "l_orderkey", 4), 9).alias("smooth"))


def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of clicks in all events, taken as one sequence."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("g"), "event_id", "event_type")
    numbers = scan.counted(scan.dealt(rows, "g", "event_id"), "g", "event_id", "i").withColumn("i", F.col("i") - 1)
    return scan.runs(numbers, "g", "i", F.col("event_type") == "click").select("start", "end")


def long_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the frames of one sequence: their kinds without repeats, and each run's largest value."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("g"), "event_id", F.length("event_type").alias("symbol"), F.col("value").alias("conf"))
    return scan.symbol_runs(rows, "g", "event_id", blank=5).select("run", "symbol", "conf")


def long_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed values of all events, taken as one sequence in blocks."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("g"), "event_id", "value")
    return scan.smoothed(rows, "value", "g", "event_id", 7, block=512).select("event_id", F.round("smooth", 9).alias("smooth"))


def long_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the evaluations of one training: the best so far, and where waiting for fifty would end it."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("g"), "event_id", "value")
    return scan.best_so_far(rows, "g", "event_id", "value", 50).select("event_id", "best", "improved", "misses", "stopped")


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.otsu(_levels(spark, sf_dir), "page", "level")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on their order's page; an order has few, so they are dealt by it once."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    box = rows.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("key"), (F.col("l_partkey") % 300).alias("x0"), (F.col("l_suppkey") * 7 % 90).alias("y0"),
        (F.col("l_partkey") % 300 + 10 + F.col("l_suppkey") * 13 % 200).alias("x1"), (F.col("l_suppkey") * 7 % 90 + 4 + F.col("l_quantity").cast("long") % 30).alias("y1"),
    )
    return box.groupBy("page", "key").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.drop_contained(_boxes(spark, sf_dir), "page", "key")


def box_hugging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.drop_slivers(_boxes(spark, sf_dir), "page", "key")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.row_overlaps(_boxes(spark, sf_dir), "page", "key")


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.upper_median(_boxes(spark, sf_dir), "page")


def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every order's page merged to rows: an item's box and the one beside it, a little lower, are one row."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 50).alias("x"), F.max("l_suppkey").alias("s"))
    y = F.col("l_linenumber") * 40
    left = F.struct((F.col("x")).cast("int").alias("x0"), y.alias("y0"), (F.col("x") + 60).cast("int").alias("x1"), (y + 20).alias("y1"))
    right = F.struct((F.col("x") + 200).cast("int").alias("x0"), (y + F.col("s") % 8).cast("int").alias("y0"), (F.col("x") + 290).cast("int").alias("x1"), (y + 20 + F.col("s") % 8).cast("int").alias("y1"))
    pages = rows.select("l_orderkey", F.explode(F.array(left, right)).alias("b")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return pages.select(F.col("l_orderkey").alias("page"), F.inline(boxes.grouped_rows("b")))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of strips for every customer: fifteen rows for each, of which the first nine have some ink between white margins."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select("c_custkey", (F.col("c_custkey") % 5 + 3).cast("int").alias("strips"), F.coalesce("c_nationkey", F.lit(0)).alias("n"))
    grey = lambda k, n: F.array_repeat(F.lit(k), n)
    ink = F.concat(grey(255, F.lit(2)), grey(0, F.col("n") + 18), grey(255, 40 - F.col("n")))
    strip = F.concat(F.array_repeat(ink, 9), F.array_repeat(grey(255, F.lit(60)), 6))
    return rows.withColumn("rows", F.flatten(F.array_repeat(strip, F.col("strips"))))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the strips of every customer's page."""
    return _sheets(spark, sf_dir).select("c_custkey", F.posexplode(signal.page_lines("rows")).alias("place", "b")).select("c_custkey", "place", "b.*")


def refined_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the middle of every strip, one inside of it and a sliver beside it: the strips' own remain, as wide as their ink."""
    own = _sheets(spark, sf_dir)
    strip = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda k: F.array(*[F.struct(F.lit(a).alias("x0"), (k * 15 + b).alias("y0"), F.lit(c).alias("x1"), (k * 15 + d).alias("y1")) for a, b, c, d in ((3, 0, 5, 9), (3, 2, 4, 8), (3, 0, 5, 1))]))
    rows = boxes.refine(own.withColumn("b", F.flatten(strip).cast(signal.BOXES)), "c_custkey", "rows", "b")
    return rows.select("c_custkey", F.inline("refined"))


def line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of customers' pages as a recogniser's line images, and how dark they are."""
    rows = _sheets(spark, sf_dir).select("c_custkey", "strips", signal.prepared_lines("rows").alias("p"))
    return rows.select("c_custkey", F.size("p").cast("long").alias("height"), F.size(F.get("p", F.lit(0))).cast("long").alias("width"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's page read by two stand-in readers: one writes its strip's number in the script's digits, the other too."""
    from . import inference

    def loader():
        def model(frame):
            frame = frame.assign(text=["بت " + str(100 + k) for k in frame.line])
            return frame.assign(conf=[[0.9] * len(t) for t in frame.text])[["page", "line", "text", "conf"]]

        return model

    for name in ("stand_in", "standin"):
        inference.register(name, loader, "page long, line int, text string, conf array<double>")
    rows = inference.read_pages(_sheets(spark, sf_dir), ["standin", "stand_in"], page="c_custkey")
    return rows.select("page", F.col("line").cast("long").alias("line"), "text", F.array_join(F.map_keys("shown"), "+").alias("shown"))


def read_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's page read by two readers that count the dark columns of a line's image; on some lines the second is surer and one off."""
    from . import inference

    def loader(off):
        def load():
            import numpy as np

            def model(frame):
                dark = [int((np.stack([np.asarray(r) for r in crop]) < 128).any(0).sum()) for crop in frame.crop]
                surer = frame.line % 4 == 1
                frame = frame.assign(text=["بت " + str(d + (off and s)) for d, s in zip(dark, surer, strict=True)])
                return frame.assign(conf=[[0.95 if off and s else 0.9 - 0.3 * off] * len(t) for t, s in zip(frame.text, surer, strict=True)])[["page", "line", "text", "conf"]]

            return model

        return load

    for off, name in enumerate(("counter", "doubter")):
        inference.register(name, loader(off), "page long, line int, text string, conf array<double>")
    rows = inference.read_pages(_sheets(spark, sf_dir), ["counter", "doubter"], page="c_custkey")
    return rows.select("page", F.col("line").cast("long").alias("line"), "text", F.size(F.filter("unsure", lambda u: u)).cast("long").alias("unsure"))


def ink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of customers' pages on grey paper, which have no white rows: they are found by their ink."""
    rows = _sheets(spark, sf_dir).withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda p: F.least(p, F.lit(240)))))
    return rows.select("c_custkey", F.posexplode(signal.page_lines("rows")).alias("place", "b")).select("c_custkey", "place", "b.*")


def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the grey levels of documents painted as images, in every test-time variant."""
    # A text is split into letters once: to ask for each by its place reads it from its start every time.
    grey = F.expr("transform(split(substring(text, 1, length(text) div 16 * 16), ''), (c, i) -> (ascii(c) * 37 + i + 1) % 256)")
    painted = spread(table(spark, sf_dir, "documents")).where("length(text) >= 16").select("doc_id", grey.alias("grey"))
    rows = painted.select("doc_id", "grey", F.explode(F.array(*map(F.lit, signal.VARIANTS))).alias("kind"))
    rows = rows.withColumn("made", signal.varied("grey", F.lit(16), "kind"))
    return rows.select("doc_id", "kind", F.expr("aggregate(made, 0L, (a, p) -> a + p)").alias("total"), F.expr("aggregate(made, 0L, (a, p) -> (a * 31 + p) % 1000003)").alias("mixed"))


QUERIES = {f.__name__: f for f in (ctc_decode, frame_argmax, runs_islands, moving_average, long_runs, long_decode, long_average, long_stopping, otsu_thresholds, box_containment, box_hugging, interval_overlap, upper_medians, grouped_rows, page_lines, refined_boxes, line_images, read_pages, read_ink, ink_lines, image_variants)}

_B = """with box as (select l_orderkey as page, l_linenumber as key, min(l_partkey % 300) as x0, min(l_suppkey * 7 % 90) as y0, min(l_partkey % 300 + 10 + l_suppkey * 13 % 200) as x1, min(l_suppkey * 7 % 90 + 4 + l_quantity::bigint % 30) as y1 from lineitem group by 1, 2),
    med as (select page, list_sort(list(y1 - y0)) as h from box group by page), sized as (select page, h[len(h) // 2 + 1] as med from med)"""
_AREA = "greatest({p}.x1 - {p}.x0, 0) * greatest({p}.y1 - {p}.y0, 0)"

ORACLE_SQL = {
    "ctc_decode": """with f as (select vec_id, vec_id // 20 as seq, label as symbol, list_max(embedding)::double as conf from embeddings),
        m as (select *, case when lag(symbol) over (partition by seq order by vec_id) is not distinct from symbol then 0 else 1 end as new from f),
        r as (select *, sum(new) over (partition by seq order by vec_id) as run from m),
        g as (select seq, run, symbol, max(conf) as conf from r where symbol <> 0 group by all),
        s as (select seq, string_agg(symbol::varchar, ' ' order by run) as symbols, string_agg(round(conf * 1e6)::bigint::varchar, ' ' order by run) as confs from g group by seq)
        select seq, symbols, confs from (select distinct seq from f) left join s using (seq)""",
    "frame_argmax": "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as symbol from embeddings",
    "runs_islands": """with e as (select user_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as i from events),
        m as (select user_id, i, i - row_number() over (partition by user_id order by i) as island from e where event_type = 'click')
        select user_id, min(i)::bigint as start, (max(i) + 1)::bigint as "end" from m group by user_id, island""",
    "long_runs": """with e as (select event_type, row_number() over (order by event_id) - 1 as i from events), m as (select i, i - row_number() over (order by i) as island from e where event_type = 'click')
        select min(i)::bigint as start, (max(i) + 1)::bigint as "end" from m group by island""",
    "long_decode": """with e as (select event_id, length(event_type) as symbol, value as conf, case when lag(length(event_type)) over (order by event_id) is not distinct from length(event_type) then 0 else 1 end as new from events),
        r as (select *, sum(new) over (order by event_id) as run from e)
        select run::bigint as run, symbol::int as symbol, max(conf) as conf from r where symbol <> 5 group by run, symbol""",
    "long_average": "select event_id, round(sum(value) over (order by event_id rows between 3 preceding and 3 following) / 7, 9) as smooth from events",
    "long_stopping": """with o as (select event_id, value, min(value) over w as best, min(value) over (order by event_id rows between unbounded preceding and 1 preceding) as before, row_number() over w as n from events window w as (order by event_id)),
        i as (select *, coalesce(value < before, value is not null) as improved from o), m as (select *, n - max(case when improved then n else 1 end) over (order by event_id) as misses from i)
        select event_id, best, improved, misses::int as misses, coalesce(max((misses >= 50)::int) over (order by event_id rows between unbounded preceding and 1 preceding) = 1, false) as stopped from m""",
    "moving_average": """with o as (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) select l_orderkey, round(sum(q) over (partition by l_orderkey // 1000 order by l_orderkey rows between 2 preceding and 1 following) / 4, 9) as smooth from o""",
    "otsu_thresholds": """with h as (select l_partkey % 20 as page, (floor(l_extendedprice)::bigint % 256)::int as t, count(*)::double as n from lineitem group by 1, 2),
        p as (select page, t, sum(n) over (partition by page order by t) as b, sum(n * t) over (partition by page order by t) as sb, sum(n) over (partition by page) as a, sum(n * t) over (partition by page) as sa from h),
        v as (select page, t, b * (a - b) * pow(sb / b - (sa - sb) / nullif(a - b, 0), 2) as v from p)
        select page, coalesce(arg_max(t, [v, -t]) filter (v is not null), 128)::int as threshold from v group by page""",
    "box_containment": f"""{_B} select a.* from box a where not exists (select 1 from box b where a.page = b.page and a.key <> b.key and {_AREA.format(p='b')} > {_AREA.format(p='a')}
        and greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.6::double * ({_AREA.format(p='a')}))""",
    "box_hugging": f"""{_B}, own as (select box.*, greatest(med, 8) as m from box join sized using (page))
        select page, key, x0, y0, x1, y1 from own a where a.y1 - a.y0 >= 0.45::double * a.m or not exists (select 1 from own b where a.page = b.page and a.key <> b.key and b.y1 - b.y0 >= 0.45::double * b.m
            and greatest(b.y0 - a.y1, a.y0 - b.y1, 0) <= 0.5::double * a.m and least(a.x1, b.x1 + a.m) - greatest(a.x0, b.x0 - a.m) > 0)""",
    "interval_overlap": f"""{_B} select a.page, a.key as a, b.key as b from box a join box b on a.page = b.page and a.key < b.key
        where least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5::double * least(a.y1 - a.y0, b.y1 - b.y0) and greatest(a.y1 - a.y0, b.y1 - b.y0) <= 2 * least(a.y1 - a.y0, b.y1 - b.y0)""",
    "upper_medians": f"{_B} select page, med from sized",
    "grouped_rows": """select l_orderkey as page, min(l_partkey % 50)::int as x0, (l_linenumber * 40)::int as y0, (min(l_partkey % 50) + 290)::int as x1, (l_linenumber * 40 + 20 + max(l_suppkey) % 8)::int as y1 from lineitem group by l_orderkey, l_linenumber""",
    "read_ink": """select c_custkey as page, k::bigint as line, 'بت ' || (coalesce(c_nationkey, 0) + 18 + (k % 4 = 1)::int) as text, case when k % 4 = 1 then length((list_filter([0, 1], lambda d: substr((coalesce(c_nationkey, 0) + 18)::varchar, d + 1, 1) <> substr((coalesce(c_nationkey, 0) + 19)::varchar, d + 1, 1)))) else 0 end::bigint as unsure from (select *, unnest(range(0, c_custkey % 5 + 3)) as k from customer)""",
    "ink_lines": """select c_custkey, k::int as place, 0 as x0, (case k when 0 then 0 else k * 15 - 5 end)::int as y0, (coalesce(c_nationkey, 0) + 23)::int as x1, (k * 15 + 13)::int as y1 from (select *, unnest(range(0, c_custkey % 5 + 3)) as k from customer)""",
    "image_variants": """with p as (select doc_id, list_transform(range(1, length(text) // 16 * 16 + 1), lambda i: (unicode(substr(text, i, 1)) * 37 + i) % 256) as g from documents where length(text) >= 16),
        n as (select doc_id, g, list_transform(range(1, len(g) + 1), lambda i: [g[i], g[case when i % 16 = 1 then i else i - 1 end], g[case when i <= 16 then i else i - 16 end], g[case when i <= 16 then (case when i % 16 = 1 then i else i - 1 end) when i % 16 = 1 then i - 16 else i - 17 end]]) as near from p),
        made as (select doc_id, 'thick' as kind, list_transform(near, lambda x: list_min(x)::bigint) as v from n union all select doc_id, 'thin', list_transform(near, lambda x: list_max(x)::bigint) from n
            union all select doc_id, 'dark', list_transform(g, lambda x: floor(255.0::double * pow(x / 255.0::double, 1.6::double))::bigint) from n union all select doc_id, 'light', list_transform(g, lambda x: floor(255.0::double * pow(x / 255.0::double, 0.6::double))::bigint) from n)
        select doc_id, kind, list_sum(v)::bigint as total, list_reduce(v, lambda a, x: (a * 31 + x) % 1000003, 0::bigint)::bigint as mixed from made""",
    "page_lines": """select c_custkey, k::int as place, 2 as x0, (k * 15)::int as y0, (20 + coalesce(c_nationkey, 0))::int as x1, (k * 15 + 9)::int as y1 from (select *, unnest(range(0, c_custkey % 5 + 3)) as k from customer)""",
    "refined_boxes": """select c_custkey, 2 as x0, (k * 15)::int as y0, (20 + coalesce(c_nationkey, 0))::int as x1, (k * 15 + 9)::int as y1 from (select *, unnest(range(0, c_custkey % 5 + 3)) as k from customer)""",
    "line_images": """select c_custkey, 64::bigint as height, round_even(60 * 64 / ((c_custkey % 5 + 3) * 15), 0)::bigint as width from customer""",
    "read_pages": """select c_custkey as page, k::bigint as line, 'بت ' || (100 + k) as text, 'standin' as shown from (select *, unnest(range(0, c_custkey % 5 + 3)) as k from customer)""",
}
