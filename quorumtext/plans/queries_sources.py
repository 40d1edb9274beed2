"""Files written to the shared folder and read back: predictions, corpora, alphabets, segmentations, results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_part
from ..operators import script
from ..sources import files, png, tables
from . import views
from .storage import shared_folder, table


def _folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every member's predictions as CSV; the last member lacks a seventh of the documents."""
    rows = views.predictions(spark, sf_dir).select("model", "part", F.col("line_id").alias("ImageID"), "lang", F.col("ref").alias("reference"), F.col("hyp").alias("prediction"), "doc_id", F.transform(F.sequence(F.lit(1), F.length("hyp")), lambda i: (i % 10) / 10.0).alias("conf"))
    paths = []
    for k, model in enumerate(views.MEMBERS):
        own = rows.where(F.col("model") == model)
        paths.append(_folder(spark, f"predictions-{k}"))
        tables.write_predictions(own.where("doc_id % 7 <> 0") if k == len(views.MEMBERS) - 1 else own, paths[-1])
    return paths


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation lines that all members predict, read from their files."""
    rows = tables.predictions(spark, _written(spark, sf_dir), ["valA", "valB"])
    return rows.select("member", "model", "part", "ImageID", "lang", "reference", "prediction", F.size("conf").cast("long").alias("confidences"))


def bad_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that lack a confidence: those of every fifth document lost one."""
    rows = views.readings(spark, sf_dir).withColumn("conf", F.when(F.col("doc_id") % 5 == 0, F.slice("conf", 2, 1000)).otherwise(F.col("conf")))
    return tables.bad_lengths(rows, "conf", "hyp").select("line_id", "model")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.format_string("%d.png", "doc_id").alias("ImageID"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text"), "lang", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    path = _folder(spark, "corpus")
    tables.write_result(docs, path, "csv")
    images = table(spark, sf_dir, "documents").where("doc_id % 13 <> 0").select(F.format_string("/images/%d.png", "doc_id").alias("path"))
    return tables.corpus(spark, path, "train", ["en", "fr"], images)


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines of two languages that have text and an image."""
    return _corpus(spark, sf_dir)[0].select("ImageID", "lang", F.length("text").cast("long").alias("n_chars"))


def corpus_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the corpus scan left out, and why."""
    return _corpus(spark, sf_dir)[1]


def alphabet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' alphabet, written and read again."""
    path = _folder(spark, "alphabet")
    tables.write_alphabet(script.alphabet(table(spark, sf_dir, "documents"), "text"), path)
    return tables.read_alphabet(spark, path).withColumn("index", F.col("index").cast("int"))


def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error counts of the members, written as JSON and read again."""
    path = _folder(spark, "result")
    tables.write_result(views.predictions(spark, sf_dir).groupBy("model").agg(F.count("*").alias("lines"), F.count_if(F.col("ref") == F.col("hyp")).alias("exact")), path)
    return spark.read.schema("model string, lines long, exact long").json(path)


def lm_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines as a text file of a language model's corpus, blank ones left out."""
    path = _folder(spark, "lines")
    table(spark, sf_dir, "documents").select(F.regexp_replace("text", "\r", " ").alias("text")).write.text(path)
    return tables.lm_corpus(spark, path).groupBy("line").agg(F.count("*").alias("n"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of line files that several images would share, as dots in names become underscores."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.expr("doc_id div 2"), F.when(F.col("doc_id") % 4 == 0, ".a").otherwise("_a"), F.lit(".png")).alias("ImageID"), "text")
    return tables.write_line_pairs(rows, _folder(spark, "pairs"))


def segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of segmentation files in three formats, one for each order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"))
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    native = F.concat(F.lit('{"regions": {"a": {"lines": [{"bbox": [0, 0, 1, 1]}]}}, "lines": [{"boundary": [['), x, F.lit(", "), y, F.lit("], ["), (F.col("x") + 9).cast("string"), F.lit(", "), (F.col("y") + 5).cast("string"), F.lit("]]}]}"))
    alto = F.concat(F.lit('<alto xmlns="n"><TextLine HPOS="'), x, F.lit('" VPOS="'), y, F.lit('" WIDTH="9" HEIGHT="5"/></alto>'))
    page = F.concat(F.lit('<P><TextLine><Coords points="'), x, F.lit(","), y, F.lit(" "), (F.col("x") + 9).cast("string"), F.lit(","), (F.col("y") + 5).cast("string"), F.lit('"/></TextLine></P>'))
    kind = F.col("l_orderkey") % 4
    raw = F.when(kind == 0, native).when(kind == 1, alto).when(kind == 2, page).otherwise("unreadable")
    return rows.select("l_orderkey", F.inline_outer(tables.parsed_segmentation(raw)))


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of lines of two parts, written with a commit, and what the parts' lists name read back."""
    rows = table(spark, sf_dir, "documents").select(F.format_string("%d.page.png", "doc_id").alias("ImageID"), "doc_id", "text", F.when(F.col("doc_id") % 3 == 1, "train").otherwise("val").alias("split"))
    part = F.when(in_part("split", "doc_id", "train"), "train").when(in_part("split", "doc_id", "valA"), "valA")
    path = _folder(spark, "line-files")
    files.export_lines(rows.withColumn("part", part).where("part is not null"), path, F.col("part"))
    named = files.listed(spark, path, "train").withColumn("part", F.lit("train")).union(files.listed(spark, path, "valA").withColumn("part", F.lit("valA")))
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gt.txt").text(path, wholetext=True)
    name = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    both = named.withColumn("name", name(F.col("file"))).join(found.withColumn("name", name(F.input_file_name())), "name")
    return both.select("part", F.substring_index("name", "/", -1).alias("name"), F.md5("value").alias("digest"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmentation file of each supplier, of all lines that it supplies: JSON, ALTO or PageXML, with regions around the lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.expr("l_partkey * 3 % 2000").alias("x"), F.expr("l_orderkey % 3000").alias("y"), F.expr("cast(l_quantity as int)").alias("w"))
    box = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "x", "y", "w")))
    pages = rows.groupBy("l_suppkey").agg(box.alias("b"))
    texts = {
        "json": ("""if(l.x % 2 = 0, format_string('{"boundary": [[%d, %d], [%d, %d], [%d, %d]]}', l.x, l.y, l.x + l.w, l.y, l.x + l.w, l.y + 9), format_string('{"bbox": [%d, %d, %d, %d]}', l.x, l.y, l.x + l.w, l.y + 9))""",
                 '{"regions": {"text": [{"boundary": [[0, 0], [9999, 9999]], "lines": [{"bbox": [1, 1, 2, 2]}]}]}, "pages": [{"size": 1, "lines": [', ", ", "]}]}"),
        "alto": ("""if(l.x % 2 = 0, format_string('<TextLine><Shape><Polygon POINTS="%d,%d %d,%d %d,%d"/></Shape><String CONTENT="x"/></TextLine>', l.x, l.y, l.x + l.w, l.y, l.x, l.y + 9), format_string('<TextLine HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="9"/>', l.x, l.y, l.w))""",
                 '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><TextBlock><Shape><Polygon POINTS="0,0 9999,9999"/></Shape>', "", "</TextBlock></Layout></alto>"),
        "page": ("""format_string('<TextLine><Coords points="%d,%d %d,%d"/><Baseline points="0,0"/></TextLine>', l.x, l.y, l.x + l.w, l.y + 9)""",
                 '<PcGts><Page><TextRegion><Coords points="0,0 9999,9999"/>', "", "</TextRegion></Page></PcGts>"),
    }
    made = [F.concat(F.lit(head), F.expr(f"array_join(transform(b, l -> {line}), '{between}')"), F.lit(tail)) for line, head, between, tail in texts.values()]
    kind = F.col("l_suppkey") % 3
    ending = F.when(kind == 0, ".json").otherwise(".xml")
    return pages.select(F.lit("pages").alias("part"), F.concat(F.col("l_suppkey").cast("string"), ending).alias("name"), F.when(kind == 0, made[0]).when(kind == 1, made[1]).otherwise(made[2]).alias("content"))


def segmentation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of segmentation files of three formats, with several lines and regions in each, read by their data source."""
    path = _folder(spark, "segmentations")
    files.export_files(_page_files(spark, sf_dir), path)
    return files.segmentations(spark, path)


def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents painted as grey images, a pixel a character, whose rows take all filters of the format in turn, written, read and decoded."""
    grey = F.expr("transform(filter(split(text, ''), c -> c <> ''), (c, i) -> (ascii(c) * 37 + i + 1) % 256)")
    rows = table(spark, sf_dir, "documents").where("length(text) >= 16").select("doc_id", grey.alias("grey"))
    path = _folder(spark, "images")
    files.export_files(rows.select(F.lit("images").alias("part"), F.format_string("%d.png", "doc_id").alias("name"), png.encoded("grey", F.lit(16)).alias("content")), path)
    found = png.grey_images(tables.images(spark, path))
    total = F.expr("aggregate(grey, 0L, (a, p) -> a + p)")
    mixed = F.expr("aggregate(grey, 0L, (a, p) -> (a * 31 + p) % 1000003)")
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("doc_id"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), total.alias("total"), mixed.alias("mixed"))


def showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a few readings with their errors marked, as a row for each of its table's rows."""
    picks = views.readings(spark, sf_dir).where("member = 2").orderBy("line_id").select("line_id", "ref", "hyp")
    rows = tables.report_html(picks, 20, ref="ref", readings=("hyp",)).split("<tr>")[2:]
    return spark.createDataFrame([(i, "class=\"err\"" in r) for i, r in enumerate(rows)], "place int, wrong boolean")


QUERIES = {f.__name__: f for f in (load_lines, bad_lengths, corpus_scan, corpus_drops, alphabet_file, result_file, lm_corpus, line_pairs, segmentations, line_files, segmentation_files, decoded_images, showcase)}

_C = "c as (select doc_id, doc_id || '.png' as ImageID, lang, n_chars, doc_id % 11 = 0 as empty, doc_id % 13 <> 0 as has from documents where doc_id % 3 <> 0 and lang in ('en', 'fr'))"
ORACLE_SQL = {
    "load_lines": f"{views.SQL} select member::int as member, model, part, line_id as ImageID, lang, ref as reference, hyp as prediction, length(hyp)::bigint as confidences from preds where part <> 'test' and doc_id % 7 <> 0",
    "bad_lengths": f"{views.SQL} select line_id, m as model from read, (select unnest(['schwa', 'keep', 'drop']) as m) where doc_id % 5 = 0",
    "corpus_scan": f"with {_C} select ImageID, lang, n_chars from c where not empty and has",
    "corpus_drops": f"with {_C} select count(*) filter (empty)::bigint as empty, count(*) filter (not empty and not has)::bigint as no_image from c",
    "alphabet_file": "select row_number() over (order by unicode(ch))::int as index, ch from (select distinct unnest(string_split(text, '')) as ch from documents) where ch <> ''",
    "result_file": f"{views.SQL} select model, count(*)::bigint as lines, count(*) filter (ref = hyp)::bigint as exact from preds group by model",
    "lm_corpus": "select line, count(*)::bigint as n from (select unnest(string_split(replace(text, chr(13), ' '), chr(10))) as line from documents) where trim(line) <> '' group by line",
    "line_pairs": "select name, count(distinct key)::bigint as keys from (select doc_id // 2 || case when doc_id % 4 = 0 then '.a' else '_a' end as key, doc_id // 2 || '_a' as name from documents) group by name having count(distinct key) > 1",
    "segmentations": """select l_orderkey, case when l_orderkey % 4 < 3 then x end::double as x0, case when l_orderkey % 4 < 3 then y end::double as y0, case when l_orderkey % 4 < 3 then x + 9 end::double as x1, case when l_orderkey % 4 < 3 then y + 5 end::double as y1
        from (select l_orderkey, min(l_partkey) as x, min(l_suppkey) as y from lineitem group by 1)""",
    "line_files": f"""{views.SQL} select case when doc_id % 3 = 1 then 'train' else 'valA' end as part, doc_id || '_page.gt.txt' as name, md5(text) as digest from documents join halves using (doc_id) where length(text) > 0 and (doc_id % 3 = 1 or crc % 2 = 0)""",
    "segmentation_files": """select l_suppkey || case l_suppkey % 3 when 0 then '.json' else '.xml' end as file, (row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, x, y, w) - 1)::int as line, x::double as x0, y::double as y0, (x + w)::double as x1, (y + 9)::double as y1
        from (select l_suppkey, l_orderkey, l_linenumber, l_partkey * 3 % 2000 as x, l_orderkey % 3000 as y, l_quantity::int as w from lineitem)""",
    "decoded_images": """with p as (select doc_id, length(text) // 16 as h, list_transform(range(1, length(text) // 16 * 16 + 1), lambda i: (unicode(substr(text, i, 1)) * 37 + i) % 256) as g from documents where length(text) >= 16)
        select doc_id, h::bigint as height, 16::bigint as width, list_sum(g)::bigint as total, list_reduce(list_transform(g, lambda x: x::bigint), lambda a, x: (a * 31 + x) % 1000003, 0::bigint)::bigint as mixed from p""",
    "showcase": f"{views.SQL} select (row_number() over (order by line_id) - 1)::int as place, regexp_matches(case when dropped then substr(ref, 2) else ref end, '[eo]') as wrong from read order by line_id limit 20",
}
