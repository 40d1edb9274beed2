import numpy as np
from pyspark.sql import functions as F

from quorumtext.operators import boxes, signal


def test_ctc(spark):
    frames = spark.createDataFrame([(1, t, s, c) for t, (s, c) in enumerate([(0, 0.9), (2, 0.5), (2, 0.8), (0, 0.7), (2, 0.4), (3, 0.6)])] + [(2, 0, 0, 0.9)], "seq int, t int, symbol int, conf double")
    out = {r["seq"]: r for r in signal.ctc_decode(frames, "seq", "t").collect()}
    assert out[1]["symbols"] == [2, 2, 3] and out[1]["confs"] == [0.8, 0.4, 0.6] and out[2]["symbols"] is None


def test_runs_and_averages(spark):
    mask = [0, 1, 1, 0, 1]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(mask)], "g int, i int, v double")
    assert sorted((r["start"], r["end"]) for r in signal.runs(df, "g", "i", F.col("v") > 0).collect()) == [(1, 3), (4, 5)]
    assert signal.spans(np.array(mask) > 0) == [[1, 3], [4, 5]]
    for k in (2, 3, 4, 5):
        got = [r[0] for r in df.select("i", signal.moving_average("v", "g", "i", k).alias("m")).orderBy("i").select("m").collect()]
        assert np.allclose(got, np.convolve(mask, np.ones(k) / k, mode="same"))


def test_threshold(spark):
    rnd = np.random.default_rng(0)
    grey = np.concatenate([rnd.integers(10, 60, 300), rnd.integers(150, 250, 700)]).astype(np.uint8)
    df = spark.createDataFrame([(0, int(x)) for x in grey] + [(1, 7)], "g int, level int")
    out = {r["g"]: r["threshold"] for r in signal.otsu(df, "g", "level").collect()}
    assert out[0] == signal.threshold(grey.reshape(10, 100)) and 59 <= out[0] < 150 and out[1] == 128


def test_pages(spark):
    page = np.full((200, 300), 255, dtype=np.uint8)
    for y in (30, 90, 150):
        page[y : y + 20, 40:260:3] = 0
    sheet = spark.createDataFrame([(page.tolist(),), ([],)], "p array<array<int>>")
    found = sheet.select(signal.page_lines("p")).collect()
    assert [(b["y0"], b["y1"]) for b in found[0][0]] == [(30, 50), (90, 110), (150, 170)] and found[1][0] == []
    assert len(signal.lines_of_page(np.where(page == 255, 240, page).astype(np.uint8))) == 3
    assert signal.white_bands(np.full((50, 50), 200, dtype=np.uint8)) is None
    assert (signal.variant(page, "thick") <= page).all() and (signal.variant(page, "light") >= page).all()


def test_rows_merge():
    halves = [(0, 10, 90, 30), (110, 12, 200, 32), (0, 60, 200, 80), (0, 0, 200, 200), (5, 100, 9, 120)]
    assert boxes.rows_of(halves) == [(0, 10, 200, 32), (0, 60, 200, 80)]
    assert boxes.rows_of([]) == []


def test_joins_on_boxes(spark):
    rows = [(1, 0, 0, 0, 100, 20), (1, 1, 10, 2, 30, 12), (1, 2, 0, 24, 6, 28), (1, 3, 300, 300, 306, 304), (1, 4, 0, 60, 100, 80)]
    df = spark.createDataFrame(rows, "page int, key int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["key"] for r in boxes.drop_contained(df, "page", "key").collect()) == [0, 2, 3, 4]
    assert 3 in [r["key"] for r in boxes.drop_slivers(df, "page", "key").collect()]
    ink = np.zeros((20, 100), dtype=bool)
    ink[:, 10:40] = ink[:, 44:50] = ink[:, 90:95] = True
    assert boxes.widen(ink, [(12, 0, 30, 20)], 8) == [(10, 0, 50, 20)]


def test_line_images_keep_their_proportions():
    import numpy as np

    grey = np.full((32, 100), 200, dtype=np.uint8)
    grey[:, :50] = 10
    out = signal.prepared(grey)
    assert out.shape == (64, 200) and (out[:, :80] > 190).all() and (out[:, 120:] < 20).all()  # mirrored
    assert signal.prepared(np.zeros((10, 1000), np.uint8)).shape == (64, 1600)
    batch = signal.padded([out, out[:, :50]])
    assert batch.shape == (2, 64, 200) and (batch[1, :, 50:] == 1).all()


def test_early_stopping(spark):
    from quorumtext.operators import scan

    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, 4.0, 6.0, 3.0, 9.0])], "run string, step int, v double")
    rows = scan.best_so_far(df, "run", "step", "v", 2).orderBy("step").collect()
    assert [r["best"] for r in rows] == [5, 4, 4, 4, 3, 3] and [r["misses"] for r in rows] == [0, 0, 1, 2, 0, 1] and [r["stopped"] for r in rows] == [False, False, False, False, True, True]


def scattered(rnd, n, pages=2):
    """Boxes of very different sizes, some without an area and some equal."""
    rows = []
    for key in range(n):
        x, y = (int(v) for v in rnd.integers(-50, 400, 2))
        w, h = ((int(rnd.integers(200, 500)), int(rnd.integers(100, 400))) if rnd.random() < 0.1 else (int(rnd.integers(0, 60)), int(rnd.integers(0, 20))))
        rows.append((int(rnd.integers(0, pages)), key, x, y, x + w, y + h))
    return rows + [(p, n + i, *b) for i, (p, _, *b) in enumerate(rows[:3])]


def test_boxes_of_cells_equal_all_pairs(spark):
    rows = scattered(np.random.default_rng(3), 150)
    df = spark.createDataFrame(rows, "page int, key int, x0 int, y0 int, x1 int, y1 int")
    area = lambda b: max(b[4] - b[2], 0) * max(b[5] - b[3], 0)
    meet = lambda a, b: max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
    others = lambda a: [b for b in rows if b[0] == a[0] and b[1] != a[1]]
    assert sorted(r["key"] for r in boxes.drop_contained(df, "page", "key").collect()) == [a[1] for a in rows if not any(area(b) > area(a) and meet(a, b) >= 0.6 * area(a) for b in others(a))]
    med = {p: sorted(b[5] - b[3] for b in rows if b[0] == p) for p in (0, 1)}
    med = {p: max(8, h[len(h) // 2]) for p, h in med.items()}
    assert {r["page"]: max(8, r["med"]) for r in boxes.upper_median(df, "page").collect()} == med

    def hugs(a):
        m = med[a[0]]
        tall = [b for b in others(a) if b[5] - b[3] >= 0.45 * m]
        return any(max(b[3] - a[5], a[3] - b[5], 0) <= 0.5 * m and min(a[4], b[4] + m) - max(a[2], b[2] - m) > 0 for b in tall)

    assert sorted(r["key"] for r in boxes.drop_slivers(df, "page", "key").collect()) == [a[1] for a in rows if a[5] - a[3] >= 0.45 * med[a[0]] or not hugs(a)]
    pairs = sorted((a[1], b[1]) for a in rows for b in others(a) if a[1] < b[1] and min(a[5], b[5]) - max(a[3], b[3]) > 0.5 * min(a[5] - a[3], b[5] - b[3]) and max(a[5] - a[3], b[5] - b[3]) <= 2 * min(a[5] - a[3], b[5] - b[3]))
    assert sorted((r["a"], r["b"]) for r in boxes.row_overlaps(df, "page", "key").collect()) == pairs
    for op in (boxes.drop_contained, boxes.drop_slivers, boxes.row_overlaps):
        assert op(df.limit(0), "page", "key").collect() == []


def test_a_page_of_very_many_boxes(spark):
    """100,000 lines on one page, with a fragment inside and a sliver beside every tenth: all pairs would be ten thousand millions."""
    n = 100_000
    lines = spark.range(n).selectExpr("0 as page", "id as key", "id % 50 * 1100 as x0", "id div 50 * 30 as y0", "id % 50 * 1100 + 1000 as x1", "id div 50 * 30 + 20 as y1")
    inner = spark.range(0, n, 10).selectExpr("0 as page", f"{n} + id as key", "id % 50 * 1100 + 100 as x0", "id div 50 * 30 + 2 as y0", "id % 50 * 1100 + 160 as x1", "id div 50 * 30 + 16 as y1")
    beside = spark.range(0, n, 10).selectExpr("0 as page", f"{2 * n} + id as key", "id % 50 * 1100 + 1001 as x0", "id div 50 * 30 as y0", "id % 50 * 1100 + 1005 as x1", "id div 50 * 30 + 4 as y1")
    df = lines.union(inner).union(beside)
    assert boxes.drop_contained(df, "page", "key").where("key < 200000").count() == n
    assert boxes.drop_slivers(df, "page", "key").count() == n + n // 10


def test_rows_are_those_of_all_comparisons():
    def plain(given, overlap=0.5):
        h = sorted(b[3] - b[1] for b in given)
        usual, rows = h[len(h) // 2], []
        for b in sorted((b for b in given if b[3] - b[1] <= 2.5 * usual and b[2] - b[0] > 0.6 * usual), key=lambda b: (b[1] + b[3]) / 2):
            for r in rows:
                tall, own = r[3] - r[1], b[3] - b[1]
                if min(r[3], b[3]) - max(r[1], b[1]) > overlap * min(tall, own) and max(tall, own) <= 2 * min(tall, own):
                    r[:] = [min(r[0], b[0]), min(r[1], b[1]), max(r[2], b[2]), max(r[3], b[3])]
                    break
            else:
                rows.append(list(b))
        return [tuple(r) for r in sorted(rows, key=lambda r: r[1])]

    rnd = np.random.default_rng(5)
    for _ in range(60):
        given = [tuple(b) for _, _, *b in scattered(rnd, int(rnd.integers(1, 60)))]
        assert boxes.rows_of(given) == plain(given)


def test_weighted_draws(spark):
    from quorumtext.operators import selection

    rows = [(i, {"a": 1, "b": 6, "c": 0}.get(k), k) for i, k in enumerate("abcabcx")]
    df = spark.createDataFrame(rows, "key int, weight int, kind string").repartition(3)
    got = selection.drawn(df, "weight", 3000, "key").collect()
    assert sorted(r["draw"] for r in got) == list(range(3000))
    shares = {k: sum(r["key"] == k for r in got) / 3000 for k in range(7)}
    assert abs(shares[0] - 1 / 14) < 0.02 and abs(shares[1] - 6 / 14) < 0.03 and abs(shares[4] - 6 / 14) < 0.03 and shares[2] == shares[5] == shares[6] == 0
    assert sorted(map(tuple, selection.drawn(df.repartition(2), "weight", 3000, "key").collect())) == sorted(map(tuple, got))
    assert selection.drawn(df.where("weight = 0"), "weight", 5, "key").collect() == [] and selection.drawn(df, "weight", 0, "key").collect() == []


def test_pages_of_few_boxes_need_no_cells(spark, monkeypatch):
    """Orders hold few boxes: none is written once for each level of cells, and a crowded page beside them still meets in cells."""
    rows = [(1, 0, 0, 0, 100, 20), (1, 1, 10, 2, 30, 12), (1, 2, 5, 5, 5, 9), (2, 0, 0, 0, 9, 9)] + [(3, k, k * 20, 0, k * 20 + 10, 10) for k in range(80)] + [(3, 99, 41, 1, 49, 9)]
    df = spark.createDataFrame(rows, "page int, key int, x0 int, y0 int, x1 int, y1 int")
    seen, plain = [], boxes._drop_contained_in_cells
    monkeypatch.setattr(boxes, "_drop_contained_in_cells", lambda own, *args: seen.append(sorted(r["page"] for r in own.select("page").distinct().collect())) or plain(own, *args))
    assert sorted((r["page"], r["key"]) for r in boxes.drop_contained(df, "page", "key").collect()) == [(1, 0), (2, 0)] + [(3, k) for k in range(80)]
    boxes.drop_contained(df.where("page < 3"), "page", "key").collect()
    assert seen == [[3]]


def test_pages_in_arrow_buffers(spark):
    import pyarrow as pa
    from quorumtext.functions import arrow

    rnd = np.random.default_rng(1)
    pages = [rnd.integers(0, 255, (3, 4)), np.empty((0, 0)), rnd.integers(0, 255, (2, 5)), None, rnd.integers(0, 255, (1, 1))]
    column = pa.array([None if p is None else p.astype(int).tolist() for p in pages], pa.list_(pa.list_(pa.int32())))
    for at in range(3):  # a slice begins inside of its buffers
        got = arrow.images_of(column[at:])
        assert [x.tolist() for x in got] == [[] if p is None else p.tolist() for p in pages[at:]]
    assert arrow.pixels(arrow.images_of(column)).to_pylist() == [x or [] for x in column.to_pylist()]
    grey = rnd.integers(0, 255, (20, 30)).astype(np.uint8)
    df = spark.createDataFrame([(grey.tolist(),), ([],), (grey[:, :9].tolist(),)], "p array<array<int>>")
    got = [r[0] for r in df.select(signal.prepared_lines("p")).collect()]
    assert got == [signal.prepared(grey).tolist(), [], signal.prepared(grey[:, :9]).tolist()]


def test_few_boxes_are_refined_where_they_are(spark):
    """Pages of few boxes give what joins give, and their plan moves no pixels."""
    rnd = np.random.default_rng(7)
    rows = [(p, rnd.integers(0, 255, (30, 60)).tolist(), [tuple(int(v) for v in b[2:]) for b in scattered(rnd, n, 1)]) for p, n in enumerate((1, 5, 20, 60, 80, 3))]
    clip = lambda b: (max(b[0], 0), max(b[1], 0), max(b[2], 0), max(b[3], 0))
    rows = [(p, g, [clip(b) for b in bs]) for p, g, bs in rows] + [(9, rows[0][1], [])]
    df = spark.createDataFrame(rows, "page int, rows array<array<int>>, b array<struct<x0:int,y0:int,x1:int,y1:int>>")
    each = df.select("page", F.posexplode("b").alias("key", "b")).select("page", "key", "b.*")
    joined = {}
    for r in boxes.drop_contained(boxes.drop_slivers(each, "page", "key"), "page", "key").collect():
        joined.setdefault(r["page"], []).append(tuple(r)[1:])
    for p, _, bs in rows:
        assert boxes.outstanding(np.array(bs, np.int64).reshape(-1, 4)).tolist() == [list(b[1:]) for b in sorted(joined.get(p, []))]
    got = boxes.refine(df, "page", "rows", "b")
    assert sorted(r["page"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert all(r["refined"] == [] for r in got.where("page = 9").collect())
    few = boxes.refine(df.where("page < 4"), "page", "rows", "b")
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()


def test_readers_share_one_pass(spark):
    from quorumtext.plans import inference

    for k in range(2):
        inference.register(f"reader{k}", lambda k=k: lambda f: f.assign(text=f.t + str(k))[["t", "text"]], "t string, text string")
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    both = inference.predict_all(df, ["reader0", "reader1"], ["t"])
    assert sorted(map(tuple, both.collect())) == [("a", "a0", 0, "reader0"), ("a", "a1", 1, "reader1"), ("b", "b0", 0, "reader0"), ("b", "b1", 1, "reader1")]
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_long_documents_are_painted_in_time_that_grows_with_their_length(spark, tmp_path):
    """A text of 300,000 letters; to seek each of them from the text's start takes minutes."""
    import time

    from quorumtext.plans import queries_geometry

    text = "".join(chr(97 + i * i % 26) + "é" for i in range(150_000)) + "rest"
    spark.createDataFrame([(1, text), (2, "too short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.time()
    got = {r["kind"]: (r["total"], r["mixed"]) for r in queries_geometry.image_variants(spark, str(tmp_path)).collect()}
    assert time.time() - start < 60
    whole = len(text) // 16 * 16
    grey = np.array([(ord(c) * 37 + i) % 256 for i, c in enumerate(text[:whole], 1)], np.uint8).reshape(-1, 16)
    assert set(got) == set(signal.VARIANTS)
    for kind in signal.VARIANTS:
        made = signal.variant(grey, kind).ravel().tolist()
        mixed = 0
        for p in made:
            mixed = (mixed * 31 + p) % 1000003
        assert got[kind] == (sum(made), mixed)
