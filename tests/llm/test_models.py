"""Classifiers, chat, pages and embeddings, and the pipeline on small tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtext.llm import capfilter, chat, quality, toxicity, wrappers
from quorumtext.llm.labelled import held_out


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abdeginorst", k=rnd.randint(2, 8)))
    docs, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rnd.randint(8, 60))]
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zvilest", "qworst", "xul" + word()]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, 3))
        labels.append((i, int(good), int(toxic)))
    docs += [(None, "a b"), (9000, None), (9001, ""), (9002, "plain words here " * 5000)]
    return spark.createDataFrame([(d[0], d[1], 3) for d in docs], "doc_id long, text string, score int"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (123456, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name, modulus, rest):
    want = {r["doc_id"]: r[name] for r in labels.collect() if r["doc_id"] is not None and r[name] is not None}
    held = [r for r in rows if r["doc_id"] in want and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest]
    assert len(held) > 100
    return sum((r["s"] >= 0.7) == bool(want[r["doc_id"]]) for r in held) / len(held)


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", quality.score(docs.text, model).alias("s"), held_out(docs.doc_id, 4, 2).alias("h")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    assert accuracy(rows, labels, "quality", 4, 2) > 0.95
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    empty = quality.fit(docs, labels.limit(0))
    assert {round(r["s"], 6) for r in docs.select(quality.score(docs.text, empty).alias("s")).collect()} == {0.5}


def test_pooling_of_violators():
    assert quality.pool(np.ones(5), np.array([0.0, 1.0, 0.5, 0.5, 2.0])).tolist() == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 2])


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", toxicity.score(docs.text, model).alias("s")).collect()
    assert len(rows) == docs.count() and accuracy(rows, labels, "toxic", 3, 1) > 0.95
    tagged = spark.createDataFrame([("aa İ zvilest bb",), (None,)], "text string").select(toxicity.tag(F.col("text"), model).alias("t")).collect()
    assert [(s["start"], s["end"]) for s in tagged[0]["t"]["spans"]] == [(5, 12)] and tagged[1]["t"]["spans"] == []
    assert toxicity.fit(docs, labels.limit(0)).tag("zvilest")[0] < 0.1


def test_marginals_against_all_labellings():
    import itertools
    import math

    field = toxicity.Field({}, -1.0, ((0.2, -0.4), (-0.3, 0.9)))
    evidence = [0.0, 2.0, -1.0, 3.0]
    total, mass = 0.0, [0.0] * 4
    for y in itertools.product((0, 1), repeat=4):
        w = math.exp(sum((field.bias + e) * t for e, t in zip(evidence, y, strict=True)) + sum(field.moves[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        mass = [m + w * t for m, t in zip(mass, y, strict=True)]
    assert field.marginals(evidence) == pytest.approx([m / total for m in mass])


def test_likelihood_of_windows_against_all_labellings():
    import itertools

    rnd = np.random.default_rng(2)
    w = rnd.normal(size=3 + 5)
    f = rnd.integers(-1, 3, size=(5, 4, 2))
    y = rnd.integers(0, 2, size=(5, 4))
    y[0, 0] = y[1, 3] = y[2, :2] = -1

    def whole(w):
        total = 0.0
        for own, label in zip(f, y, strict=True):
            inside = np.flatnonzero(label >= 0)
            emit = [w[own[i][own[i] >= 0]].sum() + w[3] for i in inside]
            of = lambda z: sum(e * t for e, t in zip(emit, z, strict=True)) + sum(w[4 + 2 * a + b] for a, b in zip(z, z[1:], strict=False))
            total += of(label[inside].tolist()) - np.log(sum(np.exp(of(z)) for z in itertools.product((0, 1), repeat=len(inside))))
        return total

    found = toxicity.likelihood(f, y, w)
    assert found[0] == pytest.approx(whole(w))
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        assert found[1 + i] == pytest.approx((whole(w + step) - whole(w - step)) / 2e-6, abs=1e-4)
    twice = toxicity.likelihood(np.concatenate([f, f[:2]]), np.concatenate([y, y[:2]]), w)
    assert toxicity.likelihood(f, y, w, np.array([2, 2, 1, 1, 1])) == pytest.approx(twice)
    best = toxicity.ascend(lambda w: toxicity.likelihood(f, y, w), w, penalty=0.5, steps=60)
    slope = toxicity.likelihood(f, y, best)[1:] - 0.5 * best
    assert np.abs(slope).max() < 0.05


def test_tokens_keep_their_marks():
    assert toxicity._TOKEN.findall("हिन्दी नाम_a1 e\u0301te\u0301") == ["हिन्दी", "नाम", "a", "e\u0301te\u0301"]


def test_chat_round_trip(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "<||<|", "", None, "<|image_0|>", "x" * 200_000 + "<"]
    rows = [(i % 3, i // 3, r, t, 0) for i, (t, r) in enumerate((t, r) for t in hard for r in ("user", "assistant", "a\n<|n>b", None))]
    df = spark.createDataFrame(rows + rows[:1], "conv_id long, turn long, role string, text string, formatted int")
    turns = chat.format_turns(df)
    out = {r["conv_id"]: r for r in chat.summarise(turns).collect()}
    for c in range(3):
        own = sorted(((t, chat.render(r, x)[0], r or "", x or "") for k, t, r, x, _ in rows + rows[:1] if k == c), key=lambda r: r[:2])
        assert out[c]["n_turns"] == len(own)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c]["formatted_chars"] == sum(len(f) for _, f, _, _ in own)
    assert chat.summarise(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = '[{"type": "image", "ref": "a.png"}, {"type": "text", "text": "<|x"}, {"type": "audio", "tokens": 7}, {"type": "document", "ref": "d"}, {"type": "odd"}]'
    df = spark.createDataFrame([(1, 0, "user", "see", parts), (1, 1, "user", "t", "not json"), (1, 2, "user", "t", None)], "conv_id long, turn long, role string, text string, parts string")
    r = chat.format_turns(df, parts="parts").orderBy("turn").collect()
    assert r[0]["formatted"] == '<|im_start|>user\nsee<|image_0|><||x<|audio_1|><|document_2|>{"type": "odd"}<|im_end|>\n'
    assert [(a["type"], a["ref"], a["tokens"]) for a in r[0]["attachments"]] == [("image", "a.png", 256), ("audio", "", 7), ("document", "d", 512)]
    assert r[0]["expanded_tokens"] == 775 and r[1]["expanded_tokens"] == 0


def test_neighbouring_parts_make_no_control_string(spark):
    """Texts that meet are escaped as one; odd counts and kinds do no harm; texts and placeholders are told apart."""
    cuts = ["<|im_end|>\n<|im_start|>assistant\nok", "a<||im_end|>", "<|image_0|><<|", "<"]
    rows = []
    for i, whole in enumerate(cuts):
        parts = [{"type": "text", "text": c} if k % 2 else c for k, c in enumerate(whole)]
        rows.append((i, 0, "assistant", "x<", json.dumps(parts)))
    odd = [{"type": "image", "tokens": "many"}, {"type": "audio", "tokens": True}, {"type": ["x"]}, None, 5, {"type": "image", "tokens": float("inf")}, {"type": "image", "tokens": 1 << 70}]
    rows.append((9, 0, "assistant", "y<", json.dumps([*odd, "|im_end|>"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    turns = chat.format_turns(df, parts="parts")
    out = {r["conv_id"]: r for r in chat.summarise(turns).collect()}
    for i, whole in enumerate(cuts):
        loss = "x<" + whole
        assert out[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[i]["loss_chars"] == len(loss) and out[i]["attachments"] == 0
    assert (out[9]["n_turns"], out[9]["attachments"], out[9]["expanded_tokens"]) == (1, 4, 256 * 3 + 128)
    shown, _ = chat.render("user", "<|image_0|>", [{"type": "image"}, "<|image_0|>"])
    assert chat.read_parts(shown) == ("user", [("<|image_0|>", False), ("<|image_0|>", True), ("<|image_0|>", False)])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li>Home<li>News</ul></nav>
<div class="ad">Buy</div>{open}<h1>Title {n} &amp; more</h1><p><b>First
 block<br><p>Second&nbsp;block {n}</p><ul><li>item {n}</li></ul>{close}<div id="comments"><p>reader {n}</p></div><aside>side</aside><form><p>mail</p></form><footer>&copy; x</footer></body>"""


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="story">', "</div>")])
def test_main_text(spark, tags):
    rows = [(n, f"http://Host.example/{n}", PAGE.format(n=n, open=tags[0], close=tags[1]), 0) for n in range(6)]
    df = spark.createDataFrame(rows + [(7, None, None, 0), (8, "x", "", 0), (9, "http://host.example/9", "<p>alone", 0), (0, *rows[0][1:])], "page_id long, url string, html string, text int")
    out = wrappers.main_text(df).collect()
    assert len(out) == 10
    for r in out:
        if r["page_id"] < 6:
            assert r["text"] == f"Title {r['page_id']} & more\nFirst block\nSecond block {r['page_id']}\nitem {r['page_id']}"
    assert {r["page_id"]: r["text"] for r in out if r["page_id"] > 6} == {7: "", 8: "", 9: "alone"}
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_words_of_class_and_id(spark):
    """Topics and layouts named by the page's own elements are no containers apart; words count as a whole."""
    body = "<h1>Title</h1><p>Text</p>"
    whole = [
        f'<body class="home has-sidebar"><article class="post type-post hentry category-news tag-health">{body}</article></body>',
        f'<body class="search"><main class="legal-news no-sidebar">{body}</main></body>',
        f'<div class="legal-news">{body}</div><div class="sidebar wide">x</div><div id="comments">y</div>',
        f'<div class="widget">{body}</div><nav>menu</nav>',
    ]
    rows = [(i, f"http://h{i}.example/", page) for i, page in enumerate(whole)]
    out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {"Title\nText"} and len(out) == len(whole)


def test_copies_and_rare_slots_are_no_template(spark):
    """Copies count as one page, and what few of a host's pages share is content; what most share is template."""
    page = lambda body, n: f"<div class='top'>Our site</div><div class='story'><p>Story {body}</p></div><div class='date'>day {n}</div>"
    rows = [(i, "http://a.example/", page("one", 1).replace("class='story'", "id='post-17'")) for i in range(5)]
    rows += [(i, "http://a.example/", page("dated", i).replace("class='story'", "id='post-18'")) for i in range(5, 10)]
    rows += [(i, "http://a.example/", page(i, i) + ("<h2>Notes</h2>" if i % 4 == 0 else "")) for i in range(10, 30)]
    rows += [(30, "http://a.example/", "plain & simple")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == ["Story one\nday 1"] * 5
    assert [got[i] for i in range(5, 10)] == [f"Story dated\nday {i}" for i in range(5, 10)]
    assert all(got[i] == f"Story {i}\nday {i}" + ("\nNotes" if i % 4 == 0 else "") for i in range(10, 30))
    assert got[30] == "plain & simple"


def test_wrappers_have_optional_and_repeated_groups():
    one = wrappers.fold(["h1", "p", "p", "p", "ul/li", "ul/li"])
    two = wrappers.fold(["h1", "p", "figure", "p"])
    wrapper = wrappers.align([(t, 1) for t in one], [(t, 1) for t in two])
    shown = wrappers.expression(wrapper, 2)
    assert one == ["h1", ("+", "p"), ("+", "ul/li")] and "(<p>#)+" in shown and ")?" in shown and "|" not in shown
    assert wrapper[0] == ("h1", 2) and wrapper[1] == (("+", "p"), 2)
    # Every block of a stream that the wrapper was made of is bound, in order, to a place that holds its token.
    for page in (["h1", "p", "p", "p", "ul/li", "ul/li"], ["h1", "p", "figure", "p"]):
        places = wrappers.bound(wrapper, page)
        assert places == sorted(places) and all(t in wrappers.bare(wrapper[p][0]) for t, p in zip(page, places, strict=True))
    assert wrappers.bound(wrapper, ["x", "h1", "p"]) == [-1, 0, 1]


def test_folded_streams_stand_for_all_their_blocks():
    rnd = random.Random(3)

    def spelled(token):
        return token if isinstance(token, str) else f"({''.join(map(spelled, token[1:]))})+"

    for _ in range(300):
        page = rnd.choices("abc", k=rnd.randint(0, 40))
        found = wrappers.folded(page)
        assert sum(n for _, n in found) == len(page) and re.fullmatch("".join(spelled(t) for t, _ in found), "".join(page))


def test_places_and_not_texts_are_template(spark):
    """One text at one path is template where the wrapper has it on most pages, and content where it stands besides."""
    page = lambda i, more="": f"<div><p>Home</p><p>Story {i}</p>{more}<p>Contact us</p></div>"
    rows = [(i, "http://a.example/", page(i)) for i in range(10)] + [(10, "http://a.example/", page(10, "<p>Home</p>"))]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(10)) and got[10] == "Story 10\nHome"


def test_many_streams_of_a_host_make_one_wrapper(spark, monkeypatch):
    """Rounds of merges, joins by parts: as if a host were too large for a task, and wrappers for a broadcast."""
    monkeypatch.setattr(wrappers, "MERGED", 3)
    monkeypatch.setattr(wrappers, "fits", lambda *_: False)
    parts = ["<h2>Part {i}</h2>", "<ul><li>item {i}<li>more {i}</ul>", "<blockquote>said {i}</blockquote>", "<table><tr><td>cell {i}</table>", "<pre>code {i}</pre>"]
    text = ["Part {i}", "item {i}\nmore {i}", "said {i}", "cell {i}", "code {i}"]
    rows, want = [], {}
    for i in range(32):
        own = [k for k in range(5) if i >> k & 1]
        body = "".join(parts[k].format(i=i) for k in own)
        rows.append((i, "http://a.example/", f"<div id='post-{i}'><p>Subscribe now</p><h1>Title {i}</h1>{body}<p>All rights reserved</p></div>", "x", "y"))
        want[i] = "\n".join([f"Title {i}", *[text[k].format(i=i) for k in own]])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    assert {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()} == want
    found = wrappers.infer(df).collect()
    assert len(found) == 1 and found[0]["pages"] == 32 and len(found[0]["fixed"]) == 2


def test_broken_pages_lose_nothing_else():
    texts = lambda page: [t for _, t in wrappers.slots(page)]
    assert texts("one<button>go<p>two") == ["one", "go", "two"]
    assert texts("one<button>go</button><p>two<select><option>x</select>three") == ["one", "two", "three"]
    assert texts('a <b title="x>y">bold</b> <a href="z>c</a>d<p>e') == ["a bold c d", "e"] or texts('a <b title="x>y">bold</b> <a href="z>c</a>d<p>e') == ["a bold cd", "e"]
    assert texts("1 < 2 <p>x<!-- no") == ["1 < 2", "x"] and texts("a < b") == ["a < b"] and texts("<script>x") == []


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "< ", "<!-- ", "<button>", "<p>", "<![CDATA[", "<a '\">", "&amp;<b>x"])
def test_long_pages_take_linear_time(unit):
    import time

    for end in ("", ">", '">'):
        start = time.time()
        wrappers.slots(unit * (1_000_000 // len(unit)) + end)
        assert time.time() - start < 5


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rnd.normal(size=24)
            for _ in range(rnd.integers(1, 6)):
                rows.append((k, (base + rnd.normal(size=24) * 0.09 * rnd.random()).tolist(), label))
                k += 1
    rows += [(k + i, rows[0][1], 0) for i in range(5)]
    rows += [(900, (np.array(rows[0][1]) * 3).tolist(), 0)]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [None] * 24, 0), (1004, rows[0][1], None), (1005, [], 0), (None, rows[0][1], 0), (1006, [1.0], 0), (1007, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 9) for r in rows + odd], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: r for r in capfilter.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    label = list(range(len(rows)))
    for _ in range(8):
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    for i, v in enumerate(ids):
        assert got[v]["n_links"] == near[i].sum() - 1 and got[v]["component_id"] == ids[label[i]]
    assert all(got[v]["n_links"] == 0 and got[v]["component_id"] == v for v in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007)) and got[None]["kept"]
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_links_of_a_part_are_kept_whole():
    a, b = np.array([0, 1, 4, 3]), np.array([1, 2, 3, 2])
    assert capfilter.gathered(np.array([5, 3, 9, 1, 7, 2]), a, b).tolist() == [1, 1, 1, 1, 1, 2]
    x = np.array([1.0, 0.1])
    assert len(capfilter.packed(x).tobytes()) == 16 and len(capfilter.packed(x.astype(np.float32).astype(float)).tobytes()) == 8


def test_decoded_caps_hold_the_vector():
    rnd = np.random.default_rng(1)
    units = rnd.normal(size=(20, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rotation, words = capfilter.code(32)
    turned = units @ rotation
    parts = np.array_split(np.arange(32), len(words))
    sums = (turned[:, parts[0]] @ words[0].T)[:, :, None] + (turned[:, parts[1]] @ words[1].T)[:, None, :]
    for i, found in enumerate(capfilter.decode(units)):
        every = np.sort(sums[i].ravel())[::-1]
        assert np.allclose(np.sort(sums[i].ravel()[found])[::-1], every[: len(found)]) and len(found) >= capfilter.LEAST


def test_pipeline(spark, tmp_path, labelled):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled
    rnd = random.Random(0)
    clean = " ".join("".join(rnd.choices("abdeginorst", k=5)) for _ in range(40))
    leak = " ".join(f"bench{i}" for i in range(20))
    more = spark.createDataFrame([(5000, clean), (5001, clean + " end"), (5000, clean), (5002, f"{clean[::-1]} {leak}"), (5003, leak.upper() + "!!")], "doc_id long, text string")
    whole = docs.select("doc_id", "text").unionByName(more).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as `__n`")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == at.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        at = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert 5000 in seen[-1] and 5001 not in seen[2] and 5002 in seen[2] and 5002 not in seen[3]
    assert at.where("doc_id = 5000").count() == 1 and at.where("not round_trip").count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Main</p></article><section class="replies"><article><p>reader says</p></article></section>', "Main"),
        ('<article><p>Main</p><article class="comment depth-2"><p>reader says</p></article></article>', "Main"),
        ('<article><p>Main</p><div class="comment-list"><p>reader</p></div><div id="postComments">reader</div></article>', "Main"),
        ('<article><div class="ad-slot">Buy</div><p>Main</p><div class="ads_box"><p>Buy</p></div><div class="ad-banner top">Buy</div><div class="adSlot">Buy</div></article>', "Main"),
        ('<div id="gdpr"><p>We use cookies</p></div><div class="story"><p>Main</p></div>', "Main"),
        ('<article class="teaser"><p>Other story</p></article><div class="story"><p>Main long story</p></div>', "Main long story"),
        ('<form id="aspnetForm"><nav>menu</nav><article><h1>Title</h1><p>Main</p></article></form>', "Title\nMain"),
        ('<aside><div class="modal"><main><p>Main</p><footer>f</footer></main></div></aside>', "Main"),
        ("<article><header><h1>Title</h1></header><p>Main</p><footer>f</footer></article><header>Site</header>", "Title\nMain"),
        ("<article><p>If <math><mi>x</mi></math> holds</p><textarea>open<p>Main</p></article>", "If x holds\nopen\nMain"),
        ('<body class="has-sidebar"><div class="layout no-sidebar with-ads"><div class="article-banner-image"><p>Main</p></div></div></body>', "Main"),
        ('<div id="gdpr"><p>We use cookies</p></div><nav><h1>menu</h1></nav>', ""),
        ("<nav>" * 30 + "<p>" + "x" * 200, ""),
    ],
)
def test_containers_of_real_pages(page, text):
    assert wrappers.article(wrappers.slots(page), None) == text


def test_template_goes_from_articles_too(spark):
    """What most pages of a host show at one place is no content, in an article element as well; inside the content it stays."""
    page = lambda i: f"<article><div>Home of news</div><div class='text'><p>Story {i}</p><p>Advice</p><p>More {i}</p></div><div>Read on</div></article>"
    rows = [(i, "http://a.example/", page(i)) for i in range(8)] + [(8, "http://b.example/", page(8))]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nAdvice\nMore {i}" for i in range(8)) and got[8] == "Home of news\nStory 8\nAdvice\nMore 8\nRead on"
