"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a stream of text blocks, each with the path of its open block tags. Blocks that show one
text on many of a host's distinct pages are candidates for its template and keep their text in
the stream; all others are slots. Equal neighbouring groups are folded into repeated groups, which leaves
few distinct streams for a host. These are aligned iteratively, in rounds that merge a bounded number each:
what aligns is one place of the wrapper and adds up its pages, what only some streams hold is an
optional place. So a wrapper has fixed texts, text slots, `( )+` and `( )?`, but no unions.

To extract, a page's stream is aligned with its host's wrapper, which binds its blocks to places. A place
with a fixed text on most of the host's distinct pages is template, unless it stands within the content of its
own container; the same text at another place is content, inside article and main elements as well. Tags and marks of menus, notices
and the like are left out, unless they hold all that tells of an article.

Counts are summed by host with partial aggregates, and pages meet their host's wrapper in parts, so a host
may hold any share of the pages. Wrappers of rare hosts lack evidence about fixed texts; there tags decide alone.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, salt, salts_held, salts_of, with_group

#: Tags that end a block of text; all others stand inside one.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Tags without content, and tags whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
#: Of these, the ones that swallow the rest of a page if they are not closed; other unclosed ones are passed over.
SWALLOW = frozenset("script style".split())
#: Containers that never hold the article, by tag, role or whole words of class and id.
ASIDE_TAGS = frozenset("nav header footer aside form head menu dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ASIDE_WORDS = re.compile(r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|footer|header|masthead|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscri\w*|comment\w*|respond|discuss\w*|disqus|share\w*|social|related|recommend\w*|breadcrumb\w*|pagination|pager|widget\w*|search|login|signup|copyright|legal|tags?|toolbar|skip", re.I)
#: Parts of such words, cut at hyphens, underscores and capitals, that tell as much at either end of them: `comment-list`, `post-comments`, `adSlot`.
ASIDE_PARTS = re.compile(r"ads?|adv|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|ccpa|newsletter|subscri\w*|comments?|repl(?:y|ies)|disqus|related|recommend\w*|social|sidebar|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|teasers?|footer|popup|modal|widget|masthead|toolbar", re.I)
#: Words that begin like this tell how a page is laid out.
LAYOUT = frozenset("has with no without is not layout".split())
#: What an article element's own marks may say of it: that it is a reader's, another article's or an advert's.
OTHER_ARTICLE = re.compile(r"comments?|repl(?:y|ies)|teasers?|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*", re.I)
#: Elements that hold the whole page or the article itself: the words of their class and id tell its topic or layout.
FRAME = frozenset("html body main article".split())
#: Distinct pages, and share of the host's distinct pages, on which a slot must show one and the same text to count as template.
CONSTANT_FROM, CONSTANT_SHARE = 4, 0.5
#: Letters of a paragraph that may be an article's.
PARAGRAPH = 140
#: Streams that a task merges at once, about.
MERGED = 32
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")
_ENDS_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: An opening tag of the first kind ends an open element of the second kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NUMBER, _MARK = re.compile(r"\d+"), re.compile(r"\.[^/]*")
_IN_P = BLOCKS - {"br", "p"}


def slots(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of every text slot, in page order; a path names the open block elements from the root.

    Comments, scripts, styles and the like are left out, character references decoded and white space
    made one space. Missing end tags are supplied as browsers do for paragraphs, list items and cells;
    an end tag that nothing opened is ignored. A page is read from start to end: unclosed tags, quotes
    and comments take no second look at the rest.
    """
    page = page or ""
    found: list[tuple[str, str]] = []
    path: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            found.append(("/".join(path), text))
        run.clear()

    def pop(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(path) - 1, -1, -1):
            name = path[i].partition(".")[0]
            if name in names:
                close()
                del path[i:]
                return
            if name in stop:
                return

    at, size, bracket = 0, len(page), 0
    unclosed: set[str] = set()
    while True:
        start = page.find("<", at)
        if start >= 0 and 0 <= bracket <= start:
            bracket = page.find(">", start)
        if start < 0 or bracket < 0 and not page.startswith("<!--", start):
            run.append(page[at:])
            break
        run.append(page[at:start])
        lead = page[start + 1 : start + 2]
        if lead in ("!", "?"):
            mark = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(mark, start + 1)
            at = size if end < 0 else end + len(mark)
            continue
        token = _TAG.match(page, start + 1)
        if token:
            at = token.end()
        elif token := _NAME.match(page, start + 1):  # quotes that are not closed: the tag ends at the next bracket
            at = bracket + 1
        else:
            run.append("<")
            at = start + 1
            continue
        name, attributes = token[2].lower(), token[3] if token.re is _TAG else ""
        if token[1]:
            if name in BLOCKS:
                pop({name}, frozenset() if name in ("html", "body") else frozenset({"html", "body"}))
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = None if name in unclosed else _ENDS_OF[name].search(page, at)
            if end or name in SWALLOW:
                at = end.end() if end else size
            else:
                unclosed.add(name)
            if name in BLOCKS:
                close()
            continue
        if name not in BLOCKS:
            continue
        close()
        if name in VOID:
            continue
        if name in _IN_P or name == "p":
            pop({"p"}, frozenset({"html", "body", "article", "section", "div", "td", "li", "blockquote"}))
        if name in _ENDS:
            pop(_ENDS[name], frozenset({"ul", "ol", "dl", "table", "html", "body", "select"}))
        marks = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        mark = " ".join(marks[k] for k in ("class", "id", "role") if marks.get(k))
        path.append(f"{name}.{mark.replace('/', ' ')}" if mark else name)
    close()
    return found


def _parts(mark: str) -> list[str]:
    return [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", mark) if x]


@lru_cache(maxsize=1 << 14)
def aside(step: str) -> bool:
    """Whether the marks of a step of a path say that it is apart; those of the page's own elements say nothing."""
    name, _, marks = step.partition(".")
    if name in FRAME:
        return name == "article" and any(OTHER_ARTICLE.fullmatch(end) for m in marks.split() for p in [_parts(m)] if p and p[0] not in LAYOUT for end in (p[0], p[-1]))
    for m in marks.split():
        parts = _parts(m)
        if m.lower() in ASIDE_ROLES or ASIDE_WORDS.fullmatch(m) or parts and parts[0].lower() not in LAYOUT and (ASIDE_PARTS.fullmatch(parts[0]) or ASIDE_PARTS.fullmatch(parts[-1])):
            return True
    return False


def apart(path: str, overruled: frozenset[str] = frozenset()) -> str:
    """The outermost container on a path that never holds the article, by its tags or its marks, as the path to it; empty if there is none.

    An article's own header belongs to it. Containers in `overruled` are passed over.
    """
    within, at = False, 0
    for step in path.split("/"):
        at += len(step)
        name = step.partition(".")[0]
        if (name in ASIDE_TAGS and not (within and name == "header") or aside(step)) and path[:at] not in overruled:
            return path[:at]
        within = within or name == "article"
        at += 1
    return ""


#: Stands between a path and the name of its fixed text.
FIXED = "\x00"


def folded(tokens: list[str], longest: int = 8) -> list[tuple[object, int]]:
    """Equal neighbouring groups as one repeated group ("+", ...), shortest groups first; each with how many of the tokens it stands for.

    Fixed texts are places of their own and stay outside groups.
    """
    found: list[tuple[object, int]] = [(t, 1) for t in tokens]
    for n in range(1, longest + 1):
        names = [t for t, _ in found]
        out: list[tuple[object, int]] = []
        i = 0
        while i < len(names):
            group, j = names[i : i + n], i + n
            if not any(isinstance(t, str) and FIXED in t for t in group):
                while len(group) == n and names[j : j + n] == group:
                    j += n
            if j > i + n:
                out.append((("+", *group), sum(k for _, k in found[i:j])))
                i = j
            else:
                out.append(found[i])
                i += 1
        found = out
    return found


def fold(tokens: list[str]) -> list[object]:
    """folded() without counts."""
    return [t for t, _ in folded(tokens)]


def plain_path(path: str) -> str:
    """A path as wrappers know it: numbers in its marks, which often are the page's own, made one."""
    return _MARK.sub(lambda m: _NUMBER.sub("0", m[0]), path).replace(FIXED, "") if "." in path else path


def block_key(path: str, text: str) -> int:
    """A 64-bit name of a text at a path."""
    return _digest(f"{plain_path(path)}\n{text}")


def stream(found: list[tuple[str, str]], fixed: set[int]) -> list[str]:
    """The tokens of a page's blocks: paths, and for texts of `fixed` their names after the path."""
    out = []
    for path, text in found:
        name = block_key(path, text) if fixed else 0
        out.append(f"{plain_path(path)}{FIXED}{name}" if name in fixed else plain_path(path))
    return out


def bare(token: object) -> tuple:
    """What a token repeats, or itself: a group that stands once aligns with the same group repeated."""
    return token[1:] if isinstance(token, tuple) else (token,)


def matched(wrapper: list[object], page: list[object]) -> Iterator[tuple[int, int, int]]:
    """(place in the wrapper, place in the page, length) of aligned runs, in order. In long ones, frequent tokens only extend runs."""
    a, b = [bare(t) for t in wrapper], [bare(t) for t in page]
    return iter(difflib.SequenceMatcher(None, a, b, autojunk=max(len(a), len(b)) > 400).get_matching_blocks())


def align(wrapper: list[tuple[object, int]], page: list[tuple[object, int]]) -> list[tuple[object, int]]:
    """The wrapper, of (token, pages that hold it), made to fit other pages too.

    Aligned tokens are one place with the pages of both, repeated if either is; what only one side
    holds stays a place of its own, and so becomes optional.
    """
    out: list[tuple[object, int]] = []
    at, other = 0, 0
    for i, j, n in matched([t for t, _ in wrapper], [t for t, _ in page]):
        out += wrapper[at:i] + page[other:j]
        for (mine, k), (theirs, m) in zip(wrapper[i : i + n], page[j : j + n], strict=True):
            out.append((mine if isinstance(mine, tuple) else theirs, k + m))
        at, other = i + n, j + n
    return out


def expression(wrapper: list[tuple[object, int]], pages: int) -> str:
    """A wrapper in the notation of regular expressions, text slots as #; places that not all pages hold are optional."""

    def show(t: object) -> str:
        if isinstance(t, tuple):
            return f"({' '.join(show(x) for x in t[1:])})+"
        path, _, name = t.partition(FIXED)
        return f"<{path}>{'text' if name else '#'}"

    return " ".join(show(t) if n == pages else f"({show(t)})?" for t, n in wrapper)


def bound(wrapper: list[tuple[object, int]], page: list[str]) -> list[int]:
    """For each block of a page's stream the place of the wrapper that it is bound to, or -1."""
    tokens = folded(page)
    places = [-1] * len(tokens)
    for i, j, n in matched([t for t, _ in wrapper], [t for t, _ in tokens]):
        places[j : j + n] = range(i, i + n)
    return [place for (_, n), place in zip(tokens, places, strict=True) for _ in range(n)]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def _page_digest(found: list[tuple[str, str]]) -> int:
    """A page's digest, of the text that is not apart: copies differ in menus and notices at most."""
    return _digest("\n".join(text for path, text in found if not apart(path)))


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each page and each distinct block of it, with the page's digest; the page itself has no block."""
    for frame in frames:
        rows = []
        for where, page in zip(frame.host, frame.html, strict=True):
            found = slots(page)
            own = _page_digest(found)
            rows.append((where, None, own))
            rows += [(where, name, own) for name in {block_key(path, text) for path, text in found}]
        where, names, own = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"host": list(where), "block": pd.array(list(names), dtype="Int64"), "page": list(own)})


def _host(url: Column) -> Column:
    """The host part of a URL in lower case without user, port and a leading `www.`; empty if there is none."""
    name = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def _meet(pages: DataFrame, of_host: DataFrame, size: Column) -> DataFrame:
    """pages (with host and __salt) with what is known of their host; of_host has the parts (salts) that a host's pages fall into."""
    if fits(of_host, size):
        return pages.join(F.broadcast(of_host.drop("salts")), "host", "left")
    dealt = of_host.withColumn("__salt", F.explode(salts_of("salts"))).drop("salts")
    return pages.join(dealt, ["host", "__salt"], "left")


def _keyed(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(key, url, html, host, __salt) of every page; copies of a page, which differ in key or URL, fall into different parts."""
    own = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"), _host(pages[url]).alias("host"))
    return own.withColumn("__salt", salt("key", "url"))


def infer(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(host, salts, pages, fixed, wrapper): for every host its distinct pages, the names of texts that may be template, and its wrapper.

    Copies of a page are one page to the evidence. A text may be template if CONSTANT_FROM distinct
    pages, and CONSTANT_SHARE of those of its host, show it at one path; hosts without such texts have no
    wrapper. The wrapper is JSON: a list of (token, pages that hold it).
    """
    rows = _keyed(pages, key, url, page).select("host", "html", "__salt")
    held = rows.groupBy("host", "__salt").agg(F.lit(1).alias("one")).groupBy("host").agg(salts_held().alias("salts"))
    counts = rows.select("host", "html").mapInPandas(_blocks, "host string, block long, page long").distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    counts = cut(counts.where(F.col("block").isNull() | (F.col("n") >= CONSTANT_FROM)))
    whole = counts.where("block is null").select("host", F.col("n").alias("pages"))
    often = counts.where("block is not null").join(whole, "host").where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    # A host's pages have these texts each on half of them at least: twice as many as a page has, at most.
    fixed = often.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("fixed"))
    known = whole.join(held, "host").join(fixed, "host", "left")
    known = cut(known.select("host", "salts", "pages", F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed")))

    def skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for body, fixed in zip(frame.html, frame.fixed, strict=True):
                found = slots(body)
                made.append((json.dumps([[t, 1] for t in fold(stream(found, set(fixed)))]), _page_digest(found)))
            yield pd.DataFrame({"host": frame.host, "wrapper": [w for w, _ in made], "page": [d for _, d in made]})

    with_fixed = _meet(rows, known.select("host", "salts", "fixed"), 8 * F.size("fixed") + F.octet_length("host") + 64)
    streams = with_fixed.select("host", "html", "fixed").mapInPandas(skeletons, "host string, wrapper string, page long").distinct()
    streams = cut(streams.groupBy("host", "wrapper").agg(F.count("*").alias("n")))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by host and part and, within one, from the commonest stream on; one wrapper is held at a time.
        at, merged, n = None, None, 0
        for frame in frames:
            done = []
            for where, part, text, k, times in zip(frame.host, frame.part, frame.wrapper, frame.n, frame.times, strict=True):
                if (where, part) != at:
                    if at is not None:
                        done.append((at[0], json.dumps(merged), n))
                    at, merged, n = (where, part), None, 0
                own = [(_tuple(t), m * times) for t, m in json.loads(text)]
                merged = own if merged is None else align(merged, own)
                n += k
            yield pd.DataFrame(done, columns=["host", "wrapper", "n"])
        if at is not None:
            yield pd.DataFrame([(at[0], json.dumps(merged), n)], columns=["host", "wrapper", "n"])

    first = True
    while True:  # each round leaves about one stream of MERGED
        counted = with_group(streams, ["host"], ["wrapper"], {"k": ("count(*)", "sum(k)")})
        parts = F.ceil(F.col("k") / MERGED).cast("int")
        dealt = counted.withColumns({"part": F.pmod(F.hash("wrapper"), parts), "times": F.col("n") if first else F.lit(1)})
        ordered = dealt.repartition("host", "part").sortWithinPartitions("host", "part", F.col("n").desc(), "wrapper")
        streams = cut(ordered.select("host", "part", "wrapper", "n", "times").mapInPandas(merge, "host string, wrapper string, n long"))
        first = False
        if streams.groupBy("host").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
    return known.join(streams.select("host", "wrapper"), "host")


def _tuple(t: object) -> object:
    """JSON arrays inside a token as tuples again."""
    return tuple(_tuple(x) for x in t) if isinstance(t, list) else t


def _inner(path: str) -> bool:
    return any(step.partition(".")[0] in ("article", "main") for step in path.split("/"))


class Wrapper:
    """A host's wrapper for extraction: its places, which of them are template, and streams bound before."""

    def __init__(self, text: str, fixed: Iterable[int], pages: int):
        self.places = [(_tuple(t), n) for t, n in json.loads(text)]
        self.fixed = set(fixed)
        self.template = [n >= CONSTANT_FROM and n >= CONSTANT_SHARE * pages for _, n in self.places]
        self.known: dict[tuple[str, ...], list[bool]] = {}

    def constant(self, found: list[tuple[str, str]]) -> list[bool]:
        """For each block whether it is bound to a place of the template and shows its fixed text."""
        tokens = tuple(stream(found, self.fixed))
        if (out := self.known.get(tokens)) is None:
            if len(self.known) > 2_000:
                self.known.clear()
            places = bound(self.places, list(tokens))
            out = self.known[tokens] = [p >= 0 and self.template[p] and FIXED in t for t, p in zip(tokens, places, strict=True)]
        return out


def _within(kept: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """The blocks (path, text, constant), of which constant ones are none any more if the next others on both sides have the same parent."""
    parents = [path.rpartition("/")[0] for path, _, _ in kept]
    before: list[str | None] = []
    last = None
    for parent, (_, _, constant) in zip(parents, kept, strict=True):
        before.append(last)
        last = last if constant else parent
    out, last = [], None
    for parent, prior, (path, text, constant) in zip(parents[::-1], before[::-1], kept[::-1], strict=True):
        out.append((path, text, constant and not prior == parent == last))
        last = last if constant else parent
    return out[::-1]


def _holds_article(path: str, text: str) -> bool:
    """Whether a block tells of an article around it: by an article or main element, a headline, or a paragraph of some length."""
    steps = [step.partition(".")[0] for step in path.split("/")]
    return not {"article", "main", "h1"}.isdisjoint(steps) or steps[-1] == "p" and len(text) >= PARAGRAPH


def article(found: list[tuple[str, str]], wrapper: Wrapper | None) -> str:
    """Main text of a page's blocks: those in no container apart that are no template, and of these the ones in article and main elements if there are any.

    The wrapper is bound before anything else, and what it knows as template goes from articles too. A page
    that has only template keeps it. Where all that tells of an article stands in containers apart, the largest of these is
    overruled, as a form or a layout may hold the whole page, until something is left; menus are never.
    """
    constant = wrapper.constant(found) if wrapper else [False] * len(found)
    overruled: frozenset[str] = frozenset()
    while True:
        where = [apart(path, overruled) for path, _ in found]
        kept = [(path, text, c) for (path, text), c, out in zip(found, constant, where, strict=True) if not out]
        content = [s for s in _within(kept) if not s[2]] or kept
        if own := [s for s in content if _inner(s[0])] or content:
            return "\n".join(text for _, text, _ in own)
        held: dict[str, int] = {}
        for (path, text), out in zip(found, where, strict=True):
            if _holds_article(path, text) and out.rpartition("/")[2].partition(".")[0] not in ("nav", "menu"):
                held[out] = held.get(out, 0) + len(text)
        if not held:
            return ""
        overruled |= {max(held, key=held.get)}


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text) of every page: the article's blocks, joined by newlines.

    Null and empty pages have an empty text. Null URLs share one nameless host. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    wrappers = cut(infer(pages, key=key, url=url, page=page))
    size = F.octet_length("wrapper") + 8 * F.size("fixed") + F.octet_length("host") + 64
    joined = _meet(_keyed(pages, key, url, page), wrappers, size).select("key", "url", "html", "host", "wrapper", "fixed", "pages")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for frame in frames:
            texts = []
            for where, body, text, fixed, n in zip(frame.host, frame.html, frame.wrapper, frame.fixed, frame.pages, strict=True):
                found = slots(body)
                if text is not None and where not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[where] = Wrapper(text, fixed, n)
                texts.append(article(found, known[where] if text is not None else None))
            yield pd.DataFrame({"key": frame.key, "url": frame.url, "text": texts})

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInPandas(extract, f"key {kind}, url string, text string").withColumnRenamed("key", key)
