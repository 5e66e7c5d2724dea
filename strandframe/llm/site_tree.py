"""Main text of web pages by site style trees.

The pages of a host are merged into one tree.  An element node is a path of tags
and classes (equal neighbours pooled); under it hang its presentation styles, the
sequences of child elements that pages have there, and the contents that its text
blocks have.  With m pages at a node, presentation importance is the entropy of the
styles to base m, and content importance is one minus the mean entropy of the
contents (a content of n pages has log_m n).  The importance of a branch mixes both:
``(1 - GAMMA^styles)`` of its own presentation, the rest from its children, weighted
by their pages, and from its own text.  A branch is noise if neither it nor anything
below it reaches ``LEAST``; nodes of fewer than ``LEAST_PAGES`` pages aren't judged.

Tasks parse pages and count (host, node, style or content) before the shuffle;
entropies are aggregates of these counts.  Inner nodes reach their ancestors by a
list of at most ``DEEP`` names, so no tree is walked and no host is gathered.  Pages
learn the noisy nodes of their host by a join: those of all hosts go to every task if
there are no more than ``SENT`` of them, else Spark shuffles and splits by host.

In each page noisy branches fall, unless they hold the page's main element
(``article`` or ``main``), and so do branches that say what they are: navigation,
headers and footers outside the article, asides, forms, scripts, hidden parts, and
classes, ids or roles of menus, notices, adverts and reader comments.  Inside a main
element statistics may only remove boxes and lists, not paragraphs or headings, and
nothing if the element as a whole is alike on all pages.  If statistics leave
nothing of a page, only the rules decide.  Of the remaining text that of the
outermost ``article`` elements is taken, else ``main``, else all.

Defined results: null or empty html has empty text; pages without a host are judged
by rules alone; repeated pages count each; markup may be broken or open; white space
is Unicode white space; ``br`` is white space; an empty table has no rows.
"""

from __future__ import annotations

import html as H
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandframe.llm.batches import packed, schema
from strandframe.session import cut_lineage

GAMMA = 0.9
LEAST = 0.4
LEAST_PAGES = 5
#: Elements deeper than this belong to the branch above them.
DEEP = 60
#: Distinct counts that a task holds before it hands them on.
HELD = 300_000
#: Noisy nodes and hosts that are sent to all tasks at most (about 30 bytes each).
SENT = 300_000

# Elements of HTML by behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = set("iframe noembed noframes noscript script style template textarea title svg object audio video canvas".split())
DROP = RAW | set("head nav footer aside form button select input label datalist dialog menu option optgroup fieldset search applet".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption body html".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
# Words of classes and ids that name something other than the article.
NOISE = set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners promo promos promotion sponsor sponsored sponsors "
            "menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs pagination pager toc footer foot sidebar sidebars aside rail widget widgets "
            "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
            "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
            "search searchbox form copyright legal masthead skip hidden".split())
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
DIGITS = re.compile(r"\d+")
#: Words of a class that make it speak of something else, as in "with-sidebar"; words that an article's own class goes by.
SPEAKS = set("has with without no".split())
COMMENT = set("comment comments commentlist reply replies respond".split())
#: What keeps an opening tag from ending an open paragraph, or a peer, further out.
KEEPS = set("div section article main td th li dd blockquote button aside header footer nav form".split())
SELF = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tfoot")}


class Page:
    """Block elements of a page in order, with texts: ``up``, ``tag``, ``label``, ``rule`` per element and ``blocks`` of (element, text, linked characters, links)."""

    __slots__ = ("up", "tag", "label", "rule", "images", "blocks")

    def __init__(self, source: str):
        self.up, self.tag, self.label, self.rule = [-1], [""], [""], [False]
        self.images: list[tuple[int, str]] = []
        self.blocks: list[tuple[int, str, int, int]] = []
        open_: list[tuple[str, int]] = []  # (tag, element that holds it)
        parts: list[str] = []
        here, linked, links, at, end = 0, 0, 0, 0, len(source)

        def flush() -> None:
            nonlocal linked, links
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((here, text, linked, links))
                linked = links = 0

        def holder() -> int:
            return open_[-1][1] if open_ else 0

        while at < end:
            m = MARK.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                text = H.unescape(source[at:stop])
                parts.append(text)
                if any(t == "a" for t, _ in open_):
                    linked, links = linked + len(text.strip()), links + (not text.isspace())
            if not m:
                break
            at = m.end()
            if m[1]:
                name = m[1].lower()
                to = None
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        to = k
                        break
                    if name not in BLOCK and open_[k][0] in BLOCK:
                        break  # an inline end tag stays inside its block
                around = here if to is None else open_[to - 1][1] if to else 0
                if name in BLOCK or around != here:
                    flush()
                if to is not None:
                    del open_[to:]
                here = around
                continue
            if not m[2]:
                continue
            name = m[2].lower()
            if name in BLOCK:
                flush()
                if name not in ("option", "optgroup"):
                    self._close(open_, ("p",), KEEPS)
                if name in SELF:
                    self._close(open_, PEERS.get(name, (name,)), SELF[name].split())
                here = holder()
            elif name == "br":
                parts.append("\n")
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = found.end() if found else end
                continue
            if name == "img":
                if src := next((b or c or d for a, b, c, d in ATTRIBUTE.findall(m[3]) if a.lower() == "src"), ""):
                    self.images.append((here, src))
            if name in VOID:
                continue
            marks = self._marks(name, m[3])
            if name in BLOCK or marks[1] or name in DROP:
                if name not in BLOCK:
                    flush()  # an inline branch that goes is a block of its own
                self.up.append(holder())
                self.tag.append(name)
                self.label.append(name + marks[0])
                self.rule.append(marks[1] or name in DROP)
                here = len(self.up) - 1
            open_.append((name, here))
        flush()

    @staticmethod
    def _close(open_: list, names: tuple[str, ...], barriers: list[str] | set[str]) -> None:
        first = None
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in names:
                first = k
            elif open_[k][0] in barriers:
                break
        if first is not None:
            del open_[first:]

    @staticmethod
    def _marks(name: str, attributes: str) -> tuple[str, bool]:
        """Classes without digits for the label, and whether the element says that it isn't the article."""
        if not attributes or attributes.isspace():
            return "", False
        classes, noise = "", False
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                noise = True
            elif key == "role" and value.lower() in ROLES:
                noise = True
            elif key in ("class", "id"):
                if key == "class":
                    classes = "." + ".".join(sorted(DIGITS.sub("", value).split()))
                bad = () if name in ("html", "body", "main") else COMMENT if name == "article" else NOISE
                for word in value.split() if bad else ():
                    said = {w.lower() for w in WORDS.findall(word)}
                    if said & bad and not said & SPEAKS:
                        noise = True
        return classes, noise


def _under(page: Page, start: list[bool]) -> list[bool]:
    out = list(start)
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.up[i]]
    return out


def _main(page: Page) -> tuple[list[bool], list[bool]]:
    """Elements inside an article (else main) that stays, and those that hold one."""
    gone = _under(page, page.rule)
    for name in ("article", "main"):
        own = [t == name and not g for t, g in zip(page.tag, gone)]
        if any(own):
            holds = list(own)
            for i in range(len(own) - 1, 0, -1):
                if holds[i]:
                    holds[page.up[i]] = True
            return _under(page, own), holds
    return [False] * len(page.up), [False] * len(page.up)


def _menus(page: Page) -> list[bool]:
    """Lists and boxes whose text is links, three at least, for four fifths."""
    size, linked, many = [0] * len(page.up), [0] * len(page.up), [0] * len(page.up)
    for e, text, chars, links in page.blocks:
        size[e] += len(text)
        linked[e] += min(chars, len(text))
        many[e] += links
    for i in range(len(page.up) - 1, 0, -1):
        for x in (size, linked, many):
            x[page.up[i]] += x[i]
    return [t in ("ul", "ol", "div", "section", "table", "dl") and many[i] >= 3 and 5 * linked[i] >= 4 * size[i] for i, t in enumerate(page.tag)]


def paths(page: Page) -> list[int]:
    """Name of every element's node: a hash of the labels from the root, signed."""
    out = [0]
    level = [0]
    for i in range(1, len(page.up)):
        u = page.up[i]
        level.append(level[u] + 1)
        if level[i] > DEEP:
            out.append(out[u])
        else:
            h = xxhash.xxh64_intdigest(page.label[i], out[u] & (2**64 - 1))
            out.append(h - 2**64 if h >> 63 else h)
    return out


def text_of(source: str | None, noisy: set[int]) -> str:
    """Main text of one page, given the noisy nodes of its host."""
    if not source:
        return ""
    page = Page(source)
    inside, holds = _main(page)
    has_main = any(inside)
    menus = _menus(page)
    header = [t == "header" and not inside[i] for i, t in enumerate(page.tag)]
    rule = [r or h or (m and not inside[i] and not holds[i]) for i, (r, h, m) in enumerate(zip(page.rule, header, menus))]
    gone = _under(page, rule)
    wanted = inside if has_main else [True] * len(page.up)

    def joined(out: list[bool]) -> str:
        return "\n".join(t for e, t, _, _ in page.blocks if wanted[e] and not out[e])

    if noisy:
        names = paths(page)
        alike = _under(page, [holds[i] and inside[i] and names[i] in noisy for i in range(len(names))])
        low = [n in noisy and i > 0 and not holds[i] and not (inside[i] and (page.tag[i] in PLAIN or alike[i])) for i, n in enumerate(names)]
        if text := joined(_under(page, [a or b for a, b in zip(gone, low)])):
            return text
    return joined(gone)


# ---- the tree of each host -----------------------------------------------------------------------

COUNTED = "host string, node long, content boolean, what long, above array<long>, n long"
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)"


def host(url: str) -> Column:
    """Host of an address in lower case, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), HOST, 1))


def _signed(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - 2**64 if h >> 63 else h


def page_counts(source: str) -> tuple[dict[int, int], set[tuple[int, int]], dict[int, tuple[int, ...]]]:
    """Style of every node, contents of nodes, and nodes above each node, itself last."""
    page = Page(source)
    names = paths(page)
    kids: list[list[str]] = [[] for _ in names]
    above: dict[int, tuple[int, ...]] = {0: (0,)}
    for i in range(1, len(names)):
        kids[page.up[i]].append(page.label[i])
        if names[i] not in above:
            above[names[i]] = (*above[names[page.up[i]]], names[i])
    styles: dict[int, set[str]] = {}
    for n, k in zip(names, kids):
        styles.setdefault(n, set()).add("\n".join(x for x, _ in groupby(k)))
    contents = {(names[e], _signed(t)) for e, t, _, _ in page.blocks} | {(names[e], _signed("img " + s)) for e, s in page.images}
    return {n: _signed("\r".join(sorted(s))) for n, s in styles.items()}, contents, above


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    way: dict[int, tuple[int, ...]] = {}

    def out() -> pa.RecordBatch:
        keys = list(count)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [k[3] for k in keys], [None if k[2] else way[k[1]] for k in keys], list(count.values())]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "node", "content", "what", "above", "n"])
        count.clear()
        way.clear()
        return b

    for b in batches:
        hosts, sources = b.column("host"), b.column("html")
        for i in range(b.num_rows):
            h, source = hosts[i].as_py(), sources[i].as_py()
            styles, contents, above = page_counts(source)
            way.update(above)
            count.update([(h, n, False, s) for n, s in styles.items()])
            count.update([(h, n, True, t) for n, t in contents])
            if len(count) > HELD:
                yield out()
    if count:
        yield out()


def importances(pages: DataFrame) -> DataFrame:
    """``(host, node, above, m, importance)`` of every node of every host's style tree, from rows ``(host, html)``."""
    counted = pages.filter("host <> '' AND html <> ''").mapInArrow(_counted, COUNTED).groupBy("host", "node", "content", "what").agg(F.sum("n").alias("n"), F.first("above", True).alias("above"))
    s = counted.groupBy("host", "node", "content").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.sum(F.log("n")).alias("logs"), F.sum(F.col("n") * F.log("n")).alias("nlogs"), F.first("above", True).alias("above"))
    own = F.col("content") == F.lit(False)
    tree = cut_lineage(s.groupBy("host", "node").agg(
        F.max(F.when(own, F.col("pages"))).alias("m"), F.max(F.when(own, F.col("kinds"))).alias("styles"), F.max(F.when(own, F.col("nlogs"))).alias("nlogs"),
        F.max(F.when(~own, F.col("kinds"))).alias("kinds"), F.max(F.when(~own, F.col("logs"))).alias("logs"), F.first("above", True).alias("above")))
    base = F.log("m")
    look = F.when(F.col("m") > 1, (base - F.col("nlogs") / F.col("m")) / base).otherwise(F.lit(1.0))
    read = F.when(F.col("m") > 1, 1 - F.col("logs") / (F.col("kinds") * base)).otherwise(F.lit(1.0))
    up = F.when(F.size("above") > 1, F.element_at("above", -2))
    tree = tree.select("host", "node", "above", "m", "styles", look.alias("look"), F.when(F.col("kinds") > 0, read).alias("read"), up.alias("up"))
    kids = tree.groupBy("host", F.col("up").alias("node")).agg(F.sum("m").alias("below")).filter("node IS NOT NULL")
    t = tree.join(kids, ["host", "node"], "left").fillna(0, ["below"])
    text = F.when(F.col("read").isNotNull(), F.col("m")).otherwise(0)
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    whole = F.greatest(F.col("below") + text, F.lit(1))
    # what a node adds by itself, and what it passes on of each page below it
    alone = F.when(F.col("below") == 0, F.coalesce("read", F.lit(0.0))).otherwise((1 - share) * F.col("look") + share * text * F.coalesce("read", F.lit(0.0)) / whole)
    t = cut_lineage(t.select("host", "node", "above", "m", alone.alias("alone"), (share / whole).alias("pass")))
    steps = t.select("host", "node", "m", "alone", F.posexplode("above").alias("k", "a"))
    met = steps.join(t.select("host", F.col("node").alias("a"), "pass", F.col("m").alias("ma")), ["host", "a"])
    chain = met.groupBy("host", "node").agg(F.first("alone").alias("alone"), F.array_sort(F.collect_list(F.struct("k", "a", "pass", "ma"))).alias("c"))  # DEEP entries at most
    # weight of a node in each of those above: the product of what is passed on, each by the pages of the node below it
    n = F.size("c")
    weigh = F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(
        F.element_at("c", j)["a"].alias("a"),
        F.aggregate(F.slice("c", j, n - j), F.lit(1.0), lambda x, e: x * e["pass"]).alias("w"),
        F.aggregate(F.slice("c", j + 1, n - j), F.lit(1.0), lambda x, e: x * e["ma"]).alias("p")))
    parts = chain.select("host", "alone", F.explode(weigh).alias("w")).groupBy("host", F.col("w.a").alias("node")).agg(F.sum(F.col("alone") * F.col("w.w") * F.col("w.p")).alias("importance"))
    return t.select("host", "node", "above", "m").join(parts, ["host", "node"])


def noisy_nodes(pages: DataFrame, least: float = LEAST, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, noisy)``: outermost nodes of each host under which nothing reaches ``least``."""
    tree = cut_lineage(importances(pages))
    best = tree.select("host", F.explode("above").alias("node"), "importance").groupBy("host", "node").agg(F.max("importance").alias("best"))
    low = tree.join(best, ["host", "node"]).filter((F.col("best") < least) & (F.col("m") >= least_pages)).select("host", "node", "above")
    top = low.select("host", F.element_at("above", -2).alias("node"), F.col("node").alias("x")).join(low.select("host", "node"), ["host", "node"], "left_anti")
    return top.groupBy("host").agg(F.collect_list("x").alias("noisy"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns of ``pages`` in ``_page`` and the main ``text``."""
    noisy = cut_lineage(noisy_nodes(pages.select(host(url).alias("host"), F.col(html).cast("string").alias("html")), least, least_pages))
    if (noisy.agg(F.sum(1 + F.size("noisy"))).first()[0] or 0) <= SENT:
        noisy = F.broadcast(noisy)
    source = pages.select(packed(pages, "_page"), host(url).alias("host"), F.col(html).cast("string").alias("_html"))
    met = source.join(noisy, "host", "left").select("_page", "_html", "noisy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, low = b.column("_html"), b.column("noisy")
            texts, known = [], {}
            for i in range(b.num_rows):
                names = tuple(low[i].as_py() or ())
                texts.append(text_of(sources[i].as_py(), known.setdefault(names, frozenset(names))))
            yield pa.RecordBatch.from_arrays([b.column("_page"), pa.array(texts, pa.string())], names=["_page", "text"])

    return met.mapInArrow(run, schema([T.StructField("_page", met.schema["_page"].dataType)], "text string"))
