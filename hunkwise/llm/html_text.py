"""Operator 9, main text of web pages by a site style tree.

The DOMs of all pages of a host are merged by element path (tag with class and id). Two
kinds of nodes get an importance between 0 and 1 from entropies over the host's pages, to the
base of their number:

* a presentation node, a path, has the entropy of how pages show it (the child sequences of
  its elements there), and, as content, one less the mean entropy of the text blocks below it;
* a content node, a block of text under a path, has one less the entropy of its pages.

So what differs from page to page has 1, what is the same everywhere 0. Nodes on fewer than
``support`` pages of a host take the importance of their path over all hosts; where that isn't
known either they have 1. A branch goes if its score is not positive: 1 point for or against by
its presentation, 3 by its content, and a prior from markup of 2 for the inside of ``article`` or
``main``, -2 for what stands beside one that has an ``h1`` or half of the page's text, and -1 for a class, id or
role such as ``ad``. So markup alone removes nothing but elements that never are main text (``nav``,
``footer``, ``form``, hidden ones, reader comments; see ``_NOISE``), and entropy alone can. Within
``article`` or ``main`` only content nodes are judged, those on at least half of the host's pages.

Pages count as one if they have the same heading in their main part, or without one the same
blocks: copies of an article aren't boilerplate.

Counts are summed per task and aggregated before they are shuffled. What remains per host is a list of
nodes and blocks on at least a hundredth of its pages, hence of bounded size; it is
joined to the pages. Spark broadcasts that table only if its size allows, and else splits a frequent host.

Null and empty html give an empty text. A null or malformed url counts as host ``-``. Repeated pages
(null ids too) get the same result. Very long pages are handled whole; elements below ``DEPTH`` levels count
as their ancestor there. Equal importances need no order. Empty tables give no rows. Extra columns are
ignored. Markup that ends early counts as closed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch, lean

# Elements of HTML by what they do.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg object select".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture audio video canvas map meter output progress "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom semantics".split()
)
_NOISE = frozenset("nav footer aside form button menu dialog fieldset head".split())
_MAIN = frozenset("article main".split())
#: Elements that end an open paragraph, and elements that end an open one of their own kind.
_ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol table dl menu select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that speak against main text, and those of what readers wrote.
_NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets related recommended recommendations "
    "footer foot masthead topbar header reply replies discussion share sharing social follow newsletter subscribe subscription signup login search "
    "skip toolbar complementary contentinfo form hidden".split()
)
_READERS = frozenset("comment comments disqus respond".split())
#: Points of a score: see above.
MAIN, BESIDE, NAMED, STYLE, CONTENT = 2.0, -2.0, -1.0, 1.0, 3.0
#: Levels of the tree.
DEPTH = 24

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/]|\Z)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[a-z]+")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


#: The root of every tree.
ROOT = _hash("")


class Page:
    """A parsed page: blocks of text, and how each node of the tree is shown on it.

    A block is (text, node, nodes above it and itself below ``body``, noise, main, named,
    heading). ``styles`` has the child sequences of each node's elements.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, tuple[int, ...], bool, bool, bool, str]] = []
        self.styles: dict[int, list[str]] = {}
        self.main_nodes: set[int] = set()
        self.noise_nodes: set[int] = set()
        # Open elements: tag, noise, main, children, node, chain, named.
        self.stack: list[tuple[str, int, bool, list[str], int, tuple[int, ...], bool]] = []
        self.muted: list[str] = []  # open inline elements whose text is dropped
        self.text: list[str] = []
        self._parse(source)
        self._flush()
        while self.stack:
            self._pop()

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.text)).split())
        self.text.clear()
        if text:
            first = next((i for i, s in enumerate(self.stack) if s[2]), None)
            # A class on a wrapper around the article, such as its layout, doesn't make the article noise.
            noise = any(s[1] > (i < (first or 0)) for i, s in enumerate(self.stack))
            tag, _, _, _, node, chain, named = self.stack[-1] if self.stack else ("", 0, False, [], ROOT, (), False)
            self.blocks.append((text, node, chain, noise, first is not None, named, tag if tag in _HEADINGS else ""))

    def _pop(self) -> None:
        _, _, _, children, node, _, _ = self.stack.pop()
        self.styles.setdefault(node, []).append(" ".join(children))

    def _close(self, tag: str, scope: frozenset = frozenset()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._flush()
                self.muted.clear()
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in scope:
                return

    def _open(self, tag: str, attrs: str) -> None:
        marks = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _ATTR.findall(attrs)] if attrs else []
        words = [w for _, v in marks for w in _WORD.findall(v)]
        inside = bool(self.stack) and any(s[2] for s in self.stack)
        wraps = tag in ("html", "body")
        # 2: the element itself is none of the main text, 1: its class says that readers wrote it.
        noise = 2 if tag in _NOISE or (tag == "header" and not inside) or bool(attrs and _HIDDEN.search(attrs)) else int(not wraps and any(w in _READERS for w in words))
        if tag in _INLINE:
            if tag == "br":
                self.text.append(" ")
            elif noise and tag not in _VOID:
                self.muted.append(tag)
            return
        self._flush()
        if tag in _ENDS_P:
            self._close("p", _SCOPE)
        for own in _ENDS_OWN.get(tag, ()):
            self._close(own, _SCOPE)
        name = ".".join([tag, *dict.fromkeys(words)][:4])
        node, chain, named = self.stack[-1][4:] if self.stack else (ROOT, (), False)
        if self.stack:
            self.stack[-1][3].append(name)
        if tag in _VOID:
            return
        level = len(self.stack)
        main = not noise and (tag in _MAIN or ("role", "main") in marks)
        if level < DEPTH:
            node = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), node % (1 << 64)) - (1 << 63)
            chain = chain if wraps else (*chain, node)
        if inside or main:
            self.main_nodes.add(node)
        if noise or (self.stack and self.stack[-1][4] in self.noise_nodes):
            self.noise_nodes.add(node)
        named = named or not (inside or main or wraps) and any(w in _NOISE_WORDS for w in words)
        self.stack.append((tag, noise, main, [], node, chain, named))

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not self.muted:
                self.text.append(source[at : m.start() if m else n])
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in _INLINE:
                    if tag in self.muted:
                        del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag) :]
                else:
                    self._flush()
                    self._close(tag)
            elif tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            elif self.muted and tag in _INLINE:
                if tag not in _VOID:
                    self.muted.append(tag)
            else:
                self._open(tag, m[3] or m[6] or "")

    def key(self) -> int:
        """What pages with the same article have in common: its heading, or else all their blocks."""
        known = [b for b in self.blocks if not b[3]]
        heading = next((b[0] for b in known if b[4] and b[6]), None)
        return _hash(heading or "\n".join(b[0] for b in known))

    def features(self) -> Iterator[tuple[int, bool, int, int]]:
        """``node, main, kind, feature``: how the page shows a node (kind 0), blocks below it (kind 1)."""
        for node, shown in self.styles.items():
            if node not in self.noise_nodes:
                yield node, node in self.main_nodes, 0, _hash("\n".join(shown))
        for text, node, chain, noise, main, _, _ in self.blocks:
            if not noise:
                # Within the main part only blocks are judged, elsewhere all branches.
                for above in (node,) if main else chain:
                    if above not in self.main_nodes or main:
                        yield above, main, 1, _hash(text)

    def text_by(self, nodes: dict[int, tuple[float, float]], blocks: dict[tuple[int, int], tuple[float, float]]) -> str:
        """The blocks whose branches have a positive score, by the importances (style, content) known."""
        known = [b for b in self.blocks if not b[3]]
        inner = [b for b in known if b[4]]
        holds = any(b[6] == "h1" for b in inner) or inner and 2 * sum(len(b[0]) for b in inner) >= sum(len(b[0]) for b in known)
        beside = BESIDE if holds else 0.0
        points = lambda x: STYLE * (2 * x[0] - 1) + CONTENT * (2 * x[1] - 1)
        kept = []
        for text, node, chain, _, main, named, _ in known:
            own = blocks.get((node, _hash(text))) if blocks else None
            found = [own] if own else []
            if not main:
                found += [nodes[i] for i in chain if i in nodes]
            prior = MAIN if main else beside + NAMED * named
            if prior + min(map(points, found), default=STYLE + CONTENT) > 0:
                kept.append(text)
        return "\n".join(kept)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else "-"


_HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)")


def _style_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of pages as rows ``host, node, main, kind, feature, page``; kind 2 counts the host's pages."""
    kinds = {"host": pa.string(), "node": pa.int64(), "main": pa.bool_(), "kind": pa.int32(), "feature": pa.int64(), "page": pa.int64()}
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            some, seen = batch.slice(lo, 1000), set()
            for url, source in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                host, page = host_of(url), Page(source.as_py() or "")
                key = page.key()
                seen.update((host, *f, key) for f in page.features())
                seen.add((host, 0, False, 2, 0, key))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """``pages, style, content`` of each node, from the pages ``n`` of each feature."""
    n, m = F.col("n"), F.col("m")
    per = counts.groupBy(*by, "kind").agg(F.sum("n").alias("m"), F.sum(n * F.log("n")).alias("s"))
    shown = F.max(F.when(F.col("kind") == 0, m))
    # Kind 0: log m - s / m is the entropy of the styles. Kind 1: s / m is the mean log of a block's pages.
    style = F.max(F.when((F.col("kind") == 0) & (m > 1), (F.log("m") - F.col("s") / m) / F.log("m")))
    shared = F.max(F.when(F.col("kind") == 1, F.col("s") / m))
    out = per.groupBy(*by).agg(shown.alias("pages"), style.alias("style"), shared.alias("shared"))
    content = F.greatest(F.lit(0.0), 1 - F.col("shared") / F.log("pages"))
    return out.where("pages > 1 and shared is not null").select(*by, "pages", F.coalesce("style", F.lit(1.0)).alias("style"), content.alias("content"))


def style_tree(pages: DataFrame, scratch: Scratch, support: int = 8, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The importances of the hosts' nodes, of their blocks, and of nodes over all hosts.

    ``host, node, main, pages, style, content``; ``host, node, feature, style, content``; ``node, pages, style, content``.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(lean(_style_task), "host string, node long, main boolean, kind int, feature long, page long").distinct()
    counts = scratch.put(found.groupBy("host", "node", "main", "kind", "feature").agg(F.count("*").alias("n")), "counts")
    size = counts.where("kind = 2").select("host", F.col("n").alias("size"))
    many = lambda col, of: F.col(col) >= F.greatest(F.lit(support), F.col(of) / 100)
    nodes = _importance(counts.where("kind < 2"), ["host", "node", "main"])
    nodes = scratch.put(nodes.join(size, "host").where(many("pages", "size")).drop("size"), "nodes")
    often = counts.where((F.col("kind") == 1) & (F.col("n") >= support))
    blocks = often.join(nodes, ["host", "node", "main"]).where("n >= pages / 2")
    blocks = blocks.select("host", "node", "feature", "style", (1 - F.log("n") / F.log("pages")).alias("content"))
    total = size.agg(F.sum("size")).head()[0] or 0
    outer = counts.where("kind < 2 and not main").groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"))
    over = _importance(outer, ["node"]).where(F.col("pages") >= max(support, total / 100))
    return nodes, blocks, over


def extract(pages: DataFrame, support: int = 8, tree: bool = True, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; without ``tree`` every node has importance 1."""
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    general: dict[int, tuple[float, float]] = {}
    if tree:
        scratch = Scratch(pages.sparkSession, "style")
        nodes, blocks, over = style_tree(pages, scratch, support, url_col, html_col)
        general = {r[0]: (r[1], r[2]) for r in over.select("node", "style", "content").collect()}  # a hundred times a page's nodes at most
        mine = nodes.where("not main").groupBy("host").agg(F.collect_list(F.struct("node", "style", "content")).alias("nodes"))
        listed = mine.join(blocks.groupBy("host").agg(F.collect_list(F.struct("node", "feature", "style", "content")).alias("blocks")), "host", "full")
        listed = scratch.put(listed, "listed")
        host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
        rows = rows.withColumn("host", F.coalesce(F.when(host != "", host), F.lit("-"))).join(listed, "host", "left").select("page_id", "url", "html", "nodes", "blocks")
    else:
        rows = rows.select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("nodes"), F.lit(None).cast("array<int>").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            last, known = None, (general, {})
            for source, nodes, blocks in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                now = (nodes, blocks)
                if last is None or now != last:
                    own = {x["node"]: (x["style"], x["content"]) for x in nodes.as_py() or ()}
                    last, known = now, (general | own, {(x["node"], x["feature"]): (x["style"], x["content"]) for x in blocks.as_py() or ()})
                texts.append(Page(source.as_py() or "").text_by(*known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
