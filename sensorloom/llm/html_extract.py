"""Main text of HTML pages by site style trees.

The pages of a host are merged into a style tree: a node is a path of styles (tag and class) from the root.
For each node the tree counts, over the ``m`` pages that have it,

* its *presentations*, the sequences of child styles: their entropy, to base ``m``, is the node's
  presentation importance;
* its *contents*, the texts of the whole branch: content importance is 1 less the mean, over occurrences, of
  the entropy of a content over the pages, log_m(pages that have it). Text that stands on all pages counts 0,
  text of one page counts 1.

With ``l`` presentations the composite importance is ``(1 - g**l) * presentation + g**l * content`` and
branches below a threshold are removed from each page, inside articles and main parts too. There an article or
main part that repeats as a whole stays whole, words in the run of a sentence stay in it, and a heading that recurs
stays if text that is kept follows under its parent. A page's article (or main part, or else body) is then
read off, without what its markup itself declares to be a menu, header, footer, sidebar, notice, advert,
form, script, style or reader comment; no page is needed to be like others for that.

Trees are counts by (host, node, feature), combined before they are shuffled; a page is parsed twice and
never moved unless the table of removed branches has outgrown a broadcast.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist, small_batches, with_small

#: Pages a node must be on to be judged; importance below which it goes; the paper's attenuation g.
LEAST_PAGES, THRESHOLD, ATTENUATION = 8, 0.2, 0.9

# Tags by their part in a page, and words of class, id and role that name such parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
#: Of these, those that nest, and that a slash closes in their own start tag.
NESTING = frozenset("template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset(
    "head script style textarea title noscript iframe noembed noframes template svg math nav footer aside form button select "
    "option datalist input menu dialog canvas object embed audio video map".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promoted promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead topbar comment comments disqus reply "
    "replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations pagination pager copyright toolbar skip".split()
)
#: Words that say where and as what a part is laid out. Inside of an article a name counts if all its words are of
#: these or of NOISE_WORDS, and one is of the latter: related-posts and share-bar, but not related-work.
LAYOUT_WORDS = frozenset(
    "area article articles bar bars block blocks body bottom box boxes btn button buttons card cards center col column container content "
    "desktop element entry fixed floating form grid group header heading holder icon icons inline inner item items large layout left link "
    "links list main media mobile module more news outer page pages panel placeholder post posts primary region right row rows secondary "
    "section site slot small sticky stories story text title tool tools top unit view wrap wrapper zone".split()
)
#: What a text of an article stands in: names do not count there.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table b i em strong mark code".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: First and last words of compound class names that say how a part is laid out, not what it is: has-sidebar, share-enabled.
STATE_FIRST = frozenset("no not non has have with without".split())
STATE_LAST = frozenset("enabled disabled target active inactive".split())
#: An article among reader comments is a comment.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
LOW, NAMED, DECLARED = 1, 2, 3  # why a branch is left out: its importance, a word of its class or id, or its markup
HEADER_WORDS = frozenset({"header", "head", "siteheader"})  # noise outside of an article
KEPT_TAGS = frozenset({"html", "body", "article", "main"})
#: Blocks that hold other blocks: an inline branch between these is a part of the page, elsewhere of a sentence.
HOLDERS = frozenset("html body article main section div header hgroup details fieldset center address dir dl ol ul table tbody thead tfoot tr".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("html body article main section div table td th ul ol dl form nav aside header footer figure blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^<>]*)>?",
    re.S,
)
#: Tags of these elements, in the letters of the source itself: lower-casing could move places.
_END_OF = {tag: re.compile(rf"<(/?){tag}(?![^\s/>])[^>]*(?:>|\Z)", re.I | re.A) for tag in RAW}
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?![\w-])", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}


def _declared_noise(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return DECLARED
    if not attrs or tag in KEPT_TAGS:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return DECLARED
    if attrs.get("role", "").lower() in NOISE_ROLES:
        return DECLARED
    if in_article and tag in TEXT_TAGS:
        return 0
    names: list[set[str]] = []
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if len(parts) < 2 or not (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            names.append(set(parts))
    if in_article:
        names = [n for n in names if n <= NOISE_WORDS | LAYOUT_WORDS]
    words = set().union(*names)
    if words & COMMENT_WORDS:
        return DECLARED
    return NAMED if words & NOISE_WORDS or (not in_article and words & HEADER_WORDS) else 0


#: What a worker remembers of start tags, (tag, attributes as written, inside an article) and of node paths.
_KNOWN: dict = {}
_MOST_KNOWN = 100_000


def _known(tag: str, raw: str, inside: bool) -> tuple[str, int, bool]:
    """Style, whether and how it is declared noise, and whether it is a main part."""
    key = (tag, raw, inside)
    if (found := _KNOWN.get(key)) is None:
        if len(_KNOWN) > _MOST_KNOWN:
            _KNOWN.clear()
        attrs = _attributes(raw)
        style = tag + "." + re.sub(r"[0-9]+", "0", " ".join(sorted(attrs.get("class", "").split()))) if attrs else tag
        found = _KNOWN[key] = (style, _declared_noise(tag, attrs, inside), tag == "main" or attrs.get("role") == "main")
    return found


def _path(up: int, style: str) -> int:
    key = (up, style)
    if (found := _KNOWN.get(key)) is None:
        import xxhash

        if len(_KNOWN) > _MOST_KNOWN:
            _KNOWN.clear()
        found = _KNOWN[key] = xxhash.xxh3_64_intdigest(f"{up}/{style}")
    return found


class _Node:
    __slots__ = ("tag", "style", "path", "skip", "place", "whole", "heading", "children", "content")

    def __init__(self, tag, style, path, skip, place, whole, heading=False):
        self.tag, self.style, self.path, self.skip, self.place, self.whole, self.heading = tag, style, path, skip, place, whole, heading
        self.children, self.content = [], []


class Page:
    """One pass over a page: its nodes for the style tree, and its text with some branches left out."""

    def __init__(self, source: str, removed: Collection[int] = (), tree: bool = False, inside: bool = True, names: bool = True) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.removed, self.tree, self.inside, self.names = removed, tree, inside, names
        self.pruned: set[int] = set()  # places that lost a branch inside of articles and main parts
        self.named: set[int] = set()  # places that lost one for its name
        self.held: tuple[int, int, str] | None = None  # a heading that stands only if its text does: depth, place, words
        self.open: dict[str, int] = {}  # open elements by tag
        self.nodes: set[tuple[int, int, int]] = set()  # path, kind (0: presentation, 1: content), feature
        # of the body; of main and of articles in branches that a class or id names noise; of main, of articles
        self.blocks: tuple[list, list, list, list, list] = ([], [], [], [], [])
        self.buffer: list[str] = []
        self.stack = [_Node("", "", 0, 0, 0, False)]
        self._read(source)

    def text(self) -> str:
        body, *named = (" ".join(b) for b in self.blocks[:3])
        main, article = (" ".join(b) for b in self.blocks[3:])
        # what such a branch holds may be the page's article or a teaser beside it: the longer text is the page's
        return article or main or max(body, next((t for t in named[::-1] if t), ""), key=len)

    def _break(self) -> None:
        if self.buffer:
            words = " ".join("".join(self.buffer).split())
            self.buffer = []
            top = self.stack[-1]
            if words and top.heading:
                self.held = len(self.stack) - 1, top.place, words
            elif words:
                if self.held:
                    self.blocks[self.held[1]].append(self.held[2])
                    self.held = None
                self.blocks[top.place].append(words)

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if self.tree and raw.strip():
            top.content.append(raw)
        if not top.skip:
            self.buffer.append(html.unescape(raw) if "&" in raw else raw)

    def _open(self, tag: str, raw: str) -> None:
        block = tag in BLOCK
        if block:
            if tag != "br":
                if tag not in ("option", "td", "th", "tr", "tbody", "thead", "tfoot"):
                    self._end_implied({"p"})
                if tag in _ENDED_BY:
                    self._end_implied(_ENDED_BY[tag])
            self._break()
        up = self.stack[-1]
        style, noise, main = _known(tag, raw, up.place > 0)
        if self.tree:
            up.children.append(style)
        if tag in VOID:
            return
        path = _path(up.path, style) if self.tree or self.removed else 0
        place, low, heading = up.place, path in self.removed, up.heading
        if noise == NAMED and place:
            self.named.add(place)
            noise = noise if self.names else 0
        skip = max(up.skip, noise)
        own = tag == "article" or main
        if own and skip < DECLARED and not (skip == LOW and place in (2, 4)):  # the wrappers of an article do not take it along
            kind = 2 if tag == "article" else 1
            first = 0 if skip == NAMED or 0 < place < 3 else 2
            place, skip = first + kind if first == 0 else max(first + kind, place), 0
        elif low and not skip and not own and tag not in KEPT_TAGS and (not place or self._prunable(block, up)):
            if place and tag in HEADINGS:
                heading = True
            else:
                skip = LOW
                if self.held and self.held[0] >= len(self.stack):
                    self.held = None  # what the heading stood over is gone
                if place:
                    self.pruned.add(place)
        self.stack.append(_Node(tag, style, path, skip, place, up.whole or (own and low), heading))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _prunable(self, block: bool, up: _Node) -> bool:
        """Whether a branch of low importance inside of an article or main part goes."""
        if not self.inside or up.whole:
            return False
        return block or (up.tag in HOLDERS and not "".join(self.buffer).strip())

    def _close(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCK:
            self._break()
        self.stack.pop()
        self.open[node.tag] -= 1
        if self.held and self.held[0] > len(self.stack):
            self.held = None
        if self.tree:
            kinds = [c for i, c in enumerate(node.children) if not i or c != node.children[i - 1]]
            self.nodes.add((node.path, 0, self.hash(" ".join(kinds))))
            text = "\n".join(node.content)
            if text:
                content = self.hash(text)
                self.nodes.add((node.path, 1, content))
                self.stack[-1].content.append(str(content))

    def _end_implied(self, tags: set[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self._close()
                return
            if tag in _SCOPES and not (tag in ("td", "th") and "td" in tags):
                return

    def _end(self, tag: str) -> None:
        if not self.open.get(tag):
            if tag in ("br", "p"):
                self._break()
            return
        inline = tag not in BLOCK
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._close()
                return
            if (inline or tag == "p") and self.stack[i].tag in _SCOPES:
                return  # misnested: an inline end tag does not end the blocks it stands in

    def _skip(self, source: str, tag: str, at: int) -> int:
        """Where an element whose content is no text ends: at its end tag, or with the page."""
        depth = 1
        for m in _END_OF[tag].finditer(source, at):
            if m[1]:
                depth -= 1
            elif tag in NESTING and not m[0].endswith("/>"):
                depth += 1
            if not depth:
                return m.end()
        return len(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            cut = source.find("<", at)
            if cut < 0:
                self._text(source[at:])
                break
            if cut > at:
                self._text(source[at:cut])
            m = _TOKEN.match(source, cut)
            if m is None:
                self._text("<")
                at = cut + 1
                continue
            at = m.end()
            if m["end"]:
                self._end(m["end"].lower())
                continue
            tag = (m["start"] or m["loose"] or "").lower()
            if not tag:
                continue
            raw = m["attrs"] if m["start"] else m["rest"]
            if tag in RAW:  # what they hold is no text of the page
                if tag not in NESTING or not raw.endswith("/"):
                    at = self._skip(source, tag, at)
                continue
            self._open(tag, raw)
        while len(self.stack) > 1:
            self._close()
        self._break()


def main_text(source: str | None, removed: Collection[int] = ()) -> str:
    """The main text of one page, without the nodes of its site's style tree given as ``removed``."""
    page = Page(source or "", removed)
    if any(not page.blocks[p] for p in page.named):  # names have left nothing of the article: they name the article
        again = Page(source or "", removed, names=False)
        page = again if any(again.blocks[p] for p in page.named if not page.blocks[p]) else page
    if any(not page.blocks[p] for p in page.pruned):  # nothing is left of the article: it is a copy of others
        page = Page(source or "", removed, inside=False, names=page.names)
    return page.text()


def _host(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def unimportant(pages: DataFrame) -> DataFrame:
    """``(host, removed)``: per host the nodes of its style tree of low importance. ``pages(host, html)``."""
    import pyarrow as pa

    small_batches(pages.sparkSession)

    def nodes(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, kind, feature in Page(source, tree=True).nodes:
                    for c, v in zip(out, (host, path - (1 << 63), kind, feature - (1 << 63))):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "path", "kind", "feature"])

    found = pages.filter("host is not null and html is not null").mapInArrow(nodes, "host string, path long, kind int, feature long")
    features = found.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    n, shown, said = F.col("n"), F.col("kind") == 0, F.col("kind") == 1
    sums = features.groupBy("host", "path").agg(
        F.sum(F.when(shown, n)).alias("m"), F.count_if(shown).alias("l"), F.sum(F.when(shown, n * F.log(n))).alias("a"),
        F.sum(F.when(said, n)).alias("c"), F.sum(F.when(said, n * F.log(n))).alias("b"),
    )
    # a node that a page holds several times may show more than once on it: m is then an upper bound
    base = F.log("m")
    presentation = (base - F.col("a") / F.col("m")) / base
    content = 1 - F.col("b") / F.col("c") / base
    weight = F.pow(F.lit(ATTENUATION), F.when(F.col("l") > 1, F.col("l")).otherwise(0))
    judged = sums.filter((F.col("m") >= LEAST_PAGES) & (F.col("c") > 0))
    low = judged.filter((1 - weight) * presentation + weight * content < THRESHOLD)
    return low.groupBy("host").agg(F.collect_list("path").alias("removed"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: the id, the url, ``text`` and ``n_chars`` (code points).

    Null or empty html gives the empty text. Pages without a host are read without a style tree. Null and
    repeated ids are rows like others. An empty table gives an empty result.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    trees = persist(unimportant(pages.select("host", "html")), "style-trees")

    def read(batches):
        for batch in batches:
            texts = []
            for source, removed in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist()):
                texts.append(main_text(source, frozenset(p + (1 << 63) for p in removed or ())))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), sizes], [id_col, url_col, "text", "n_chars"])

    placed = with_small(pages, trees, "host", "left", weight=1 + F.size("removed"))
    return placed.select("id", "url", "html", "removed").mapInArrow(read, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
