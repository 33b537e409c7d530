"""Main text of web pages by site style trees.

The DOMs of one host are merged. A node of the tree is a place in the style of its parent: the parent's child sequence
(tag, classes, role), runs of like children other than sections taken together, and the run. Over the ``m`` pages that contain a node,

* presentation importance is the entropy, to the base m, of the child sequences that pages show there;
* content importance is 1 - the mean entropy over the texts below it: a text on d pages has entropy log_m(d), so a
  text on every page counts 0 and one that a single page has counts 1; it is lowered by the part of the text that is links;
* nodes with half of the text of their pages or more are the stem. A node beside the stem's next node has to differ in its
  presentation or hold much of the text: its importance is weighed with the larger of both. Inside the last node of the
  stem, which is the main text, the content decides alone. Headings are never weighed by their presentation.

A branch off the stem goes when its importance is low. A host with few pages that have a node borrows from the hosts of
its domain, then from all hosts. Markup that names itself (menus, footers, forms, adverts, comments, ...) has importance 0
by its tag or class, unless it holds the article or most of the page's text without being links. What a page marks as its
article is kept whole, and alone if it is the main element, longer than the other text, or the only one and has the title;
small articles beside a longer text are teasers and kept like it. Copies of a page body on one host count as one page.

Every page is parsed once; its blocks and nodes are stored below ``spark.checkpoint.dir``. The tree is built from
(host, node, text hash) counts that combine before the shuffle; pages never meet by host.

Defined cases: null and empty html give an empty text; unknown marked sections are comments; a page without a host is its own
site of host ''; elements nested deeper than ``DEEPEST`` share the node above them; equal rows get equal results; html is
read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, stored

#: Importance of a node beside the stem that always looks the same and holds next to no text.
PLAIN = 0.1
LOW = 0.3
#: Part of the pages' text from which a node belongs to the stem.
STEM = 0.5
#: Pages with a node from which a host or domain decides by itself, and from which all hosts together do.
LEAST_PAGES = 5
LEAST_PAGES_OF_ALL = 20
DEEPEST = 64
#: Rows of low-importance nodes up to which they are broadcast; beyond it pages join them by host.
BROADCAST_NODES = 100_000

#: Elements of HTML by the part they play (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head script style noscript template svg math iframe object select button textarea canvas audio video".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "tfoot", "thead", "tr", "caption", "legend", "summary"}
#: Words of a class, id or role that name what is not the article (fixed values).
NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside them in a name (``site-footer``); any other word makes it another name (``with-sidebar``).
BESIDE = frozenset(
    "area bar block bottom box center container content footer global header inner item left link links list main outer page primary right row "
    "secondary section site text top widget wrap wrapper".split())
#: Elements that have a place of their own in their parent's style, also beside like ones.
SECTIONS = frozenset("article aside body div footer form header main nav section".split())
#: Characters from which on a named element with over half of the page's text is taken for its main text.
MOST_FROM = 200
#: Elements within a line; a name switches them off without ending the line.
INLINE = frozenset("a abbr b cite em i label mark q s small span strong sub sup time u".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADINGS = TITLES | {"section"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "option": {"select"}}


#: Decimal character references with more digits than ``int`` may read.
LONG_REFERENCE = re.compile(r"&#([0-9]{20,});?")


def _short_reference(found: re.Match) -> str:
    digits = found[1].lstrip("0")
    return "\ufffd" if len(digits) > 7 else f"&#{digits or 0};"


def _is_named(token: str) -> bool:
    """Whether a class, id or role as a whole names what is not the article."""
    words = set(token.replace("_", "-").split("-")) - {""}
    return not NAMED.isdisjoint(words) and words <= NAMED | BESIDE


class _Open:
    """An element of the page and its place in the style of the element above."""

    __slots__ = ("tag", "up", "run", "runs", "off", "article", "link", "names", "node", "style", "depth")

    def __init__(self, tag: str, up: _Open | None, off: bool, article: bool, link: bool, names: tuple[int, ...] = ()):
        self.tag, self.up, self.off, self.article, self.link, self.names = tag, up, off, article, link, names
        self.runs: list[str] = []
        self.run = len(up.runs) if up else 0
        self.node = self.style = self.depth = None


class _Block(NamedTuple):
    element: _Open
    text: str
    links: int


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


class _Reader(HTMLParser):
    """Blocks of text with the elements that hold them; ``kept_blocks`` decides on those that a tag or a name sets aside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = [_Open("", None, False, False, False)]
        self.blocks: list[_Block] = []
        self.words: list[str] = []
        self.links = 0
        self.holder: _Open | None = None
        self.named = 0
        self.holders: set[int] = set()
        self.articles = 0
        self.titled = 0
        self.main = False

    def _end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text and self.holder:
            self.blocks.append(_Block(self.holder, text, min(self.links, len(text))))
        self.words, self.holder, self.links = [], None, 0

    def _close(self) -> None:
        gone = self.stack.pop()
        if gone.tag in BLOCK or gone.names != self.stack[-1].names:
            self._end_block()

    def _close_open(self, tags, stop) -> None:
        """Close the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                while len(self.stack) > at:
                    self._close()
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P:
            self._close_open({"p"}, {"table", "td", "th", "li", "blockquote", "div", "article", "section"} - {"p"})
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag], SCOPES[tag])
        if tag == "body":
            self._close_open({"head"}, ())
        if tag in BLOCK:
            self._end_block()
        parent = self.stack[-1]
        if tag in VOID:
            self.words.append(" ")
            return
        found = dict(attrs)
        classes = sorted(set((found.get("class") or "").lower().split()))
        role = (found.get("role") or "").lower()
        if tag not in INLINE:
            label = f"{tag}.{'.'.join(classes)}[{role}"
            if not parent.runs or parent.runs[-1] != label or tag in SECTIONS:
                parent.runs.append(label)
        marked = tag in ("article", "main") or role in ("main", "article")
        article = parent.article or marked or found.get("itemprop") == "articleBody"
        off = parent.off or tag in UNREAD or "hidden" in found or UNSEEN.search(found.get("style") or "") is not None
        names = parent.names
        if not off and marked:
            self.holders.update(names)
            self.main |= tag == "main" or role == "main"
        if not off and article and not names:
            self.articles += not parent.article
            self.titled += tag == "h1"
        if not off and tag not in ("html", "body", "main"):
            ident = (found.get("id") or "").lower()
            tokens = [*classes, role] if tag == "article" or parent.article and tag in HEADINGS else [*classes, *ident.split(), role]
            if tag in ASIDE or (tag == "header" and not parent.article) or any(map(_is_named, tokens)):
                if tag in INLINE:
                    off = True
                else:
                    self.named += 1
                    names = (*names, self.named)
        if names != parent.names:
            self._end_block()
        self.stack.append(_Open(tag, parent, off, article, parent.link or tag == "a", names))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.stack[-1].tag == tag:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag in BLOCK or tag in ("td", "th"):
            self._end_block() if tag in BLOCK else self.words.append(" ")
        self._close_open({tag}, SCOPES.get(tag, ()))

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.off:
            if not data.isspace() and self.words and top.tag in BLOCK:
                self._end_block()
            return
        if self.holder is None and not data.isspace():
            self.holder = top
        if top.link:
            self.links += len(" ".join(data.split()))
        self.words.append(data)

    def kept_blocks(self) -> list[_Block]:
        """Blocks that no tag or name sets aside; those inside such an element where it holds the article or most of the text."""
        free = [block for block in self.blocks if not block.element.names]
        if not any(block.element.article for block in free):
            sizes: dict[int, int] = {}
            for block in self.blocks:
                for name in block.element.names:
                    sizes[name] = sizes.get(name, 0) + len(block.text) - 2 * block.links
            least = max(MOST_FROM, sum(len(block.text) for block in self.blocks) / 2)
            back = self.holders | {name for name, size in sizes.items() if size > least}
            free = [block for block in self.blocks if back.issuperset(block.element.names)]
        inside = [block for block in free if block.element.article]
        other = sum(len(block.text) - block.links for block in free if not block.element.article)
        alone = sum(len(block.text) for block in inside) >= other or self.main or (self.articles == 1 and self.titled == 1)
        return inside if inside and alone else free

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are bogus comments in html, up to the next '>'."""
        return self.parse_bogus_comment(i, report)

    def finish(self) -> None:
        if self.rawdata[:1] == "<" and (self.rawdata[1:2].isalpha() or self.rawdata[1:2] in ("/", "!", "?")):
            self.rawdata = ""  # a tag or comment that the page breaks off in is no text
        self.close()
        while len(self.stack) > 1:
            self._close()
        self._end_block()


def read_page(html: str | None) -> list[_Block]:
    """Blocks of a page that its markup does not set aside, in page order."""
    reader = _Reader()
    try:
        reader.feed(LONG_REFERENCE.sub(_short_reference, html or ""))
    except (AssertionError, ValueError):  # what was read before stays
        reader.rawdata = ""
    reader.finish()
    return reader.kept_blocks()


def place(element: _Open) -> _Open:
    """``element`` with its node, style and depth in the style tree, set for all elements above it as well."""
    chain = []
    while element.node is None:
        chain.append(element)
        if element.up is None:
            break
        element = element.up
    for element in reversed(chain):
        up = element.up
        element.depth = up.depth + 1 if up else 0
        element.style = _hash(" ".join(element.runs))
        within = up is not None and (element.depth > DEEPEST or element.tag in INLINE)
        element.node = up.node if within else _hash(f"{up.node}>{up.style}>{element.run}") if up else 0
    return chain[0] if chain else element


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


PAGE = ("body long, nodes array<struct<above: array<long>, title: boolean>>, styles array<struct<node: long, style: long>>, "
        "blocks array<struct<node: int, article: boolean, links: int, text: string>>")
_PAGE = pa.struct([
    ("body", pa.int64()), ("nodes", pa.list_(pa.struct([("above", pa.list_(pa.int64())), ("title", pa.bool_())]))),
    ("styles", pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))),
    ("blocks", pa.list_(pa.struct([("node", pa.int32()), ("article", pa.bool_()), ("links", pa.int32()), ("text", pa.string())])))])


def page_record(html: str | None) -> dict:
    """A page as the style tree sees it: ``nodes`` with those above (root first), their styles, the kept blocks."""
    blocks = read_page(html)
    nodes: dict[int, int] = {}
    paths: list[dict] = []
    styles: dict[tuple[int, int], None] = {}

    def index(element: _Open) -> int:
        chain = []
        while element is not None and place(element).node not in nodes:
            chain.append(element)
            element = element.up
        for element in reversed(chain):
            if element.node not in nodes:
                above = paths[nodes[element.up.node]]["above"] if element.up else []
                nodes[element.node] = len(paths)
                paths.append({"above": [*above, element.node], "title": element.tag in TITLES})
        return nodes[(chain[0] if chain else element).node]

    rows = []
    for element, text, links in blocks:
        rows.append({"node": index(element), "article": element.article, "links": links, "text": text})
        while element is not None and (element.node, element.style) not in styles:
            if element.tag not in INLINE:
                styles[element.node, element.style] = None
            element = element.up
    return {"body": _hash("\n".join(row["text"] for row in rows)), "nodes": paths,
            "styles": [{"node": node, "style": style} for node, style in styles], "blocks": rows}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([page_record(html.as_py()) for html in batch.column(2)], _PAGE)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.flatten()],
                                         names=["id", "url", *(field.name for field in _PAGE)])


def parsed(pages: DataFrame) -> DataFrame:
    """``id, url, host, site`` and the record of every page; each page is parsed once and stored."""
    kind = dict(pages.dtypes)["id"]
    records = stored(pages.select("id", "url", "html").mapInArrow(_parsed, f"id {kind}, url string, {PAGE}"))
    return records.withColumn("host", host_of(F.col("url"))).withColumn("site", site_of(F.col("host")))


def node_counts(records: DataFrame) -> DataFrame:
    """``site, host, node, kind, value, n, size, links, above, title``: distinct page bodies by node and style (kind 1) or text (2).

    Kind 0 counts the node itself with the text of its pages as ``size``; kinds share one shuffle and combine before it.
    """
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda total, block: total + F.length(block.text))
    node_facts = F.transform("nodes", lambda node: F.struct(
        F.element_at(node.above, -1).alias("node"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("value"), chars.alias("size"),
        F.lit(0).cast("long").alias("links"), node.above.alias("above"), node.title.alias("title")))
    no_path = F.lit(None).cast("array<long>").alias("above"), F.lit(None).cast("boolean").alias("title")
    zero = F.lit(0).cast("long")
    style_facts = F.transform("styles", lambda style: F.struct(
        style.node.alias("node"), F.lit(1).alias("kind"), style.style.alias("value"), zero.alias("size"), zero.alias("links"), *no_path))
    text_facts = F.transform("blocks", lambda block: F.struct(
        F.element_at(F.element_at(F.col("nodes"), block.node + 1).above, -1).alias("node"), F.lit(2).alias("kind"),
        F.xxhash64(block.text).alias("value"), F.length(block.text).cast("long").alias("size"), block.links.cast("long").alias("links"), *no_path))
    facts = records.select("site", "host", "body", F.explode(F.concat(node_facts, style_facts, text_facts)).alias("fact"))
    once = (facts.groupBy("site", "host", "body", "fact.node", "fact.kind", "fact.value")
            .agg(F.max("fact.size").alias("size"), F.max("fact.links").alias("links"), F.first("fact.above").alias("above"),
                 F.first("fact.title").alias("title")))
    return once.groupBy("site", "host", "node", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.first("above").alias("above"),
        F.first("title").alias("title"))


def importance(counts: DataFrame, scope: str | None) -> DataFrame:
    """``scope, node, m, share, value``: the importance of every node of the trees of ``scope`` (host, site; None: one tree)."""
    keys = [scope] if scope else []
    total = counts.groupBy(*keys, "node", "kind", "value").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.first("above", True).alias("above"),
        F.first("title", True).alias("title"))
    n = F.col("n")
    of_kind = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = cut_lineage(total.groupBy(*keys, "node").agg(
        of_kind(0, n).alias("m"), of_kind(0, F.col("size")).alias("whole"), F.first("above", True).alias("above"),
        F.first("title", True).alias("title"), of_kind(1, n).alias("styles"), of_kind(1, n * F.log(n)).alias("style_logs"),
        of_kind(2, F.lit(1.0)).alias("texts"), of_kind(2, F.log(n)).alias("text_logs"), of_kind(2, F.col("size")).alias("size"),
        of_kind(2, F.col("links")).alias("links")))
    # What lies below a node: its own texts and those of the nodes that have it above them.
    below = (nodes.filter("texts > 0").select(*keys, F.explode("above").alias("node"), "texts", "text_logs", "size", "links")
             .groupBy(*keys, "node").agg(*[F.sum(name).alias(name) for name in ("texts", "text_logs", "size", "links")]))
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    looks = F.coalesce((F.log("styles") - F.col("style_logs") / F.col("styles")) / base, F.lit(0.0))
    scored = nodes.select(*keys, "node", "m", "whole", "above", "title", "styles", "style_logs").join(below, [*keys, "node"]).select(
        *keys, "node", "m", "title", F.try_element_at("above", F.lit(-2)).alias("up"), looks.alias("looks"), (F.col("size") / F.col("whole")).alias("share"),
        ((1 - F.col("text_logs") / base / F.col("texts")) * (1 - F.col("links") / F.col("size"))).alias("content"))
    forks = scored.filter(F.col("share") >= STEM).select(*keys, F.col("up").alias("fork")).distinct().filter("fork IS NOT NULL")
    on = F.col("up") == F.col("fork")
    if scope:
        forks = forks.withColumnRenamed(scope, "_scope")
        on = on & (F.col(scope) == F.col("_scope"))
    seen = F.when(F.col("fork").isNotNull() & ~F.col("title"), PLAIN + (1 - PLAIN) * F.greatest("looks", "share")).otherwise(F.lit(1.0))
    return scored.join(forks, on, "left").select(*keys, "node", "m", "share", F.round(F.col("content") * seen, 6).alias("value"))


def low_nodes(records: DataFrame, least_pages: int = LEAST_PAGES, least_of_all: int = LEAST_PAGES_OF_ALL, low: float = LOW) -> DataFrame:
    """``host, node``: nodes of low importance in the tree of the host, or of its domain or all hosts where it has too few pages."""
    counts = stored(node_counts(records))
    named = lambda scope, to: importance(counts, scope).select(
        *([scope] if scope else []), "node", F.struct("m", "share", "value").alias(to))
    trees = (named("host", "own").join(counts.filter("kind = 0").select("host", "site").distinct(), "host")
             .join(named("site", "sites"), ["site", "node"]).join(named(None, "all"), "node"))
    by = (F.when(F.col("own.m") >= least_pages, F.col("own")).when(F.col("sites.m") >= least_pages, F.col("sites"))
          .when(F.col("all.m") >= least_of_all, F.col("all")))
    return trees.select("host", "node", by.alias("by")).filter((F.col("by.value") < low) & (F.col("by.share") < STEM)).select("host", "node")


def main_text(html: str | None) -> str:
    """The text of a page by its own markup alone."""
    return "\n".join(block.text for block in read_page(html))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id_column, url_column, text, n_chars`` of every row of ``pages``."""
    records = parsed(pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")))
    low = cut_lineage(low_nodes(records))
    lists = low.groupBy("host").agg(F.collect_list("node").alias("low"))
    if low.count() <= BROADCAST_NODES:
        lists = F.broadcast(lists)
    above = lambda block: F.element_at(F.col("nodes"), block.node + 1).above
    kept = F.filter("blocks", lambda block: block.article | F.col("low").isNull() | ~F.arrays_overlap(above(block), "low"))
    text = F.array_join(F.transform(kept, lambda block: block.text), "\n")
    return (records.join(lists, "host", "left").select(F.col("id").alias(id_column), F.col("url").alias(url_column), text.alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
