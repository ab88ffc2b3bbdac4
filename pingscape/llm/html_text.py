"""Main text of web pages by composite text density.

A page is read into a tree with the usual implied end tags; head, scripts, styles,
select boxes and the like never enter it, and subtrees that a page marks as furniture
(navigation, footers, page headers, sidebars, forms, adverts, notices, reader comments,
by element, role, or a whole class or id) are set aside.  A class or id that is a known name
does so only where its subtree does not hold the core, most of the page's text outside links or
its largest `article` or `main`, and the name of a menu inside an article, `main` or the core only
where links make up half of it; a form, aside, dialog or header element does so only where it does not
hold the largest `article` or `main` or, on a page without these, most of the text
outside links; reader comments count where the page has other text.  For every node with C
characters in T tags, of which LC lie in LT links, the density is C / T times
(1 + log(C/LC * T/LT)) / (1 + log(base)), where the base grows with the link text
of the node and of the page (denominators at least 1).  A node's density sum is that of its children.  The
node with the largest sum is the core; the least density on the path from it to
the body is the threshold; the topmost nodes that reach it and, like the core,
are not made of links give the text, with a heading of the first level, or any heading right
before the path, beside it.

An `article` or `main` element is a hint that only adds text: the innermost one around the core is
taken whole in the core's place, and with an article the further articles beside it that
are not made of links.  A core outside any such element stands as it is.
The text of the chosen nodes is not cut: character references decoded, white space
inside a block made one space, blocks joined by one space.  Null, empty or
tag-only pages give an empty text.  Markup that is cut off or badly nested is read
as far as it goes.  Of equal density sums the first node in page order is the core.  Very long
pages are read whole, in linear time, one page at a time; repeated rows, and rows without id or
url, are rows of their own; an empty table gives an empty one.  Only the three named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<[!?][^>]*(?:>|$)"
    # a quote opens a value only after an equals sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*?)(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that are left out up to their end tag.  Without one, raw text goes on to the page's end, the others lose only the tag.
RAW_TEXT = frozenset("script style textarea iframe title".split())
LEFT_OUT = RAW_TEXT | frozenset("noscript template svg math select".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.IGNORECASE) for name in LEFT_OUT}
#: A tag of foreign content (or a frame) that closes itself has no content; a slash inside an unquoted value does not count.
_CLOSES_ITSELF = re.compile(r"(?:^|[\s\"'])/$")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

#: Element names (fixed values of the HTML standard, and which of them are never article text).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl body html td th article section div".split())
MAIN = frozenset("html body article main".split())
FURNITURE = frozenset("nav footer button menu head".split())
#: Elements that are furniture unless the page's text is in them.
LIKELY_FURNITURE = frozenset("aside form dialog header".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
COMMENT_NAMES = frozenset("comment comments comment-list commentlist comment-section comments-section comments-area comments-list disqus disqus-thread replies respond".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox ad-banner ad-box ad-container ad-slot ad-wrapper banner "
    "breadcrumb breadcrumbs breadcrumb-nav cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent-banner copyright disclaimer donate "
    "footer site-footer page-footer main-footer global-footer footer-links header site-header global-header masthead login "
    "menu main-menu mobile-menu nav-menu menubar modal popup overlay nav navbar nav-bar nav-links main-nav site-nav top-nav navigation main-navigation site-navigation "
    "newsletter newsletter-signup notice notices notification pager pagination paywall promo promotion recommended related related-articles related-links related-posts related-stories "
    "share share-bar share-buttons share-links sharing social social-bar social-buttons social-icons social-links social-media social-share "
    "sidebar left-sidebar right-sidebar sidebar-left sidebar-right signup sitemap skip skip-link skip-links sponsor sponsored subscribe subscription tag-list toolbar topbar top-bar widget widgets widget-area".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that an article may use for something else than a list of links.
MENU_NAMES = frozenset(n for n in FURNITURE_NAMES if n.startswith(("menu", "nav")) or n.endswith(("menu", "nav", "navigation")))
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "children", "furniture", "named", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "parent")

    def __init__(self, name: str, parent: Node | None, furniture: bool = False, named: frozenset[str] = frozenset()) -> None:
        self.name, self.parent, self.furniture, self.named = name, parent, furniture, named
        self.children: list = []  # nodes and texts
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


def _is_furniture(name: str, attributes: str) -> bool:
    if name in FURNITURE:
        return True
    if not attributes or name in MAIN:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def _known_names(name: str, attributes: str) -> frozenset[str]:
    """The classes and ids of an element that are, as a whole, known names of furniture."""
    if not attributes or name in MAIN or name in HEADINGS:
        return frozenset()
    names = (n for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id") for n in (m[2] or m[3] or m[4] or "").split())
    return frozenset(n for n in (_CAMEL.sub("-", n).lower().replace("_", "-").strip("-") for n in names) if n in FURNITURE_NAMES or n in COMMENT_NAMES)


def parse(page: str) -> Node:
    """The tree of a page; its root is the body."""
    root = node = Node("body", None)
    at = 0
    endless: set[str] = set()  # elements of LEFT_OUT without a further end tag
    while (m := _MARKUP.search(page, at)) is not None:
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in LEFT_OUT:
            if not m[1] and not (name in ("svg", "math", "iframe") and _CLOSES_ITSELF.search(m[3])):
                end = None if name in endless else _END[name].search(page, at)
                if end is not None:
                    at = end.end()
                elif name in RAW_TEXT:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if m[1]:
            if name in ("html", "body"):
                continue
            match = node
            while match is not None and match.name != name:
                # an end tag of an inline element does not reach out of its block
                match = None if name in INLINE and match.name in SCOPES else match.parent
            if match is not None and match is not root:
                node = match.parent
            elif name in ("p", "br"):
                node.children.append(Node("br", node))
            continue
        if name in ("html", "body"):
            node = root
            continue
        if node.name == "head" and name not in VOID:
            node = root
        if name in CLOSES_P or name in SIBLINGS:
            ends = {"p"} if name in CLOSES_P else SIBLINGS[name]
            match = node
            while match is not root and match.name not in ends and match.name not in SCOPES and match.name not in FURNITURE and match.name not in LIKELY_FURNITURE:
                match = match.parent
            while match is not root and match.name in ends:
                node = match = match.parent
        child = Node(name, node, _is_furniture(name, m[3]), _known_names(name, m[3]))
        node.children.append(child)
        if name not in VOID and not m[3].endswith("/"):
            node = child
    if at < len(page):
        node.children.append(page[at:])
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes outside furniture, parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.furniture)
    return out


def measure(root: Node) -> list[Node]:
    """Set characters, tags, links, density and density sum of every node outside furniture."""
    nodes = _in_order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = 0.0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(" ".join(html.unescape(c).split()))
            elif not c.furniture:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    body = nodes[0]
    body_links = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars:
            ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + body_links * n.chars + math.e)
            n.density = n.chars / max(1, n.tags) * (1.0 + math.log(max(1.0, ratio))) / (1.0 + math.log(base))
    for n in nodes:
        n.density_sum = sum(c.density for c in n.children if isinstance(c, Node) and not c.furniture)
    return nodes


def _gather(node: Node, out: list[str]) -> None:
    """Texts of a subtree in page order; a block's edges and line breaks are white space."""
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(html.unescape(n) if "&" in n else n)
        elif not n.furniture or n is node:
            if n.name not in INLINE:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(n.children))


def _path(node: Node) -> list[Node]:
    """From a node up to the body."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _own_text(node: Node) -> int:
    return node.chars - node.link_chars


def _inside(node: Node, names: tuple[str, ...]) -> bool:
    return any(n.name in names for n in _path(node)[1:])


def set_likely_aside(root: Node) -> None:
    """Make furniture of forms, asides, dialogs and page headers, as far as the page's text is not in them."""
    likely = [n for n in _in_order(root) if n.name in LIKELY_FURNITURE and not (n.name == "header" and _inside(n, ("article", "main")))]
    if not likely:
        return
    nodes = measure(root)
    marked = [n for n in nodes if n.name in ("article", "main") and n.chars]
    held = set(map(id, _path(max(marked, key=_own_text)))) if marked else set()
    for n in likely:
        if id(n) not in held and (marked or 2 * _own_text(n) <= _own_text(root)):
            n.furniture = True


def set_named_aside(root: Node) -> None:
    """Make furniture of the subtrees whose class or id names them so, as far as they cannot be the article."""
    everything = _in_order(root)
    comments = [n for n in everything if not n.named.isdisjoint(COMMENT_NAMES)]
    named = [n for n in everything if n.named and n.named.isdisjoint(COMMENT_NAMES)]
    if not comments and not named:
        return
    for n in comments:
        n.furniture = True
    nodes = measure(root)
    if comments and not root.chars:  # the page has nothing else
        for n in comments:
            n.furniture = False
        nodes = measure(root)
    core = max(nodes, key=lambda n: n.density_sum)
    marked = [n for n in nodes if n.name in ("article", "main")]
    held = set(map(id, _path(core)))
    if marked:
        held.update(map(id, _path(max(marked, key=_own_text))))
    for n in named:
        if n.named <= MENU_NAMES and 2 * n.link_chars < n.chars and (_inside(n, ("article", "main")) or any(p is core for p in _path(n)[1:-1])):
            continue
        if id(n) not in held and not (n.density_sum > 0.0 and 2 * _own_text(n) > _own_text(root)):
            n.furniture = True


def choose(root: Node) -> list[Node]:
    """Subtrees that make up the article, in page order."""
    set_likely_aside(root)
    set_named_aside(root)
    nodes = measure(root)
    core = max(nodes, key=lambda n: n.density_sum)
    if core.density_sum <= 0.0:
        return [root]
    path = _path(core)
    threshold = min(n.density for n in path)
    if len(path) == 1:
        return [root]
    # an article or main element around the core widens it, and further articles beside that one are parts of the same text
    marked = [i for i, n in enumerate(path) if n.name in ("article", "main")]
    path = path[marked[0] if marked else 0 :]
    core = path[0]
    chosen: list[Node] = []

    # from the body down to the core: on either side of the path, blocks as dense as its least dense node
    after: list[list[Node]] = []
    for n, below in zip(path[:0:-1], path[-2::-1], strict=True):
        at = next(i for i, c in enumerate(n.children) if c is below)
        parts = core.name == "article" and below is core
        dense = [isinstance(c, Node) and not c.furniture and (c.density >= threshold or parts and c.name == "article") and 2 * c.link_chars < c.chars for c in n.children]
        if core.name not in ("article", "main"):
            # the title above the text
            before = [i for i, c in enumerate(n.children[:at]) if isinstance(c, Node) and not c.furniture and c.chars]
            for i in before:
                c = n.children[i]
                dense[i] |= (c.name == "h1" or i == before[-1] and c.name in HEADINGS) and 2 * c.link_chars < c.chars
        chosen += [c for c, d in zip(n.children[:at], dense[:at], strict=True) if d]
        after.append([c for c, d in zip(n.children[at + 1 :], dense[at + 1 :], strict=True) if d])
    chosen.append(core)
    for some in reversed(after):
        chosen += some
    return chosen


def main_text(page: str | None) -> str:
    """The article text of one page."""
    if not page:
        return ""
    out: list[str] = []
    for n in choose(parse(page)):
        _gather(n, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                texts = [main_text(p.as_py()) for p in rows.column("html")]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
