"""Main-text extraction by composite text density.

Each page is parsed into a tree of elements. Elements that never hold main text (scripts, menus) are cut off.
Forms, and whatever is named as an advert, a notice, a sidebar or comments, are only suspected: one goes unless it
holds most of the page's characters outside links, or the page's articles. Every node left gets its
characters, tags, link characters and link tags; its composite density is characters per tag, damped by the
share of links; its density sum adds its children's densities. The node of the largest sum is the core, the
smallest density on the path from it to the body is the threshold, and below every node at or above the
threshold the subtree of the largest sum is main text. A core inside a paragraph or an article is widened to
the enclosing container first, so short paragraphs beside a long one stay.

Defined cases: a null or empty page, or one without text, gives the empty text; unclosed and stray tags are
repaired as browsers do for paragraphs, list items and table cells; pages are independent, so repeated rows
give repeated results; nesting depth is not limited, and time grows with the page's length, not with its depth.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right as bisect
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements without main text, wherever they are.
CUT = frozenset("script style noscript template svg math iframe object canvas audio video nav footer aside button select textarea input dialog head menu label option map noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: Containers that a core is widened to; anything else is part of one.
CONTAINER = frozenset("article main div section body td html".split())
#: An opening tag closes what stands in the set, up to the nearest element of the scope.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul center".split(), (frozenset({"p"}), frozenset("td th button table".split()))),
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Names (a whole class or id) of what is not main text.
_WORDS = (
    r"(?:ads?|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promos|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|sidebar|sidebars|rail|widget|widgets|footer|masthead|"
    r"comment|comments|disqus|replies|respond|related|recommended|recommendations|share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|skip|toc|tags|hidden)"
)
#: Words that say which one, or what kind of box, beside such a name: cookie-notice, comments-area, site-footer.
_BESIDE = r"(?:area|bar|block|box|button|buttons|container|form|footer|header|inner|item|items|left|link|links|list|main|media|page|panel|post|posts|primary|right|secondary|section|site|slot|top|unit|wrap|wrapper)"
NOISE = re.compile(rf"(?:^|\s)(?:(?:{_BESIDE}|{_WORDS})[_-]+)*{_WORDS}(?:[_-]+(?:{_BESIDE}|{_WORDS}))*(?:$|\s)", re.I)
HEADER = re.compile(r"(?:^|\s)(?:site|page|top|global|main)?[_-]?header(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "links", "link_tags", "density", "sum", "cut", "suspect")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.kids, self.cut, self.suspect = tag, parent, [], cut, False
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.sum = 0.0


def _is_cut(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in CUT or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def _is_suspect(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag == "form":
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    names = [a or b or c for name, a, b, c in _ATTR.findall(attrs) if name.lower() in ("class", "id")]
    return any(NOISE.search(x) or (not inside_article and HEADER.search(x)) for x in names)


def _cut_suspects(root: Node) -> None:
    """Cut the suspects off, but not one with most of the page's characters outside links, nor one with an article
    when every article of the page is inside of suspects."""
    order = _in_order(root)
    if not any(n.suspect for n in order):
        return
    linked, plain, articles = {id(None): False}, {}, {}
    for n in order:
        linked[id(n)] = linked[id(n.parent)] or n.tag == "a"
    for n in reversed(order):
        own = 0 if linked[id(n)] else sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
        below = [k for k in n.kids if isinstance(k, Node) and not k.cut]
        plain[id(n)] = own + sum(plain[id(k)] for k in below)
        articles[id(n)] = n.tag in ("article", "main") or any(articles[id(k)] for k in below)
    for n in order:
        n.suspect = n.suspect and 2 * plain[id(n)] <= plain[id(root)]
    under, clear = {id(None): False}, False
    for n in order:
        under[id(n)] = under[id(n.parent)] or n.suspect
        clear = clear or n.tag in ("article", "main") and not under[id(n)]
    for n in order:
        n.cut = n.suspect and (clear or not articles[id(n)])


def parse(html: str) -> Node:
    """The tree of a page; texts are strings among a node's children, with their references decoded."""
    root = Node("html", None)
    at, node, lower = 0, root, None
    # the open elements, and where each tag, blocks and articles stand among them: no step walks up the tree
    stack, where, open_blocks, articles = [root], {"html": [0]}, [0], []

    def close_from(i: int) -> Node:
        while len(stack) > i:
            gone = stack.pop()
            where[gone.tag].pop()
            if open_blocks[-1] == len(stack):
                open_blocks.pop()
            if articles and articles[-1] == len(stack):
                articles.pop()
        return stack[-1]

    def add(text: str) -> None:
        if text and not node.cut:
            node.kids.append(unescape(text))

    for m in iter(lambda: _TOKEN.search(html, at), None):
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            i = where[tag][-1] if where.get(tag) else 0
            # a stray inline end tag does not close blocks
            if i and (tag in BLOCK or i > open_blocks[-1]):
                node = close_from(i)
            continue
        if tag in ("html", "body") and tag in (node.tag, root.tag) and node is root and tag == "html":
            continue
        if closes := CLOSES.get(tag):
            scope = max((where[t][-1] for t in closes[1] if where.get(t)), default=-1)
            found = [own[k] for t in closes[0] if (own := where.get(t)) and (k := bisect(own, scope)) < len(own)]
            if found and min(found):
                node = close_from(min(found))
        child = Node(tag, node, node.cut or _is_cut(tag, m[3], bool(articles)))
        child.suspect = _is_suspect(tag, m[3], bool(articles))
        node.kids.append(child)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else html
            end = lower.find(f"</{tag}", at)
            close = html.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(html)
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        if tag in ("article", "main"):
            articles.append(len(stack))
        stack.append(child)
        node = child
    add(html[at:])
    _cut_suspects(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes that are not cut, parents before children."""
    order, todo = [], [root]
    while todo:
        top = todo.pop()
        order.append(top)
        todo.extend(k for k in reversed(top.kids) if isinstance(k, Node) and not k.cut)
    return order


def _measure(order: list[Node]) -> None:
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            elif not k.cut:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.links += k.links
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.links, n.link_tags = n.chars, n.link_tags + 1
    body = order[0]
    share = body.links / max(body.chars, 1)
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.links, 1), max(n.link_tags, 1)
        if c:
            base = math.log(c / max(c - n.links, 1) * n.links + share * c + math.e)
            n.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / base if n.links else c / t
        own = sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
        n.sum = own + sum(k.density for k in n.kids if isinstance(k, Node) and not k.cut)


def main_nodes(root: Node) -> set[int]:
    """The ids of the topmost nodes of main text."""
    order = _in_order(root)
    _measure(order)
    core = max(order, key=lambda n: n.sum)  # the first of equals: the outermost
    up = core
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is None:
        up = core
        while up.parent is not None and up.tag not in CONTAINER:
            up = up.parent
    core = up
    least, up = core.density, core.parent
    while up is not None:
        least, up = min(least, up.density), up.parent
    best: dict[int, Node] = {}
    for n in reversed(order):  # the largest sum in each subtree
        top = n
        for k in n.kids:
            if isinstance(k, Node) and not k.cut and best[id(k)].sum > top.sum:
                top = best[id(k)]
        best[id(n)] = top
    above, up = set(), core
    while up is not None:
        above.add(id(up))
        up = up.parent
    main, inside = {id(core)}, set()
    for n in order:
        if id(n.parent) in inside or id(n) in main and n is core:
            inside.add(id(n))
        elif n.chars and n.density >= least and n.tag in BLOCK and n.tag not in ("body", "html") and id(n) not in above:
            main.add(id(best[id(n)]))
    return main


def blocks(root: Node, main: set[int]) -> list[str]:
    """The texts of the blocks in main, in page order, each with its white space made one space and trimmed."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    todo: list = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                now.append(item)
        elif not item.cut:
            inside = inside or id(item) in main
            if item.tag in BLOCK:
                flush()
                todo.append((None, False))
            elif item.tag in ("br", "td", "th"):
                now.append(" ")
            todo.extend((k, inside) for k in reversed(item.kids))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    return "\n".join(blocks(root, main_nodes(root)))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text, n_chars. Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
