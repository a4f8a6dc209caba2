import re
from html import unescape

import pytest

from eventloom.llm import op09_html as H

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First   long paragraph of the text,\n with a break.<br><p>Of.</p><p>Another <a href='#'>linked</a> paragraph that is long enough to count.</p></article>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><div class=ad>Buy this now, it is very cheap and good and long</div>{ARTICLE}<footer>Foot</footer>",
        f"<body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><aside>Side</aside>{ARTICLE}<section class='comments'><p>A reader's long comment that goes on and on and on for longer than the article does, truly.</p></section>",
        f"<body>{ARTICLE.replace('</article>', '<div class=comments><p>Nice</p></div><form><input value=x>Send</form></article>')}",
        f"<body><!-- <p>no</p> --><script>var t='</p>';</script><style>p{{}}</style>{ARTICLE}<noscript>Enable</noscript>",
        ARTICLE.replace("article", "div"),
    ],
)
def test_only_the_article(html):
    assert H.main_text(html) == "Title & more\nFirst long paragraph of the text, with a break.\nOf.\nAnother linked paragraph that is long enough to count."


def test_edges():
    assert H.main_text(None) == H.main_text("") == H.main_text("<div></div>") == ""
    assert H.main_text("just text &eacute;&nbsp;x") == "just text é x"
    assert H.main_text("<p>a<p>b<ul><li>c<li>d</ul>") == "a\nb\nc\nd"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert H.main_text(deep) == "deep text"


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        inner = re.sub(r"<(/?)(p|h1)>", "\0", inner)
        inner = unescape(re.sub(r"<[^>]*>", " ", inner).replace("\0", "\x00"))
        want = "\n".join(t for x in inner.replace("�", "\0").split("\0") if (t := " ".join(x.split())))
        assert got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(want)


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", ARTICLE), (3, "w", "<p>" + "long text " * 50_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text").write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op9_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == 5
    assert {r.page_id: r.n_chars for r in got}[3] == 499_999
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert H.op9_html_extraction(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("start", ["<div class='has-sidebar'>", "<div class='with-banner'>", "<div class='no-comments'>", "<section class='post-tags'>", "<div class=banner>", "<form>"])
def test_a_wrapper_keeps_its_article(start):
    end = f"</{start[1:].split()[0].rstrip('>')}>"
    want = H.main_text(ARTICLE)
    assert want and H.main_text(f"<body><p>Hi</p>{start}{ARTICLE}<div class=share>Share it</div>{end}</body>") == want
    assert H.main_text(f"<body><p>Hi</p>{start}{ARTICLE.replace('article', 'div')}{end}</body>").endswith(want)


def test_short_articles_in_named_boxes_stay():
    box = "<div class=widget><article><p>A text of some length number {}.</p></article></div>"
    assert "number 1" in H.main_text("<body>" + "".join(box.format(i) for i in range(5)))


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "The text.", "<p><span>" * 50_000 + "The text." + "</b>" * 50_000, "<ul><li>" * 40_000 + "The text." + "</li></ul>" * 40_000])
def test_deep_pages_take_linear_time(page):
    import time

    begun = time.time()
    assert H.main_text(page) == "The text."
    assert time.time() - begun < 4


def naive(node):
    """Characters, tags, link characters and link tags of a subtree, and its nodes, by plain recursion."""
    chars = tags = links = link_tags = 0
    below = [node]
    for kid in node.kids:
        if isinstance(kid, str):
            chars += sum(not c.isspace() for c in kid)
        elif not kid.cut:
            c, t, lc, lt, nodes = naive(kid)
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt
            below += nodes
    if node.tag == "a":
        links, link_tags = chars, link_tags + 1
    node.want = (chars, tags, links, link_tags)
    return chars, tags, links, link_tags, below


def test_density_sums_equal_their_formula():
    """Composite text density and density sums of every node of drawn pages, computed anew from the definition."""
    import math
    import random

    class Node(H.Node):  # room for what is expected
        __slots__ = ("want",)

    draw = random.Random(8)
    for _ in range(60):
        page = "".join(draw.choice([f"<{t}>", f"</{t}>", "some words here ", "x "]) for t in draw.choices(["div", "p", "a", "span", "ul", "li", "section", "b"], k=draw.randint(5, 80)))
        H_Node, H.Node = H.Node, Node
        try:
            root = H.parse(page)
        finally:
            H.Node = H_Node
        H._measure(H._in_order(root))
        chars, _, links, _, nodes = naive(root)
        share = links / max(chars, 1)

        def density(n):
            c, t, lc, lt = n.want
            if not c:
                return 0.0
            if not lc:
                return c / max(t, 1)
            ratio = c / lc * max(t, 1) / max(lt, 1)
            return c / max(t, 1) * max(math.log(max(ratio, 1.0)), 0.0) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)  # noqa: B023

        for n in nodes:
            assert n.density == pytest.approx(density(n))
            own = sum(sum(not c.isspace() for c in k) for k in n.kids if isinstance(k, str))
            assert n.sum == pytest.approx(own + sum(density(k) for k in n.kids if not isinstance(k, str) and not k.cut))
