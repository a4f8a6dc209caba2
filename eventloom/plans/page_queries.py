"""Queries over the trees of pages: nearest ancestors, descendants, sections, look-ups by title, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.html import html_nodes
from ..operators import linkage, scans, trees
from ..sources import catalogue
from .registry import register

_BLOCKS = "article aside body div footer header li main nav p section table td ul ol".split()
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def nodes(spark, sf_dir, *fields):
    return html_nodes(_pages(spark, sf_dir), "page_id", fields=fields)


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# Tags of a page in order, without what stands in comments, scripts and styles; node is the number of the opening tag.
_TAGS = r"""(SELECT page_id, i, shut, tag, (sum(CASE WHEN shut THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS node, t AS raw FROM (
 SELECT page_id, i, t, starts_with(t, '</') AS shut, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM (
 SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g'), '</?[a-zA-Z][^>]*>[^<]*') AS l FROM pages))))"""
_VOID = _list("area base br col embed hr img input link meta param source track wbr".split())
# A walk over all pages' tags at once: the stack of open elements before each tag.
_WALK = f"""RECURSIVE tags AS MATERIALIZED (SELECT * FROM {_TAGS}), walk(page_id, i, names, ids) AS (
 SELECT page_id, 1::BIGINT, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM tags WHERE i = 1
 UNION ALL SELECT w.page_id, w.i + 1,
  CASE WHEN t.shut AND list_contains(names, tag) THEN names[1 : len(names) - list_position(list_reverse(names), tag)] WHEN t.shut OR tag IN {_VOID} THEN names ELSE list_append(names, tag) END,
  CASE WHEN t.shut AND list_contains(names, tag) THEN ids[1 : len(names) - list_position(list_reverse(names), tag)] WHEN t.shut OR tag IN {_VOID} THEN ids ELSE list_append(ids, node) END
 FROM walk w JOIN tags t ON t.page_id = w.page_id AND t.i = w.i)"""


@register("nearest_block_of_links", f"""WITH {_WALK} SELECT t.page_id, node AS node_id, list_filter(ids, lambda x, k: names[k] IN {_list(_BLOCKS)})[-1] AS ancestor
FROM tags t JOIN walk w ON t.page_id = w.page_id AND t.i = w.i WHERE NOT shut AND tag = 'a'""")
def nearest_block_of_links(spark, sf_dir):
    """For every link of every page, the block that it stands in."""
    return trees.nearest_ancestor(nodes(spark, sf_dir, "node_id", "tag", "last_id"), "page_id", F.col("tag") == "a", F.col("tag").isin(*_BLOCKS))


@register("descendants_of_articles", f"""WITH {_WALK} SELECT page_id, node_id, tag, count(*) AS n FROM (SELECT t.page_id, tag, unnest(list_filter(ids, lambda x, k: names[k] IN ('article', 'nav', 'ul'))) AS node_id
FROM tags t JOIN walk w ON t.page_id = w.page_id AND t.i = w.i WHERE NOT shut AND tag IN ('a', 'p')) GROUP BY ALL""")
def descendants_of_articles(spark, sf_dir):
    """How many links and paragraphs stand below each article, menu and list, at any depth."""
    n = nodes(spark, sf_dir, "node_id", "tag", "last_id")
    pairs = trees.descendants(n, "page_id", F.col("tag").isin("article", "nav", "ul"), F.col("tag").isin("a", "p"))
    kind = n.select("page_id", F.col("node_id").cast("long").alias("descendant"), "tag")
    return pairs.join(kind, ["page_id", "descendant"]).groupBy("page_id", "node_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@register("sectioned_paragraphs", f"""SELECT page_id, node AS node_id, heading FROM (SELECT page_id, node, tag, shut, last_value(CASE WHEN NOT shut AND tag IN {_list(_HEADS)} THEN node END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS heading FROM {_TAGS}) WHERE tag = 'p' AND NOT shut""")
def sectioned_paragraphs(spark, sf_dir):
    """Each paragraph with the heading that it follows, by a scan over each page's nodes in stretches."""
    rows = nodes(spark, sf_dir, "node_id", "tag").select("page_id", F.col("node_id").cast("long").alias("node_id"), "tag")
    heading = F.when(F.col("tag").isin(*_HEADS), F.col("node_id"))
    return scans.fill_forward(rows, ["page_id"], "node_id", heading, "heading", stretch=16).filter("tag = 'p'").select("page_id", "node_id", "heading")


_CLEAR = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_KEY = f"trim(regexp_replace(lower({_CLEAR}), '[^a-z0-9]+', ' ', 'g'))"


@register("cards_with_details_by_title", f"""WITH h AS (SELECT page_id, node, {_KEY.format("regexp_extract(raw, '>([^<]*)', 1)")} AS key FROM {_TAGS} WHERE tag = 'h1' AND NOT shut),
d AS (SELECT key, arg_max(struct_pack(page_id := page_id, node := node), page_id * 1000000 + node) AS last FROM h GROUP BY key), c AS (SELECT page_id, {_KEY.format("regexp_extract(html, '<title>([^<]*)', 1)")} AS key FROM pages)
SELECT c.page_id, d.last.page_id AS detail_page, d.last.node AS detail_node FROM c LEFT JOIN d ON c.key = d.key""")
def cards_with_details_by_title(spark, sf_dir):
    """Every page's title looked up among all pages' headings; of headings that read alike, the last counts."""
    n = nodes(spark, sf_dir, "node_id", "tag", "own_text")
    cards = n.filter("tag = 'title'").groupBy("page_id").agg(F.min_by("own_text", "node_id").alias("title"))
    cards = _pages(spark, sf_dir).select("page_id").join(cards, "page_id", "left")
    details = n.filter("tag = 'h1'").select(F.col("own_text").alias("title"), F.col("page_id").alias("detail_page"), F.col("node_id").cast("long").alias("detail_node"))
    return linkage.with_last_by_title(cards, details, F.struct("detail_page", "detail_node")).select("page_id", "detail_page", "detail_node")


@register("last_page_by_host", """SELECT host, max(page)::INT AS last_page, count(*) AS pages FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT), 0) AS page FROM pages) GROUP BY host""")
def last_page_by_host(spark, sf_dir):
    """The largest page number that the links of each host name."""
    p = _pages(spark, sf_dir).select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("target"))
    return catalogue.last_page(p, "host", "target").select("host", "last_page", "pages")


@register("fold_documents", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents WHERE text IS NOT NULL")
def fold_documents(spark, sf_dir):
    """Every whole text without accents, in the JVM."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@register("search_by_trigrams", """SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'leau') AND contains(strip_accents(lower(coalesce(text, ''))), 'ere') AND contains(strip_accents(lower(coalesce(text, ''))), 'o')""")
def search_by_trigrams(spark, sf_dir):
    """Texts that contain every term, by the posting table of all texts' trigrams."""
    from ..operators import search
    from ..storage import new_folder
    from .query import QuerySpec

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = new_folder(spark, "trigrams")
    search.index(d, "doc_id", "text").write.parquet(path)
    return search.search(d, spark.read.parquet(path), "doc_id", "text", QuerySpec(q="Leau éRe o").terms).select("doc_id")
