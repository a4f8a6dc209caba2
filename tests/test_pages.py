"""Pages as nodes and texts: which references are read, and batches that don't grow with a part."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import html, text
from eventloom.functions.html import html_lines, html_nodes, html_text

MARKUP = "<title>a &amp b &quot; &lt;c&gt;</title>"


def pages(spark, n, page):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.lit(page).alias("html"))


def test_text_reads_named_references_only(spark):
    got = pages(spark, 1, MARKUP).select(html_text("html", ("lt", "gt", "amp")).alias("some"), html_text("html").alias("all")).first()
    assert (got.some, got.all) == ("a &amp b &quot; <c>", 'a & b " <c>')


def test_lines_read_named_references_only(spark):
    assert pages(spark, 1, "<p>a&ampb</p><p>&amp;amp;</p>").select(html_lines("html", ("amp",)).alias("l")).first().l == ["a&ampb", "&amp;"]


def test_nodes_read_named_references_only(spark):
    (got,) = html_nodes(pages(spark, 1, MARKUP), "page_id", fields=("own_text",), references=("lt", "gt", "amp")).collect()
    assert got.own_text == "a &amp b &quot; <c>"


def test_nodes_come_in_small_batches(spark):
    n = html_nodes(pages(spark, 3000, "<p>a</p>" * 20), "page_id", fields=("node_id", "tag"))
    assert n.columns == ["page_id", "node_id", "tag"] and n.count() == 60_000
    assert "MapInArrow" in n._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("term", ["x", "leau"])
def test_a_text_without_a_term_is_not_walked(spark, term, monkeypatch):
    monkeypatch.setattr(text, "_unaccented", lambda c: pytest.fail("one character at a time"))
    assert text._marked("Bordeaux, l'eau & " * 3, [term]) == "Bordeaux, l'eau &amp; " * 3
