"""Arbitrary markup: nothing is lost, no page disappears, both area paths agree."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import ordered_concat
from corpusloom.operators.content import content_area
from corpusloom.operators.links import extract_links
from corpusloom.operators.markdown import html_to_markdown
from corpusloom.operators.selectors import select_nodes
from corpusloom.operators.skeleton import html_skeleton
from corpusloom.operators.tokens import page_nodes, page_tokens

PARTS = [
    "<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<b>", "</b>", "<a href=x>",
    "</a>", "<nav>", "</nav>", "<br>", "<main>", "</main>", "<!--", "-->", "<script>", "</script>",
    "<", ">", "</", "'", '"', "=", "text", " ", "\n", "&amp;", "&", "<img alt='>'>", "<h2>", "</h2>",
    "<blockquote>", "</blockquote>", "<pre>", "</pre>", "<code>", "</code>", "<body>", "</body>", "é",
]


@pytest.fixture(scope="module")
def wild(spark):
    rng = random.Random(11)
    rows = [(n, "https://h.com/", "".join(rng.choices(PARTS, k=rng.randint(0, 40)))) for n in range(1200)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8).cache()


def test_tokens_cover_pages(wild):
    joined = page_tokens(wild).groupBy("page_id").agg(ordered_concat("tok", "pos").alias("s"))
    both = wild.join(joined, "page_id", "left")
    assert both.where(F.coalesce("s", F.lit("")) != F.col("html")).count() == 0


def test_intervals_stay_in_page(wild):
    bad = (F.col("end_pos") < F.col("pos")) | (F.col("end_pos") >= F.col("n_tok"))
    nodes = page_nodes(page_tokens(wild))
    assert nodes.count() > 0 and nodes.where(bad).count() == 0


def test_every_page_has_a_row(wild):
    for df in (html_to_markdown(wild), html_to_markdown(wild, "main"), content_area(wild, "li a")):
        assert df.select("page_id").distinct().count() == df.count() == wild.count()
    assert html_skeleton(wild).count() > 1000


def test_markdown_and_area_agree_on_failures(wild):
    area = content_area(wild, "main").select("page_id", "error")
    markdown = html_to_markdown(wild, "main").select("page_id", "error")
    assert area.exceptAll(markdown).count() == 0


def test_area_paths_agree(wild):
    for tag in ("main", "div", "nav"):
        fast = content_area(wild, tag).select("page_id", "inner")
        general = content_area(wild, f"{tag}, nosuch").select("page_id", "inner")
        assert fast.exceptAll(general).count() == 0, tag


def test_selector_paths_agree(wild):
    # The second spelling cannot take the running-depth path.
    fast = extract_links(wild, "nav a").select("page_id", "href", "title")
    general = extract_links(wild, "nav a, nosuch.x a").select("page_id", "href", "title")
    assert fast.exceptAll(general).count() == general.exceptAll(fast).count() == 0


def test_children_are_descendants(wild):
    tokens = page_tokens(wild)
    children = select_nodes(tokens, "div > p")
    assert children.count() > 0
    assert children.exceptAll(select_nodes(tokens, "div p")).count() == 0
