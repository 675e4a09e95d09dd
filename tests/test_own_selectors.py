"""Selectors that pages bring along, against one run per selector."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.content import content_area
from corpusloom.operators.links import extract_links
from corpusloom.operators.own_selectors import OwnSelectors, asked_pages, is_supported
from corpusloom.operators.selectors import parse_selector, select_nodes
from corpusloom.operators.tokens import page_tokens
from corpusloom.plans.crawl import checked_selectors, followed_pages

HTML = [
    "<html><head><title>t</title></head><body><nav id=top class='main big'><ul><li><a href=/a>A</a></li><li><b><a href=/b class=x>B</a></b></li></ul></nav>"
    "<article data-k='a b'><p>one <a href='https://x.com/d?q=1'>D</a><p>two<div class=ad><a href=/e>E</a></div></article></body></html>",
    "<div><nav><a href=/1>1</a><div><a href=/2>2</a></div></nav><a href=/3>3</a></div>",
    "plain text",
    "<ul><li><ul><li><a href=/deep>x</a></ul></ul><nav><p><a href=/p>p</a>",
]
SELECTORS = [
    "nav a", "nav > a", "nav li > a", "ul ul a", "article a, .ad a", "a[href^='/']", "a.x", "#top a", "nav.main.big li a",
    "[data-k='a b'] > p a", "div > a, nav > div a, li > a", "*", "li", "article", "body", "main", "p", "div div", "a[href$='1'], a[href*=x]", "nav#top > ul > li > a",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://h{k}.com/", html) for k, html in enumerate(HTML)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def asked(spark, pages):
    selectors = spark.createDataFrame([(s,) for s in SELECTORS], "selector string")
    return pages.select("page_id").crossJoin(selectors)


def test_links_and_areas_equal_one_run_per_selector(spark, pages, asked):
    some = SELECTORS[::3]
    asked = asked.where(F.col("selector").isin(some))
    own = OwnSelectors.of(asked, "selector")
    units = asked_pages(pages, asked)
    links = {(r.page_id.page_id, r.page_id.selector, r.ord, r.href, r.title) for r in extract_links(units, own).collect()}
    areas = {(r.page_id.page_id, r.page_id.selector, r.inner, r.error) for r in content_area(units, own).collect()}
    assert links == {(r.page_id, s, r.ord, r.href, r.title) for s in some for r in extract_links(pages, s).collect()}
    assert areas == {(r.page_id, s, r.inner, r.error) for s in some for r in content_area(pages, s).collect()}


def test_matched_elements_equal_one_run_per_selector(spark, pages, asked):
    from corpusloom.operators.own_selectors import own_tokens

    rows = own_tokens(asked_pages(pages, asked), OwnSelectors.of(asked, "selector")).where("matched")
    got = {(r.page_id.page_id, r.page_id.selector, r.pos, r.end_pos, r.tag) for r in rows.collect()}
    want = {(r.page_id, s, r.pos, r.end_pos, r.tag) for s in SELECTORS for r in select_nodes(page_tokens(pages), s).collect()}
    assert got == want and len(got) > 50


SPELLINGS = [
    *SELECTORS, "", "  ", "a:hover", "a ~ b", "a + b", "a,", ",a", "> a", "a >", "a > > b", "#x#y", "#x[a='#']", "a.#b", "[a", "a[b=]", "a[b='x y']c",
    "a [b] , c>d", "  nav   a ", "*.x", "a*", "é", "ab.é", "a[b~=c]", "a\n>\tb", None, "#x.y#z", "[a='b,c > d'] e",
]


def test_supported_spellings(spark):
    def taken(text):
        try:
            return bool(parse_selector(text))
        except (ValueError, AttributeError):
            return False

    df = spark.createDataFrame([(s,) for s in SPELLINGS], "s string")
    got = {r.s: r.ok for r in df.select("s", is_supported(F.col("s")).alias("ok")).collect()}
    assert got == {s: taken(s) for s in SPELLINGS}


def test_plan_does_not_grow_with_selectors(spark, pages):
    def lines(count):
        jobs = spark.createDataFrame(
            [(f"s{k}", f"https://h{k % 3}.com/", f"nav .c{k} > a" if k else "nav a", None) for k in range(count)],
            "site string, base_url string, follow_selector string, error string",
        )
        plan = followed_pages(jobs, pages)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("\n"), plan.count("html")

    assert lines(2) == lines(200)


def test_jobs_share_an_entry_page(spark, pages):
    kind = "site string, base_url string, follow_selector string, error string"
    jobs = spark.createDataFrame(
        [("a", "https://h0.com/", "nav a", None), ("b", "https://h0.com/", "article a", None), ("c", "https://h0.com/", "nav a", None),
         ("d", "https://h9.com/", "nav a", None), ("e", "https://h0.com/", None, None), ("f", "https://h0.com/", "a:hover", "no")], kind,
    )
    got = {(r.site, r.ord, r.title) for r in followed_pages(jobs, pages).collect()}
    assert got == {("a", 1, "A"), ("a", 2, "B"), ("c", 1, "A"), ("c", 2, "B"), ("b", 1, "D"), ("b", 2, "E")}
    assert followed_pages(jobs.where("site > 'x'"), pages).collect() == []
    bad = spark.createDataFrame([("f", "https://h0.com/", "a:hover", None)], kind)
    with pytest.raises(Exception, match="unsupported selector: a:hover"):
        followed_pages(bad, pages).collect()
    checked = checked_selectors(bad.withColumn("content_selector", F.lit("body")))
    assert followed_pages(checked, pages).collect() == []
