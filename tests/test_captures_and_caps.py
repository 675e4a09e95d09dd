"""No caps on digits, real HTML tag ends, one row per key, no job lost."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.layout import PARTITIONS, spread
from corpusloom.functions.text import decode_entities
from corpusloom.functions.urls import hostname, resolve_links
from corpusloom.operators.bodies import lookup_manifests, pages_left_to_html, pick_body
from corpusloom.operators.links import extract_links
from corpusloom.operators.tokens import attribute, page_tokens
from corpusloom.plans.build import build_documents, plan_jobs
from corpusloom.plans.settings import apply_mode
from corpusloom.plans.crawl import checked_selectors, followed_pages, selectors_in_use, taken_pages
from corpusloom.sources.captures import captured, read_pages
from corpusloom.sources.corpus import corpus_documents
from corpusloom.sources.scratch import stored


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "shown"),
    [("&#0000000065;", "A"), ("&#x000000041;", "A"), ("&#0000000000065;x", "Ax"), ("&#65;", "A"), ("&#0;", "\ufffd"),
     ("&#99999999999999999999;", "\ufffd"), ("&#xFFFFFFFFFFFF;", "\ufffd"), ("&#xFFFFFFFF;", "\ufffd"), ("&#x1F600;", "\U0001f600"),
     ("&#9999999999;", "\ufffd"), ("&#000;", "\ufffd"), ("&#x0;", "\ufffd")],
)
def test_references_have_any_number_of_digits(spark, text, shown):
    assert value(spark, decode_entities(F.lit(text))) == shown


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://h:99999999999/p", None), ("https://h:70000/", None), ("https://h:65535/", "h"), ("https://h:0000000080/", "h"), ("https://h:/", "h")],
)
def test_ports(spark, url, host):
    assert value(spark, hostname(F.lit(url))) == host


@pytest.mark.parametrize(
    ("base", "ref", "url"),
    [("https://h/a/b", "https:x", "https://h/a/x"), ("http://h/a/b", "https:x", "https://x/"), ("https://h/a/b", "HTTPS:/x", "https://x/"),
     ("https://h/a/b", "https:", "https://h/a/b"), ("https://h/a/b", "https://o/x", "https://o/x"), ("https://h/a/b", "x:y", "x:y")],
)
def test_relative_reference_with_the_base_scheme(spark, base, ref, url):
    df = spark.createDataFrame([(base, ref)], "base string, ref string")
    assert resolve_links(df, "base", "ref").first().url == url


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_a_slash_ends_no_element(spark):
    df = pages(spark, "<nav><a href=/docs/>Docs</a><a href=/x>X</a><a href='/s'/>Self</a></nav>")
    got = extract_links(df, "nav a").orderBy("ord").collect()
    assert [(r.href, r.title) for r in got] == [("/docs/", "Docs"), ("/x", "X"), ("/s", "Self")]


def test_kinds_of_tags(spark):
    df = pages(spark, "<br/><svg><path d='x'/></svg><div/>t</div><img src=a/><hr>")
    got = [(r.tag, r.kind) for r in page_tokens(df).orderBy("pos").collect() if r.tag]
    assert got == [("br", "void"), ("svg", "open"), ("path", "void"), ("svg", "close"), ("div", "open"), ("div", "close"), ("img", "void"), ("hr", "void")]


@pytest.mark.parametrize(
    ("tok", "href"),
    [("<a href=/docs/>", "/docs/"), ("<a href='/docs'/>", "/docs"), ("<a href=/docs />", "/docs"), ("<a href/>", ""), ("<a x=1/>", None)],
)
def test_slash_in_attributes(spark, tok, href):
    assert value(spark, attribute(F.lit(tok), "href")) == href


def test_spread_takes_its_count_from_the_setting(spark):
    df = spark.range(10)
    assert "hashpartitioning(id#" in spread(df, "id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(PARTITIONS, "23")
    try:
        assert spread(df, "id").rdd.getNumPartitions() == 23
    finally:
        spark.conf.unset(PARTITIONS)


def test_status_is_read_where_recorded(spark, tmp_path):
    pages(spark, "a").withColumn("url", F.lit("u")).write.parquet(str(tmp_path / "old"))
    assert captured(read_pages(spark, str(tmp_path / "old"))).first().ok
    df = pages(spark, "a", "b").withColumn("url", F.lit("u")).withColumn("status", (F.col("page_id") * 100 + 200).cast("int"))
    df.write.parquet(str(tmp_path / "new"))
    assert {r.page_id: r.ok for r in captured(read_pages(spark, str(tmp_path / "new"))).collect()} == {0: True, 1: False}


def test_newest_answered_capture(spark):
    rows = [(1, "u", "old", 200, "2024-01-01"), (2, "u", "new", 200, "2024-03-01"), (3, "u", "gone", 404, "2024-04-01"), (4, "v", "v", 200, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, status int, captured_at string")
    df = df.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    taken, known = taken_pages(df, df.select("url").distinct())
    assert sorted((r.page_id, r.url) for r in known.collect()) == [(2, "u"), (4, "v")]
    assert sorted(r.html for r in taken.collect()) == ["new", "v"]


def test_repeated_manifests_and_full_bodies(spark):
    sites = spark.createDataFrame([("s", "https://a.com/")], "site string, base_url string")
    twice = spark.createDataFrame([("https://a.com/llms.txt", 200, "# A long text"), ("https://a.com/llms.txt", 200, "# B long text")],
                                  "manifest_url string, status int, content string")
    assert [r.content for r in lookup_manifests(sites, twice).collect()] == ["# B long text"]
    plan = spark.createDataFrame([(1, "u", True)], "page_id long, url string, is_full_content boolean")
    full = spark.createDataFrame([("u", 200, "one"), ("u", 200, "two"), ("u", 500, "zzz")], "url string, status int, body string")
    none = spark.createDataFrame([], "page_id long, body string, markdown string, error string")
    got = pick_body(plan, full, none.select("page_id", "body"), none.select("page_id", "markdown", "error")).collect()
    assert [(r.source, r.body) for r in got] == [("full", "two")]


JOBS = (
    "site string, base_url string, follow_selector string, content_selector string, use_manifest boolean, "
    "include_optional boolean, use_native_md boolean, domain string, output_dir string, error string, mode string"
)


def jobs(spark):
    def job(site, follow, content):
        return (site, f"https://{site}.com/", follow, content, False, False, False, f"{site}.com", "", None, "follow")

    return spark.createDataFrame([job("a", "main a", "main"), job("b", "nav a", "article"), job("c", "a:hover", "main"), job("d", None, "main")], JOBS)


def site_pages(spark, times=1):
    html = "<main><a href=/m>M</a></main><nav><a href=/n>N</a></nav><article>Art</article>"
    urls = [f"https://{s}.com/{p}" for s in "abcd" for p in ("", "m", "n")] * times
    return spark.createDataFrame([(k, u, html, 200) for k, u in enumerate(urls)], "page_id long, url string, html string, status int")


def test_no_job_is_lost(spark):
    ready = stored(checked_selectors(jobs(spark)), "jobs")
    assert {r.site: r.error for r in ready.collect()} == {"a": None, "b": None, "c": "unsupported selector: a:hover", "d": None}
    assert selectors_in_use(ready, "follow_selector") == ["main a", "nav a"]
    manifests = spark.createDataFrame([], "manifest_url string, status int, content string")
    plan = plan_jobs(ready, manifests, site_pages(spark))
    assert sorted((r.site, r.url) for r in plan.collect()) == [("a", "https://a.com/m"), ("b", "https://b.com/n"), ("d", "https://d.com/")]
    with pytest.raises(ValueError, match="main a"):
        followed_pages(ready, site_pages(spark), ["nav a"])


def test_repeated_captures_give_each_document_once(spark):
    ready = stored(checked_selectors(jobs(spark)), "jobs")
    manifests = spark.createDataFrame([], "manifest_url string, status int, content string")
    captures = site_pages(spark, 3)
    plan = stored(plan_jobs(ready, manifests, captures), "plan")
    none = spark.createDataFrame([], "md_url string, url string, status int, body string")
    docs = build_documents(ready, plan, captures, none.select("md_url", "status", "body"), none.select("url", "status", "body")).collect()
    assert sorted((r.site, r.source) for r in docs) == [("a", "html"), ("b", "html"), ("d", "html")]
    assert all(r.body for r in docs)


@pytest.mark.parametrize(
    ("url", "error"),
    [("https://a.com/x", None), ("nonsense", "invalid entry URL: nonsense"), (None, "invalid entry URL: "), ("https://a:99999/", "invalid entry URL: https://a:99999/")],
)
def test_entry_urls(spark, url, error):
    kind = "base_url string, mode string, follow_selector string, use_manifest boolean"
    assert apply_mode(spark.createDataFrame([(url, None, None, None)], kind)).first().error == error


def test_only_pages_without_a_body_are_converted(spark):
    plan = spark.createDataFrame(
        [(1, "f", True), (2, "e", True), (3, "n", False), (4, "h", False), (5, "x", True)],
        "page_id long, url string, is_full_content boolean",
    )
    full = spark.createDataFrame([("f", 200, "text"), ("e", 200, "<SYSTEM>s</SYSTEM> "), ("h", 200, "not asked")], "url string, status int, body string")
    native = spark.createDataFrame([(3, "md"), (1, "never")], "page_id long, body string")
    assert sorted(r.page_id for r in pages_left_to_html(plan, full, native).collect()) == [2, 4, 5]
    assert sorted(r.page_id for r in pages_left_to_html(plan, full, native, False).collect()) == [2, 3, 4, 5]
    html = pages(spark, "a", "<p>b</p>").join(pages_left_to_html(plan, full, native), "page_id", "left_semi")
    planned = page_tokens(html)._jdf.queryExecution().optimizedPlan().toString()
    assert planned.index("Generate") < planned.index("LeftSemi") < planned.index("LeftAnti")


def test_equal_order_is_settled_by_site_and_url(spark):
    rows = [(1, s, f"https://{s}.com/", "T", f"body {s}", "d.com") for s in "cab"]
    df = spark.createDataFrame(rows, "ord int, site string, url string, title string, body string, domain string")
    assert [r.body for r in corpus_documents(df.repartition(3), ["ord"]).collect()] == ["body c"]
