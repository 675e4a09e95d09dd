"""Of several captures the newest answered one counts, and only what is chosen moves."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.bodies import lookup_manifests, pages_left_to_html, pick_body, probe_native_md
from corpusloom.sources.captures import fetched, newest_answers


def bodies(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} string, status int, body string, captured_at long")


def test_manifests(spark):
    sites = spark.createDataFrame([(c, f"https://{c}.com/x") for c in "abcd"], "site string, base_url string")
    texts = bodies(spark, "manifest_url", [
        ("https://a.com/llms.txt", 200, "# old manifest", 1), ("https://a.com/llms.txt", 200, "", 2),
        ("https://b.com/llms.txt", 200, "# old manifest", 1), ("https://b.com/llms.txt", 200, "# new manifest", 2),
        ("https://b.com/llms.txt", 404, "# not there at all", 3), ("https://c.com/llms.txt", 500, "# server error", 1),
        ("https://b.com/llms.txt", 200, "# new manifest", 2),
    ]).withColumnRenamed("body", "content")
    got = {r.site: (r.content, r.usable) for r in lookup_manifests(sites, texts).collect()}
    assert got == {"a": (None, False), "b": ("# new manifest", True), "c": (None, False), "d": (None, False)}


def test_native_bodies(spark):
    pages = spark.createDataFrame([(k, f"https://x.com/{k}") for k in range(5)] + [(9, "https://x.com/0")], "page_id long, url string")
    texts = bodies(spark, "md_url", [
        ("https://x.com/0.md", 200, "aaa old text", 1), ("https://x.com/0.md", 200, "zzz new text", 2), ("https://x.com/0.md", 404, "gone, all of it", 3),
        ("https://x.com/1.md", 200, "good old text", 1), ("https://x.com/1.md", 200, "<!DOCTYPE html>", 2), ("https://x.com/1/index.md", 200, "second choice", 1),
        ("https://x.com/2.md", 200, "stored twice", 1), ("https://x.com/2.md", 200, "stored twice", 1),
        ("https://x.com/3.md", 200, "without a time", None), ("https://x.com/4.md", 200, None, 1),
    ])
    got = sorted((r.page_id, r.rank, r.body) for r in probe_native_md(pages, texts).collect())
    want = [(0, 0, "zzz new text"), (1, 1, "second choice"), (2, 0, "stored twice"), (3, 0, "without a time"), (9, 0, "zzz new text")]
    assert got == want


def test_full_texts(spark):
    plan = spark.createDataFrame([(1, "u", True), (2, "v", True), (3, "w", True)], "page_id long, url string, is_full_content boolean")
    full = bodies(spark, "url", [("u", 200, "old", 1), ("u", 200, "<SYSTEM>x</SYSTEM> new", 2), ("v", 200, "old", 1), ("v", 200, "<SYSTEM>x</SYSTEM>", 2)])
    native = spark.createDataFrame([], "page_id long, body string")
    html = spark.createDataFrame([(2, "# from page", None)], "page_id long, markdown string, error string")
    assert sorted(r.page_id for r in pages_left_to_html(plan, full, native).collect()) == [2, 3]
    got = {r.page_id: (r.source, r.body) for r in pick_body(plan, full, native, html).collect()}
    assert got == {1: ("full", "new"), 2: ("html", "# from page"), 3: (None, None)}


@pytest.mark.parametrize("time", ["captured_at", "to_timestamp('2024-01-01') + make_interval(0, 0, 0, cast(captured_at AS int)) AS captured_at"])
def test_values_are_never_grouped(spark, time):
    texts = bodies(spark, "url", [("u", 200, "x" * 9, k) for k in range(5)]).selectExpr("url", "status", "body", time)
    last = newest_answers(texts, "url", "body", _long=F.length("body") > 3)
    assert last.count() == 1 and "body" not in last.columns
    # Bodies are joined, and grouped only where a capture was stored more than once.
    plan = last._jdf.queryExecution().optimizedPlan().toString()
    assert "first(body" not in plan and "max(body" not in plan and "min(body" not in plan
    assert [r.body for r in fetched(last, texts, "url", "body", "url").collect()] == ["x" * 9]
