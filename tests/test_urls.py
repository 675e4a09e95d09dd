import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls

RESOLVED = [
    ("https://h.com/a/b?x#y", "//x.org/p", "https://x.org/p"),
    ("http://h.com/a", "//x.org/p", "http://x.org/p"),
    ("https://h.com/a/b", "/p", "https://h.com/p"),
    ("https://h.com/a/b", "p", "https://h.com/a/p"),
    ("https://h.com/a/b/", "p", "https://h.com/a/b/p"),
    ("https://h.com/a/b/c", "../p", "https://h.com/a/p"),
    ("https://h.com/a", "../../p", "https://h.com/p"),
    ("https://h.com/a/b", "./p/.", "https://h.com/a/p/"),
    ("https://h.com/a/b", "x/..", "https://h.com/a/"),
    ("https://h.com/a/b?q", "?r=1", "https://h.com/a/b?r=1"),
    ("https://h.com/a?q", "#f", "https://h.com/a?q#f"),
    ("https://h.com/a?q#old", "#f", "https://h.com/a?q#f"),
    ("https://h.com/a?q#old", "", "https://h.com/a?q"),
    ("https://h.com", "p", "https://h.com/p"),
    ("https://h.com/a", "mailto:a@b.c", "mailto:a@b.c"),
    ("https://h.com/a", "javascript:void(0)", "javascript:void(0)"),
    ("https://h.com:8080/a", "/p", "https://h.com:8080/p"),
    ("https://h.com:443/a", "/p", "https://h.com/p"),
    ("https://h.com/a", "HTTP://UP.Com:80/P", "http://up.com/P"),
    ("https://h.com/a", "https://u:p@x.org/q", "https://u:p@x.org/q"),
    ("https://a_b.com/x", "y", "https://a_b.com/y"),
    ("https://h.com/a", " /sp ace ", "https://h.com/sp%20ace"),
    ("https://h.com/a", "/x\ny", "https://h.com/xy"),
    ("https://h.com/a", "/a|b", "https://h.com/a|b"),
    ("https://h.com/a", "/ü", "https://h.com/%C3%BC"),
    ("https://h.com/a", "/%C3%BC", "https://h.com/%C3%BC"),
    ("https://h.com/a", "/😀", "https://h.com/%F0%9F%98%80"),
    ("https://h.com/a", "\\b\\c", "https://h.com/b/c"),
    ("https://h.com/a", "/q?a='b'&c=\"d\"", "https://h.com/q?a=%27b%27&c=%22d%22"),
    ("https://h.com/a", "http://b c/", None),
    ("https://h.com/a", "http://h:99999/", None),
    ("https://h.com/a", "http:///", None),
    ("nope", "/p", None),
    ("https://h.com/a", None, None),
    ("https://[::1]:8080/a", "/p", "https://[::1]:8080/p"),
]


def test_resolve(spark):
    df = spark.createDataFrame(
        [(n, b, h) for n, (b, h, _) in enumerate(RESOLVED)], "n int, base string, ref string"
    )
    got = {r.n: r.url for r in urls.resolve_links(df, "base", "ref").collect()}
    for n, (base, ref, want) in enumerate(RESOLVED):
        assert got[n] == want, (base, ref)


DOMAINS = [
    ("https://www.site.com/docs", "site.com"),
    ("https://WWW.Site.com:8080/docs", "site.com"),
    ("https://wwwx.com", "wwwx.com"),
    ("https://docs.www.com/", "docs.www.com"),
    ("http://a_b.com/x", "a_b.com"),
    ("https://u:p@h.com/", "h.com"),
    ("mailto:a@b.c", ""),
    ("not a url", "unknown"),
    ("http://a b/", "unknown"),
    ("http://a|b/", "unknown"),
    ("", "unknown"),
    (None, "unknown"),
]


def test_domain(spark):
    df = spark.createDataFrame([(u,) for u, _ in DOMAINS], "url string")
    got = [r[0] for r in df.select(urls.domain(F.col("url"))).collect()]
    assert got == [d for _, d in DOMAINS]
    assert df.select(urls.domain(F.lit("x"), unknown="")).first()[0] == ""


CANDIDATES = [
    ("https://h.com", ["https://h.com.md", "https://h.com/index.md"]),
    ("https://h.com/", ["https://h.com/index.md", "https://h.com.md"]),
    ("https://h.com/a.html", ["https://h.com/a.md", "https://h.com/a.html.md"]),
    ("https://h.com/a.HTML/", ["https://h.com/a.md", "https://h.com/a.HTML.md"]),
    ("https://h.com/v1.2", ["https://h.com/v1.md", "https://h.com/v1.2.md"]),
    ("https://h.com/docs/?q=1", ["https://h.com/docs.md", "https://h.com/docs/index.md"]),
    ("https://h.com/docs/", ["https://h.com/docs/index.md", "https://h.com/docs.md"]),
    ("https://h.com/docs#x", ["https://h.com/docs.md", "https://h.com/docs/index.md"]),
    ("https://h.com/a/b", ["https://h.com/a/b.md", "https://h.com/a/b/index.md"]),
]


@pytest.mark.parametrize("url, want", CANDIDATES)
def test_md_candidates(spark, url, want):
    assert spark.range(1).select(urls.md_candidates(F.lit(url))).first()[0] == want


def test_path_title(spark):
    cases = {
        "https://h.com": "index",
        "https://h.com/": "index",
        "https://h.com/a/b/": "b",
        "https://h.com/a//b?x=/c": "b",
        "https://h.com/ü": "%C3%BC",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = df.select("url", urls.path_title(F.col("url")).alias("t")).collect()
    assert {r.url: r.t for r in got} == cases
