import pytest
from pyspark.sql import functions as F

from corpusloom.plans.crawl import crawl_plan, crawl_preview, followed_pages
from corpusloom.plans.settings import apply_mode, effective_config
from corpusloom.sources.captures import as_site_config, read_site_config
from corpusloom.verify.queries import registered

JOB = "site string, base_url string, mode string"
OVERRIDE = (
    "site string, follow_selector string, content_selector string, output_dir string, "
    "no_native_md boolean, no_manifest boolean, with_optional boolean"
)


def test_layering(spark):
    jobs = spark.createDataFrame(
        [("a", "https://www.x.com/d", "auto"), ("b", "https://y.com", "auto"), ("c", "bad", "auto")],
        JOB,
    )
    overrides = spark.createDataFrame(
        [("a", None, "main", None, True, False, None), ("c", "nav a", None, "out", None, None, True)],
        OVERRIDE,
    )
    config = as_site_config(
        spark.createDataFrame(
            [("x.com", "li a", "article", True, False), ("www.x.com", "never", "never", None, None)],
            "domain string, follow_selector string, content_selector string, "
            "use_native_md boolean, use_manifest boolean",
        )
    )
    got = {r.site: r for r in effective_config(jobs, overrides, config).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.follow_selector, a.content_selector, a.output_dir) == ("li a", "main", "./")
    assert (a.use_native_md, a.use_manifest, a.include_optional) == (False, False, False)
    assert (b.follow_selector, b.content_selector, b.output_dir) == (None, "body", "./")
    assert (b.use_native_md, b.use_manifest, b.include_optional) == (True, True, False)
    assert (c.domain, c.follow_selector, c.output_dir, c.include_optional) == ("", "nav a", "out", True)


def test_site_config_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"domain": "x.com", "use_native_md": false}\n')
    row = read_site_config(spark, str(tmp_path)).first()
    assert (row.domain, row.use_native_md, row.follow_selector) == ("x.com", False, None)


@pytest.mark.parametrize(
    "mode, selector, manifest, want",
    [
        ("auto", "nav a", True, ("nav a", True, None)),
        (None, None, False, (None, False, None)),
        ("single", "nav a", True, (None, False, None)),
        ("follow", "nav a", True, ("nav a", False, None)),
        ("follow", "", True, ("", False, "follow mode needs a follow selector")),
        ("follow", None, True, (None, False, "follow mode needs a follow selector")),
        ("all", "nav a", True, ("nav a", True, "unknown mode: all")),
    ],
)
def test_modes(spark, mode, selector, manifest, want):
    df = spark.createDataFrame(
        [(mode, selector, manifest)], "mode string, follow_selector string, use_manifest boolean"
    )
    r = apply_mode(df).first()
    assert (r.follow_selector, r.use_manifest, r.error) == want


def test_plan_branches(spark):
    jobs = spark.createDataFrame(
        [
            ("m", "https://m.com/", "nav a", True, None),
            ("moff", "https://mo.com/", None, False, None),
            ("f", "https://f.com/x", "nav a", True, None),
            ("fnone", "https://fn.com/x", "nav a", True, None),
            ("blank", "https://b.com/p/q/", "  ", True, None),
            ("err", "https://e.com/", "nav a", True, "no"),
        ],
        "site string, base_url string, follow_selector string, use_manifest boolean, error string",
    ).withColumns(
        {
            "domain": F.col("site"),
            "content_selector": F.lit("body"),
            "output_dir": F.lit("./out/"),
            "use_native_md": F.lit(True),
            "mode": F.lit("auto"),
        }
    )
    listed = spark.createDataFrame(
        [("m", 1, "https://m.com/1", "one", False), ("m", 2, "https://m.com/2.txt", "two", True),
         ("moff", 1, "https://mo.com/1", "x", False), ("err", 1, "u", "x", False)],
        "site string, ord int, url string, title string, is_full_content boolean",
    )
    pages = spark.createDataFrame(
        [(1, "https://m.com/", "<nav><a href=z>z</a></nav>"),
         (2, "https://f.com/x", "<nav><a href=b>b</a><a href=c>c</a></nav>"),
         (3, "https://fn.com/x", "<p>none</p>")],
        "page_id bigint, url string, html string",
    )
    links = followed_pages(jobs, pages, ["nav a"])
    plan = crawl_plan(jobs, listed, links)
    rows = plan.orderBy("site", "ord").collect()
    assert [(r.site, r.source, r.ord, r.url, r.title, r.is_full_content) for r in rows] == [
        ("blank", "single", 1, "https://b.com/p/q/", "q", False),
        ("f", "follow", 1, "https://f.com/b", "b", False),
        ("f", "follow", 2, "https://f.com/c", "c", False),
        ("m", "manifest", 1, "https://m.com/1", "one", False),
        ("m", "manifest", 2, "https://m.com/2.txt", "two", True),
        ("moff", "single", 1, "https://mo.com/", "index", False),
    ]
    preview = crawl_preview(jobs, plan).where("site = 'm'").orderBy("n").collect()
    assert [(r.n, r.total_pages, r.mode, r.output_directory) for r in preview] == [
        (1, 2, "auto", "./out/m"), (2, 2, "auto", "./out/m")
    ]


def test_unknown_selector_fails_early(spark):
    jobs = spark.createDataFrame([("a", "u", "a:hover")], "site string, base_url string, follow_selector string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    with pytest.raises(ValueError):
        followed_pages(jobs, pages, ["a:hover"])


def test_site_config_scan_reads_files(spark):
    names = registered()["site_config_scan"](spark, "/root/testdata/sf0.001").inputFiles()
    assert names and all(name.endswith(".json") for name in names)
