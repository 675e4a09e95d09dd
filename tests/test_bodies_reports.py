import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bodies, naming, reports
from corpusloom.sources.captures import captured
from corpusloom.sources.corpus import (
    export_text,
    list_corpus,
    read_corpus,
    write_corpus,
)
from corpusloom.sources.scratch import scratch_path


def test_clean_full_content(spark):
    cases = {
        "<SYSTEM>a\nb</SYSTEM>\n\n # T ": "# T",
        "x <SYSTEM>1</SYSTEM> y <SYSTEM>2</SYSTEM>z": "x y z",
        "<SYSTEM>only</SYSTEM> ": "",
        "<system>kept</system>": "<system>kept</system>",
        "<SYSTEM>open": "<SYSTEM>open",
    }
    df = spark.createDataFrame([(c,) for c in cases], "b string")
    got = df.select("b", bodies.clean_full_content(F.col("b")).alias("c")).collect()
    assert {r.b: r.c for r in got} == cases


@pytest.mark.parametrize(
    "status, body, want",
    [
        (200, "# long enough", True),
        (299, "0123456789", True),
        (200, "012345678", False),
        (200, "          ", True),
        (404, "# long enough", False),
        (None, "# long enough", False),
        (200, " \n<!DOCTYPE html><p>", False),
        (200, "<html><p>abc</p>", False),
        (200, "<!doctype html> lower case passes", True),
        (200, None, False),
    ],
)
def test_usable_md(spark, status, body, want):
    df = spark.createDataFrame([(status, body)], "s int, b string")
    assert df.select(bodies.usable_md(F.col("s"), F.col("b"))).first()[0] is want


def test_probe_order_and_ties(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.com/a"), (2, "https://h.com/b"), (3, "https://h.com/c"), (4, "bad")],
        "page_id bigint, url string",
    )
    answers = spark.createDataFrame(
        [
            ("https://h.com/a/index.md", 200, "second choice"),
            ("https://h.com/a.md", 200, "first choice z"),
            ("https://h.com/a.md", 200, "first choice a"),
            ("https://h.com/b.md", 200, "<html>no such page</html>"),
            ("https://h.com/b/index.md", 200, "b by index"),
            ("https://h.com/c.md", 500, "c is not there"),
        ],
        "md_url string, status int, body string",
    )
    got = bodies.probe_native_md(pages, answers).orderBy("page_id").collect()
    assert [(r.page_id, r.rank, r.body) for r in got] == [
        (1, 0, "first choice a"), (2, 1, "b by index")
    ]


@pytest.mark.parametrize("native_on", [True, False])
def test_pick_body(spark, native_on):
    plan = spark.createDataFrame(
        [(1, "f1", True), (2, "f2", True), (3, "n", False), (4, "h", False), (5, "none", False), (6, "f6", True)],
        "page_id bigint, url string, is_full_content boolean",
    )
    full = spark.createDataFrame(
        [("f1", 200, "full"), ("f2", 200, "<SYSTEM>x</SYSTEM>"), ("n", 200, "not used"), ("f6", 500, "gone")],
        "url string, status int, body string",
    )
    native = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "page_id bigint, body string")
    html = spark.createDataFrame(
        [(2, "h2", None), (3, "h3", None), (4, "", None), (5, None, "no area"), (6, "h6", None)],
        "page_id bigint, markdown string, error string",
    )
    rows = bodies.pick_body(plan, full, native, html, use_native=native_on).collect()
    assert {r.page_id: (r.source, r.body, r.error) for r in rows} == {
        1: ("full", "full", None),
        2: ("html", "h2", None),
        3: ("native", "n3", None) if native_on else ("html", "h3", None),
        4: ("html", "", None),
        5: (None, None, "no area"),
        6: ("html", "h6", None),
    }


LOG = "page_id bigint, url string, attempt int, at_ms bigint, status int, error string"


def test_outcomes(spark):
    log = spark.createDataFrame(
        [
            (1, "a", 0, 5, None, "timeout"), (1, "a", 1, 9, 200, None),
            (2, "b", 0, 1, 503, None), (3, "c", 0, 1, None, "boom"), (4, "d", 0, 1, 200, None),
        ],
        LOG,
    )
    areas = spark.createDataFrame([(1, None), (4, "no area")], "page_id bigint, error string")
    got = {r.page_id: (r.outcome, r.error, r.done_ms) for r in reports.fetch_outcomes(log, areas).collect()}
    assert got == {
        1: ("success", None, 9),
        2: ("http_error", "HTTP 503", 1),
        3: ("exception", "boom", 1),
        4: ("no_content", "no area", 1),
    }


RETRYABLE = [
    "Timeout", "connect ETIMEDOUT", "econnreset", "ECONNREFUSED 1.2.3.4", "getaddrinfo ENOTFOUND",
    "HTTP 429", "http 500", "HTTP 502", "HTTP 503: x", "HTTP 504",
]


def test_retryable_tokens(spark):
    log = spark.createDataFrame(
        [(n, "u", 0, 0, None, e) for n, e in enumerate([*RETRYABLE, "HTTP 404", "bad certificate", ""])],
        LOG,
    )
    got = [r.n_retryable for r in reports.retry_audit(log).orderBy("page_id").collect()]
    assert got == [1] * 10 + [0] * 3


def test_retry_audit(spark):
    def errors(page, *texts, ok=False):
        rows = [(page, "u", k, 0, None, t) for k, t in enumerate(texts)]
        return rows + ([(page, "u", len(texts), 0, 200, None)] if ok else [])

    log = spark.createDataFrame(
        errors(1, "timeout", "timeout", ok=True)
        + errors(2, "timeout", "timeout", "timeout", "timeout")
        + errors(3, "bad certificate", ok=True)
        + errors(4, "bad certificate")
        + [(5, "u", 0, 0, 503, "HTTP 503")],
        LOG,
    )
    got = {r.page_id: r for r in reports.retry_audit(log, base_ms=100).collect()}
    assert [(got[n].n_attempts, got[n].backoff_ms) for n in (1, 2, 3, 4, 5)] == [
        (3, 300), (4, 700), (2, 100), (1, 0), (1, 0)
    ]
    assert [got[n].gave_up for n in (1, 2, 3, 4, 5)] == [False, True, False, True, False]
    assert [got[n].broke_rule for n in (1, 2, 3, 4, 5)] == [False, False, True, False, False]
    assert got[5].http_only == 1 and got[5].n_retryable == 0


def test_summary_percent_and_failures(spark):
    plan = spark.createDataFrame([("s", n) for n in range(100)], "site string, page_id bigint")
    outcomes = spark.createDataFrame(
        [(n, f"u{n}", "success" if n % 2 else "http_error", None if n % 2 else f"e{n}", 100 - n) for n in range(29)],
        "page_id bigint, url string, outcome string, error string, done_ms bigint",
    )
    assert tuple(reports.run_summary(plan, outcomes).first()) == ("s", 100, 29, 14, 15, 0, 28)
    failed = reports.failure_report(plan, outcomes).collect()
    assert [r.page_id for r in failed] == list(range(28, -1, -2))
    listing = spark.createDataFrame([("s", 7)], "domain string, n_files bigint")
    summary = reports.run_summary(plan, outcomes)
    report = reports.run_report(summary, outcomes, plan, listing, "./out/").first()
    assert (report.finished, report.n_files, report.output_directory) == (False, 7, "./out/s")
    assert report.duration_ms == 28


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            ("https://www.a.com/1", "Same Name", "old", 1),
            ("https://a.com/2", "same.name", "new", 2),
            ("https://a.com/3", "Other", "x", 3),
            ("https://b.com/4", "中文", "y", 4),
            ("https://b.com/5", "lost", None, 5),
        ],
        "url string, title string, body string, ord int",
    )
    path = str(tmp_path / "corpus")
    write_corpus(docs, path, ["ord"])
    got = {(r.domain, r.slug): (r.url, r.body) for r in read_corpus(spark, path).collect()}
    assert got == {
        ("a.com", "same_name"): ("https://a.com/2", "new"),
        ("a.com", "other"): ("https://a.com/3", "x"),
        ("b.com", ""): ("https://b.com/4", "y"),
    }
    listing = {r.domain: r.n_files for r in list_corpus(spark, path).collect()}
    assert listing == {"a.com": 2, "b.com": 1}
    export_text(read_corpus(spark, path), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).where("value = 'new'").count() == 1
    taken = naming.name_collisions(docs, ["ord"]).collect()
    assert [(r.domain, r.slug, r.n, r.kept_url) for r in taken] == [
        ("a.com", "same_name", 2, "https://a.com/2")
    ]


def test_scratch_follows_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two
    assert shared is None or one.startswith(f"{shared}/x-")


def test_captured(spark):
    df = spark.createDataFrame([(1, "x", 200), (2, "y", 404), (3, "z", None)], "page_id int, html string, status int")
    assert [r.ok for r in captured(df).orderBy("page_id").collect()] == [True, False, False]
    assert captured(df.drop("status")).where("ok").count() == 3
