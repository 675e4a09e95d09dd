from pyspark.sql import functions as F

from corpusloom.operators import runs
from corpusloom.plans.build import build_documents, plan_jobs
from corpusloom.plans.settings import apply_mode, effective_config
from corpusloom.sources.captures import as_site_config
from corpusloom.sources.corpus import list_corpus, read_corpus, write_corpus
from corpusloom.sources.scratch import stored


def test_jobs_to_corpus(spark, tmp_path):
    page = "<body><nav><a href={}>{}</a></nav><main><h1>{}</h1></main></body>"
    pages = spark.createDataFrame(
        [
            (1, "https://m.com/a", page.format("/n", "n", "A"), 200),
            (2, "https://f.com/", page.format("https://x.org/far", "Far away", "F"), 200),
            (3, "https://x.org/far", page.format("/", "n", "Far"), 200),
            (4, "https://s.com/only/", "<body>no main</body>", 200),
            (5, "https://m.com/b", page.format("/n", "n", "B"), 200),
            (6, "https://m.com/gone", page.format("/n", "n", "Gone"), 404),
        ],
        "page_id bigint, url string, html string, status int",
    )
    manifests = spark.createDataFrame(
        [("https://m.com/llms.txt", 200, "# M\n## D\n- [A](/a)\n- [B](/b)\n- [All](/all.txt)\n- [Gone](/gone)")],
        "manifest_url string, status int, content string",
    )
    jobs = spark.createDataFrame(
        [("m", "https://www.m.com/", "auto"), ("m2", "https://m.com/docs", "auto"),
         ("f", "https://f.com/", "follow"), ("s", "https://s.com/only/", "single")],
        "site string, base_url string, mode string",
    )
    overrides = spark.createDataFrame(
        [("f", "nav a")], "site string, follow_selector string"
    ).withColumns({c: F.lit(None) for c in (
        "content_selector", "output_dir", "no_native_md", "no_manifest", "with_optional")})
    config = as_site_config(
        spark.createDataFrame(
            [("m.com", "main", True), ("f.com", "main", False), ("s.com", "main", None)],
            "domain string, content_selector string, use_native_md boolean",
        )
    )
    md = spark.createDataFrame(
        [("https://m.com/b.md", 200, "native body of b"), ("https://x.org/far.md", 200, "not asked for")],
        "md_url string, status int, body string",
    )
    full = spark.createDataFrame(
        [("https://m.com/all.txt", 200, "<SYSTEM>s</SYSTEM>everything")],
        "url string, status int, body string",
    )
    ready = stored(apply_mode(effective_config(jobs, overrides, config)), "jobs")
    plan = plan_jobs(ready, manifests, pages, ["nav a"])
    docs = build_documents(ready, plan, pages, md, full, ["main"])
    got = {(r.site, r.ord): (r.source, r.body, r.error) for r in docs.collect()}
    assert got == {
        ("m", 1): (None, None, "no body captured"),  # the bare host has no capture of its own
        ("m2", 1): ("html", "# A", None),
        ("m2", 2): ("native", "native body of b", None),
        ("m2", 3): ("full", "everything", None),
        ("m2", 4): (None, None, "HTTP 404"),
        ("f", 1): ("html", "# Far", None),
        ("s", 1): (None, None, "content area not found: main"),
    }
    path = str(tmp_path / "out")
    write_corpus(docs, path, ["ord"])
    assert {(r.domain, r.slug) for r in read_corpus(spark, path).collect()} == {
        ("m.com", "a"), ("m.com", "b"), ("m.com", "all"), ("f.com", "far_away")
    }
    assert {r.domain: r.n_files for r in list_corpus(spark, path).collect()} == {"m.com": 3, "f.com": 1}
    log = spark.createDataFrame(
        [("https://m.com/a", 0, 10, None, "timeout"), ("https://m.com/a", 1, 50, 200, None),
         ("https://m.com/b", 0, 20, 404, None), ("https://s.com/only/", 0, 30, None, None)],
        "url string, attempt int, at_ms bigint, status int, error string",
    )
    state = stored(runs.run_state(docs, log), "state")
    assert {(r.site, r.ord): (r.source, r.outcome, r.error, r.done_ms) for r in state.collect()} == {
        ("m", 1): (None, None, "no body captured", None),
        ("m2", 1): ("html", "success", None, 50),
        ("m2", 2): ("native", "success", None, 20),  # the page itself was refused
        ("m2", 3): ("full", "success", None, None),
        ("m2", 4): (None, "http_error", "HTTP 404", None),
        ("f", 1): ("html", "success", None, None),
        ("s", 1): (None, "exception", "unknown error", 30),
    }
    report = {r.site: r for r in runs.job_report(ready, state).collect()}
    counts = {s: (r.succeeded, r.n_files, r.total, r.completed, r.success, r.failed, r.duration_ms)
              for s, r in report.items()}
    assert counts == {
        "m": (True, 0, 1, 0, 0, 0, None),
        "m2": (True, 3, 4, 4, 3, 1, 30),
        "f": (True, 1, 1, 1, 1, 0, None),
        "s": (True, 0, 1, 1, 0, 1, 0),
    }
    assert sum(r.n_files for r in report.values()) == read_corpus(spark, path).count()
    assert report["m2"].output_directory.endswith("/m.com")
    files = runs.job_files(ready, state).collect()
    assert {(r.site, r.path.rsplit("/", 2)[-2], r.path.rsplit("/", 1)[1]) for r in files} == {
        ("m2", "m.com", "a.md"), ("m2", "m.com", "b.md"), ("m2", "m.com", "all.md"),
        ("f", "f.com", "far_away.md"),
    }
    assert {(r.site, r.url, r.error) for r in runs.job_errors(state).collect()} == {
        ("m2", "https://m.com/gone", "HTTP 404"), ("s", "https://s.com/only/", "unknown error")
    }


def test_names_shared_by_jobs_and_refused_jobs(spark):
    schema = "site string, domain string, ord bigint, url string, title string, source string, body string, error string"
    docs = spark.createDataFrame(
        [("a", "x.com", 1, "u1", "Same", "html", "t", None), ("b", "x.com", 2, "u1", "same", "html", "t", None),
         ("b", "y.com", 3, "u2", "Same", "html", "t", None), ("a", "x.com", 4, "u3", "Same", None, None, "no area")],
        schema,
    )
    jobs = spark.createDataFrame(
        [("a", "x.com", "o", None), ("b", "x.com", "o/", None), ("c", "z.com", "o", "refused")],
        "site string, domain string, output_dir string, error string",
    )
    log = spark.createDataFrame([], "url string, attempt int, at_ms bigint, status int, error string")
    state = runs.run_state(docs, log)
    assert {(r.site, r.ord): r.outcome for r in state.collect()} == {
        ("a", 1): "success", ("b", 2): "success", ("b", 3): "success", ("a", 4): "no_content"
    }
    got = {r.site: (r.succeeded, r.error, r.output_directory, r.n_files, r.total, r.failed)
           for r in runs.job_report(jobs, state).collect()}
    assert got == {
        "a": (True, None, "o/x.com", 0, 2, 1),
        "b": (True, None, "o/x.com", 2, 2, 0),
        "c": (False, "refused", "o/z.com", 0, 0, 0),
    }
    empty = runs.run_state(docs.limit(0), log)
    assert {r.site: r.total for r in runs.job_report(jobs, empty).collect()} == {"a": 0, "b": 0, "c": 0}
