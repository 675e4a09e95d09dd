"""Which body a page gets: cleaned full text, a native Markdown sibling, or its HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.layout import computed
from corpusloom.functions.text import JS_SPACE, js_trim
from corpusloom.functions.urls import md_candidates, origin
from corpusloom.sources.captures import fetched, is_ok, newest_answers
from corpusloom.sources.scratch import stored

# Where a site keeps its manifest, how short a body may be.
MANIFEST_PATH = "/llms.txt"
MIN_BODY = 10
HTML_STARTS = ["<!DOCTYPE", "<html"]

NOT_CAPTURED = "no body captured"


def lookup_manifests(sites: DataFrame, manifests: DataFrame) -> DataFrame:
    """(site, base_url, manifest_url, content, usable) per site.

    A manifest is looked up at its origin. Its newest answered capture counts; it is usable
    if its trimmed text has at least 10 characters. Texts join last, only usable ones.
    """
    wanted = computed(
        sites.select("site", "base_url"),
        manifest_url=F.concat(origin(F.col("base_url")), F.lit(MANIFEST_PATH)),
    )
    usable = F.coalesce(F.length(js_trim(F.col("content"))) >= MIN_BODY, F.lit(False))
    last = newest_answers(manifests, "manifest_url", "content", True, _usable=usable).where("_usable")
    texts = fetched(last.drop("_usable"), manifests, "manifest_url", "content", "manifest_url")
    found = wanted.join(texts, "manifest_url", "left")
    return found.select(
        "site", "base_url", "manifest_url", "content", F.col("content").isNotNull().alias("usable")
    )


def clean_full_content(body: Column) -> Column:
    """Drop system notes with the space behind them, then trim."""
    return js_trim(F.regexp_replace(body, f"(?s)<SYSTEM>.*?</SYSTEM>[{JS_SPACE}]*", ""))


def usable_md(status: Column, body: Column) -> Column:
    """Whether an answer is Markdown: ok, no HTML page, at least 10 characters."""
    start = js_trim(body)
    html = start.startswith(HTML_STARTS[0]) | start.startswith(HTML_STARTS[1])
    return is_ok(status) & F.coalesce(~html & (F.length(body) >= MIN_BODY), F.lit(False))


def candidate_urls(pages: DataFrame) -> DataFrame:
    """(page_id, rank, md_url): Markdown siblings of each page, best first."""
    return pages.select("page_id", F.posexplode(md_candidates(F.col("url"))).alias("rank", "md_url"))


def probe_native_md(pages: DataFrame, md_bodies: DataFrame) -> DataFrame:
    """(page_id, md_url, rank, body): the first candidate that answers with Markdown.

    Of several captures of a URL the newest answered one counts. Matching moves narrow rows
    only: candidates meet the URLs whose newest answer is Markdown, each page keeps its best
    one, and that table is written. Bodies join it last, plain table to plain table, so that
    adaptive execution can split a URL that very many pages share.
    """
    usable = usable_md(F.lit(200), F.col("body"))
    last = newest_answers(md_bodies, "md_url", "body", _usable=usable).where("_usable")
    best = (
        candidate_urls(pages)
        .join(last.drop("_usable"), "md_url")
        .groupBy("page_id")
        .agg(F.min(F.struct("rank", "md_url", "_at", "_digest", "_copies")).alias("_best"))
    )
    best = stored(best.select("page_id", "_best.*"), "native-matches")
    return fetched(best, md_bodies, "md_url", "body", "page_id").select(
        "page_id", "md_url", "rank", "body"
    )


def _full_bodies(full: DataFrame) -> DataFrame:
    """(url, _full): the cleaned full text of each URL; of several captures the newest answered."""
    texts = fetched(newest_answers(full, "url", "body", True), full, "url", "body", "url")
    return computed(texts, _full=clean_full_content(F.col("body"))).drop("body")


def pages_left_to_html(
    plan: DataFrame, full: DataFrame, native: DataFrame, use_native: bool | str = True
) -> DataFrame:
    """page_id of planned pages without a full or native body: only those need conversion.

    Takes what `pick_body` takes; decided on ids and URLs, no body moves for it.
    """
    native_on = F.col(use_native) if isinstance(use_native, str) else F.lit(use_native)
    is_full = F.col("is_full_content")
    left_over = F.coalesce(clean_full_content(F.col("body")) != "", F.lit(False))
    there = newest_answers(full, "url", "body", True, _left=left_over).where("_left").select("url")
    emptied = plan.where(is_full).join(there, "url", "left_anti").select("page_id")
    others = plan.where(~is_full).select("page_id", native_on.alias("_on"))
    asked = others.where("_on").join(native.select("page_id"), "page_id", "left_anti")
    return emptied.union(asked.select("page_id")).union(others.where(~F.col("_on")).select("page_id"))


def pick_body(
    plan: DataFrame,
    full: DataFrame,
    native: DataFrame,
    html: DataFrame,
    use_native: bool | str = True,
) -> DataFrame:
    """(page_id, url, source, body, error) of every planned page.

    plan (page_id, url, is_full_content); full (url, status, body);
    native (page_id, body); html (page_id, markdown, error). Full-content pages
    never take a native body; they fall back to HTML if nothing is left of theirs.
    `use_native` may name a column of the plan. `native` and `html` have one row per
    page.
    """
    native_on = F.col(use_native) if isinstance(use_native, str) else F.lit(use_native)
    cleaned = _full_bodies(full)
    is_full = F.col("is_full_content")
    joined = (
        plan.join(cleaned, "url", "left")
        .join(native.select("page_id", F.col("body").alias("_native")), "page_id", "left")
        .join(html.select("page_id", "markdown", "error"), "page_id", "left")
    )
    source = (
        F.when(is_full & (F.col("_full") != ""), "full")
        .when(~is_full & native_on & F.col("_native").isNotNull(), "native")
        .when(F.col("markdown").isNotNull(), "html")
    )
    picked = joined.withColumn("source", source)
    chosen = F.col("source")
    return picked.select(
        "page_id",
        "url",
        "source",
        F.when(chosen == "full", F.col("_full"))
        .when(chosen == "native", F.col("_native"))
        .when(chosen == "html", F.col("markdown"))
        .alias("body"),
        F.when(chosen.isNull(), F.coalesce("error", F.lit(NOT_CAPTURED))).alias("error"),
    )
