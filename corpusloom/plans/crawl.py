"""Which pages each job takes: manifest links, followed links, or the page itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import corpus_folder
from corpusloom.functions.urls import path_title
from corpusloom.operators.links import follow_links
from corpusloom.operators.own_selectors import OwnSelectors, asked_pages, is_supported
from corpusloom.operators.selectors import parse_selector
from corpusloom.plans.settings import wants_links
from corpusloom.sources.captures import captured, newest


def selectors_in_use(jobs: DataFrame, column: str, given: list[str] | None = None) -> list[str]:
    """The selectors in `column` of jobs without an error.

    With `given`, all of them must be in it: no job is left out without a word.
    """
    used = jobs.where(wants_links(F.col(column)))
    if "error" in jobs.columns:
        used = used.where(F.col("error").isNull())
    found = sorted(r[0] for r in used.select(column).distinct().collect())
    if given is not None and not set(found) <= set(given):
        raise ValueError(f"jobs use other {column}s than given: {sorted(set(found) - set(given))}")
    return found


def checked_selectors(jobs: DataFrame) -> DataFrame:
    """Give jobs whose follow or content selector is not supported an `error`, row by row."""
    for column in ("follow_selector", "content_selector"):
        selector = F.col(column)
        text = F.concat(F.lit("unsupported selector: "), selector)
        wrong = wants_links(selector) & ~is_supported(selector)
        jobs = jobs.withColumn("error", F.coalesce("error", F.when(wrong, text)))
    return jobs


def check_given(selectors: list[str] | None, table: DataFrame, column: str) -> None:
    """Raise where a given list of selectors is not supported or lacks one in use."""
    if selectors is not None:
        for selector in selectors:
            parse_selector(selector)
        selectors_in_use(table, column, selectors)


def followed_pages(
    jobs: DataFrame, pages: DataFrame, selectors: list[str] | None = None
) -> DataFrame:
    """(site, ord, url, title) linked from each job's entry page.

    Entry pages are read once, whatever the jobs' follow selectors are: each page brings
    those that are asked of it. Selectors that are not supported raise (see
    `checked_selectors`), as do those beyond a given list. Entry pages are matched by
    URL, the newest answered capture counts; a page that did not answer gives no links.
    """
    check_given(selectors, jobs, "follow_selector")
    asking = jobs.where(wants_links(F.col("follow_selector")))
    if "error" in jobs.columns:
        asking = asking.where(F.col("error").isNull())
    asking = asking.select("site", F.col("base_url").alias("url"), F.col("follow_selector").alias("selector"))
    entries, known = taken_pages(pages, asking.select("url").distinct())
    owners = known.join(asking, "url").select("site", F.struct("page_id", "selector").alias("page_id"))
    own = OwnSelectors.of(asking, "selector")
    asked = known.join(asking.select("url", "selector").distinct(), "url")
    units = asked_pages(entries, asked.select("page_id", "selector"))
    urls = asked.select(F.struct("page_id", "selector").alias("page_id"), "url")
    links = follow_links(units, own, urls=urls)
    return links.join(owners, "page_id").select("site", "ord", "url", "title")


def taken_pages(pages: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest answered capture of each of `urls`, and their (page_id, url).

    URLs are matched without the markup, which then meets the few page ids.
    """
    answered = captured(pages).where("ok")
    matched = answered.join(urls, "url", "left_semi")
    last = F.max_by("page_id", newest(answered, "page_id")).alias("page_id")
    known = matched.groupBy("url").agg(last).select("page_id", "url")
    wanted = answered.select("page_id", "html").join(known.select("page_id"), "page_id", "left_semi")
    return wanted, known


def crawl_plan(jobs: DataFrame, manifest_links: DataFrame, links: DataFrame) -> DataFrame:
    """(site, source, ord, url, title, is_full_content) of every page to take.

    Manifest links win where a job uses manifests and has any; else followed links
    where a selector is set, even if none is found; else the page itself. Jobs with
    an error take nothing. Jobs and manifest links are read more than once: pass
    stored tables.
    """
    ready = jobs.where(F.col("error").isNull())
    listed = manifest_links.join(ready.where("use_manifest").select("site"), "site", "left_semi")
    left = ready.join(listed.select("site").distinct(), "site", "left_anti")
    follows = wants_links(F.col("follow_selector"))
    followed = links.join(left.where(follows).select("site"), "site", "left_semi")
    single = left.where(~follows)
    return (
        listed.select(
            "site", F.lit("manifest").alias("source"), "ord", "url", "title", "is_full_content"
        )
        .unionByName(
            followed.select(
                "site",
                F.lit("follow").alias("source"),
                "ord",
                "url",
                "title",
                F.lit(False).alias("is_full_content"),
            )
        )
        .unionByName(
            single.select(
                "site",
                F.lit("single").alias("source"),
                F.lit(1).alias("ord"),
                F.col("base_url").alias("url"),
                path_title(F.col("base_url")).alias("title"),
                F.lit(False).alias("is_full_content"),
            )
        )
    )


def crawl_preview(jobs: DataFrame, plan: DataFrame) -> DataFrame:
    """Numbered page list per site with the settings in effect; reads no bodies.

    `ord` of a plan counts each site's pages from 1 already, so only the totals
    are aggregated, with partial counts, and joined back.
    """
    totals = plan.groupBy("site").agg(F.count("*").alias("total_pages"))
    settings = jobs.join(totals, "site")
    mode = F.when(F.col("source") == "manifest", "auto").otherwise(F.col("source"))
    return plan.join(settings.drop("error", "mode"), "site").select(
        "site",
        F.col("ord").alias("n"),
        "title",
        "url",
        "total_pages",
        mode.alias("mode"),
        "content_selector",
        corpus_folder(F.col("output_dir"), F.col("domain")).alias("output_directory"),
        "use_native_md",
    )
