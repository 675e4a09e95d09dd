"""From crawl jobs to documents: the whole way over captured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bodies import (
    lookup_manifests,
    pages_left_to_html,
    pick_body,
    probe_native_md,
)
from corpusloom.operators.manifest import classified_links, manifest_page_links
from corpusloom.operators.markdown import html_to_markdown
from corpusloom.operators.own_selectors import OwnSelectors, asked_pages
from corpusloom.plans.crawl import check_given, crawl_plan, followed_pages, taken_pages
from corpusloom.plans.settings import wants_links
from corpusloom.sources.captures import captured, newest
from corpusloom.sources.scratch import stored


def plan_jobs(
    jobs: DataFrame,
    manifests: DataFrame,
    pages: DataFrame,
    follow_selectors: list[str] | None = None,
) -> DataFrame:
    """Page lists of jobs with settings (see `apply_mode`); jobs should be a stored table.

    manifests (manifest_url, status, content); pages (page_id, url, html).
    """
    asking = jobs.where(F.col("error").isNull() & F.col("use_manifest"))
    sites = asking.select("site", "base_url", "include_optional")
    usable = lookup_manifests(sites, manifests).where("usable")
    wanted = usable.join(sites.drop("base_url"), "site")
    classified = classified_links(wanted, "include_optional")
    listed = stored(manifest_page_links(classified), "manifest-links")
    return crawl_plan(jobs, listed, followed_pages(jobs, pages, follow_selectors))


def converted_pages(
    plan: DataFrame, pages: DataFrame, content_selectors: list[str] | None = None
) -> DataFrame:
    """(content_selector, url, markdown, error) of planned pages, once per selector asked.

    The pages are read and split once, whatever the selectors are.

    Where captures carry a status, pages that did not answer give `HTTP <status>`.
    """
    check_given(content_selectors, plan, "content_selector")
    asking = plan.where(wants_links(F.col("content_selector")))
    asking = asking.select("url", F.col("content_selector").alias("selector")).distinct()
    taken, known = taken_pages(pages, asking.select("url").distinct())
    own = OwnSelectors.of(asking, "selector")
    asked = known.join(asking, "url")
    units = asked_pages(taken, asked.select("page_id", "selector"))
    urls = asked.select(F.struct("page_id", "selector").alias("page_id"), "url")
    markdown = html_to_markdown(units, own).join(urls, "page_id")
    converted = markdown.select(
        F.col("page_id")["selector"].alias("content_selector"), "url", "markdown", "error"
    )
    if "status" in pages.columns:
        seen = captured(pages)
        wanted = plan.select("content_selector", "url").distinct()
        tried = seen.where(~F.col("ok")).join(wanted, "url", "left_semi")
        refused = tried.groupBy("url").agg(F.max_by("status", newest(seen, "page_id")).alias("status"))
        refused = refused.join(seen.where("ok").select("url"), "url", "left_anti").select(
            "url",
            F.lit(None).cast("string").alias("markdown"),
            F.concat(F.lit("HTTP "), F.col("status").cast("string")).alias("error"),
        )
        converted = converted.unionByName(wanted.join(refused, "url"))
    return converted


def build_documents(
    jobs: DataFrame,
    plan: DataFrame,
    pages: DataFrame,
    md_bodies: DataFrame,
    full_bodies: DataFrame,
    content_selectors: list[str] | None = None,
) -> DataFrame:
    """(site, domain, ord, url, title, source, body, error) of every planned page.

    Documents belong to their job's domain, also where a link leads elsewhere. Rows
    without body carry the error. Write the result with `write_corpus`.
    """
    settings = jobs.select("site", "domain", "content_selector", "use_native_md")
    rows = stored(
        plan.join(settings, "site").withColumn("page_id", F.struct("site", "ord")), "planned"
    )
    asking = rows.where(F.col("use_native_md") & ~F.col("is_full_content"))
    native = probe_native_md(asking.select("page_id", "url"), md_bodies)
    taken = rows.select("page_id", "url", "is_full_content", "use_native_md")
    left = pages_left_to_html(taken, full_bodies, native, use_native="use_native_md")
    to_convert = rows.join(left, "page_id", "left_semi")
    html = to_convert.select("page_id", "content_selector", "url").join(
        converted_pages(to_convert, pages, content_selectors), ["content_selector", "url"]
    )
    picked = pick_body(
        taken,
        full_bodies,
        native,
        html.select("page_id", "markdown", "error"),
        use_native="use_native_md",
    )
    return picked.join(rows.select("page_id", "site", "domain", "ord", "title"), "page_id").select(
        "site", "domain", "ord", "url", "title", "source", "body", "error"
    )
