"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.urls import domain, path_title
from corpusloom.operators import bodies, manifest, naming, reports, runs
from corpusloom.operators.content import content_area
from corpusloom.operators.links import absolute_links, extract_links, follow_links
from corpusloom.operators.markdown import html_to_markdown
from corpusloom.operators.selectors import select_nodes, with_parents
from corpusloom.operators.skeleton import html_skeleton, skeleton_preview
from corpusloom.operators.tokens import page_nodes, page_tokens
from corpusloom.plans.build import plan_jobs
from corpusloom.plans.crawl import crawl_preview
from corpusloom.plans.settings import apply_mode, effective_config
from corpusloom.sources.captures import as_site_config, read_site_config
from corpusloom.sources.corpus import list_corpus, read_corpus, write_corpus
from corpusloom.sources.scratch import scratch_path, stored
from corpusloom.verify.fixtures import Inputs

NAV_LINKS = "nav a"
OUTPUT_DIR = "./corpus"

Query = Callable[[Inputs], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _register(fn: Query) -> Query:
    _REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: bind(fn) for name, fn in _REGISTRY.items()}


# --- sources, lookups, sinks ---------------------------------------------------


@_register
def page_scan(i: Inputs) -> DataFrame:
    return i.pages.select("page_id", "url", "html")


@_register
def manifest_lookup(i: Inputs) -> DataFrame:
    return bodies.lookup_manifests(i.derived("jobs"), i.derived("captured_manifests"))


@_register
def native_md_probe(i: Inputs) -> DataFrame:
    return bodies.probe_native_md(i.derived("sheets"), i.derived("md_bodies"))


def _titled_documents(i: Inputs) -> DataFrame:
    """The text of every document, titled by the path of its page."""
    titled = i.derived("sheets").select("page_id", "url", path_title(F.col("url")).alias("title"))
    texts = i.documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
    return titled.join(texts, "page_id")


def _written(i: Inputs) -> str:
    path = scratch_path(i.spark, "corpus")
    write_corpus(_titled_documents(i), path, ["page_id"])
    return path


@_register
def corpus_write(i: Inputs) -> DataFrame:
    return read_corpus(i.spark, _written(i))


@_register
def corpus_listing(i: Inputs) -> DataFrame:
    return list_corpus(i.spark, _written(i))


@_register
def site_config_scan(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "site-config")
    i.derived("site_config").write.json(path)
    return read_site_config(i.spark, path)


# --- URLs and names --------------------------------------------------------------


@_register
def domain_rollup(i: Inputs) -> DataFrame:
    return naming.domain_rollup(i.pages)


@_register
def md_candidates(i: Inputs) -> DataFrame:
    return bodies.candidate_urls(i.pages)


@_register
def name_collisions(i: Inputs) -> DataFrame:
    links = follow_links(i.pages, NAV_LINKS)
    return naming.name_collisions(links, ["page_id", "ord"])


@_register
def path_titles(i: Inputs) -> DataFrame:
    return naming.path_titles(i.pages)


@_register
def resolve_links(i: Inputs) -> DataFrame:
    links = absolute_links(extract_links(i.pages, NAV_LINKS), i.pages)
    return links.select("page_id", "ord", "href", "url")


# --- page structure --------------------------------------------------------------


@_register
def page_tokens_(i: Inputs) -> DataFrame:
    tokens = page_tokens(i.pages).where(F.col("pos").isNotNull())
    return tokens.select("page_id", "pos", "tok", "tag", "kind")


@_register
def page_nodes_(i: Inputs) -> DataFrame:
    nodes = with_parents(page_nodes(page_tokens(i.derived("structured"))))
    return nodes.select(
        "page_id", "pos", "end_pos", "parent_pos", "depth", "tag", "id", "classes", "role", "href"
    )


@_register
def select_nodes_(i: Inputs) -> DataFrame:
    return select_nodes(page_tokens(i.pages), "nav li > a, article p, .ad, a[href^='/th']")


@_register
def extract_links_(i: Inputs) -> DataFrame:
    return extract_links(i.pages, NAV_LINKS)


@_register
def follow_links_(i: Inputs) -> DataFrame:
    return follow_links(i.pages, NAV_LINKS)


@_register
def content_area_(i: Inputs) -> DataFrame:
    return content_area(i.pages, "article b")


@_register
def html_to_markdown_(i: Inputs) -> DataFrame:
    return html_to_markdown(i.pages, "body").select("page_id", "markdown")


@_register
def html_skeleton_(i: Inputs) -> DataFrame:
    return html_skeleton(i.derived("structured"))


@_register
def skeleton_preview_(i: Inputs) -> DataFrame:
    return skeleton_preview(html_skeleton(i.derived("structured")))


# --- manifests -------------------------------------------------------------------


@_register
def manifest_lines(i: Inputs) -> DataFrame:
    return manifest.manifest_lines(i.derived("manifest_texts"))


@_register
def manifest_header(i: Inputs) -> DataFrame:
    return manifest.manifest_header(i.derived("manifest_texts"))


@_register
def manifest_details(i: Inputs) -> DataFrame:
    return manifest.manifest_details(i.derived("manifest_texts"))


@_register
def manifest_sections(i: Inputs) -> DataFrame:
    return manifest.manifest_sections(i.derived("manifest_texts"))


@_register
def manifest_links(i: Inputs) -> DataFrame:
    return manifest.manifest_links(i.derived("manifest_texts"))


@_register
def manifest_page_links(i: Inputs) -> DataFrame:
    return manifest.manifest_page_links(manifest.classified_links(i.derived("manifest_texts")))


@_register
def manifest_stats(i: Inputs) -> DataFrame:
    return manifest.manifest_stats(manifest.classified_links(i.derived("manifest_texts")))


@_register
def manifest_section_stats(i: Inputs) -> DataFrame:
    links = manifest.classified_links(i.derived("manifest_texts"))
    return manifest.manifest_section_stats(links)


@_register
def manifest_check(i: Inputs) -> DataFrame:
    found = bodies.lookup_manifests(i.derived("jobs"), i.derived("captured_manifests"))
    # Nested values as text, which any engine compares alike.
    return manifest.manifest_check(found).withColumn("sections", F.to_json("sections"))


# --- planning --------------------------------------------------------------------


def _config(i: Inputs) -> DataFrame:
    return effective_config(
        i.derived("jobs"), i.derived("overrides"), as_site_config(i.derived("site_config"))
    )


def _ready_jobs(i: Inputs) -> DataFrame:
    return apply_mode(_config(i))


def _jobs_and_plan(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Jobs and their page lists; what several steps read is written once."""
    jobs = stored(_ready_jobs(i), "jobs")
    pages = i.derived("captures").drop("site")
    return jobs, plan_jobs(jobs, i.derived("captured_manifests"), pages)


@_register
def effective_config_(i: Inputs) -> DataFrame:
    return _config(i)


@_register
def mode_rules(i: Inputs) -> DataFrame:
    return _ready_jobs(i).select("site", "mode", "follow_selector", "use_manifest", "error")


@_register
def crawl_plan_(i: Inputs) -> DataFrame:
    return _jobs_and_plan(i)[1]


@_register
def crawl_preview_(i: Inputs) -> DataFrame:
    jobs, plan = _jobs_and_plan(i)
    return crawl_preview(jobs, stored(plan, "plan"))


# --- bodies and reports ------------------------------------------------------------


@_register
def full_content_clean(i: Inputs) -> DataFrame:
    texts = i.derived("full_bodies")
    return texts.select("url", bodies.clean_full_content(F.col("body")).alias("body"))


@_register
def native_md_filter(i: Inputs) -> DataFrame:
    """Which documents and pages would pass as Markdown answers."""
    docs = i.documents.select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body")
    )
    pages = i.pages.select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body")
    )
    usable = bodies.usable_md(F.lit(200), F.col("body")).alias("usable")
    return docs.unionByName(pages).select("origin", "id", usable)


def _picked(i: Inputs) -> DataFrame:
    native = bodies.probe_native_md(i.derived("sheets"), i.derived("md_bodies"))
    native = stored(native, "native")  # asked twice: who has one, and which
    plan, full = i.derived("planned"), i.derived("full_bodies")
    left = stored(bodies.pages_left_to_html(plan, full, native), "left-to-html")
    html = html_to_markdown(i.pages.join(left, "page_id", "left_semi"), "article")
    return bodies.pick_body(plan, full, native, html)


@_register
def pick_body(i: Inputs) -> DataFrame:
    return _picked(i).select("page_id", "url", "source", "body")


def _outcomes(i: Inputs) -> DataFrame:
    return reports.fetch_outcomes(i.derived("fetch_attempts"), content_area(i.pages, "article b"))


def _plan_by_domain(i: Inputs) -> DataFrame:
    return i.pages.select(domain(F.col("url")).alias("site"), "page_id")


@_register
def fetch_outcomes(i: Inputs) -> DataFrame:
    return _outcomes(i)


@_register
def retry_audit(i: Inputs) -> DataFrame:
    return reports.retry_audit(i.derived("fetch_attempts"))


@_register
def run_summary(i: Inputs) -> DataFrame:
    return reports.run_summary(_plan_by_domain(i), _outcomes(i))


@_register
def failure_report(i: Inputs) -> DataFrame:
    return reports.failure_report(_plan_by_domain(i), _outcomes(i))


@_register
def run_report(i: Inputs) -> DataFrame:
    plan, outcomes = _plan_by_domain(i), _outcomes(i)
    listing = list_corpus(i.spark, _written(i))
    summary = reports.run_summary(plan, outcomes)
    return reports.run_report(summary, outcomes, plan, listing, OUTPUT_DIR)


def _run_state(i: Inputs) -> DataFrame:
    """From jobs and what they take over the bodies found to a state per page."""
    taken = i.derived("host_pages").join(i.derived("host_jobs").select("site", "domain"), "site")
    found = _picked(i).select("page_id", "source", "body", "error")
    return runs.run_state(taken.join(found, "page_id"), i.derived("fetch_attempts"))


@_register
def run_state(i: Inputs) -> DataFrame:
    return _run_state(i)


@_register
def job_report(i: Inputs) -> DataFrame:
    state = stored(_run_state(i), "run-state")
    return runs.job_report(i.derived("host_jobs"), state)
