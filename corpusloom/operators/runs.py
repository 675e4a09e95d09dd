"""The state of a run, a row per job and page, and what is reported from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import corpus_folder, slug
from corpusloom.operators.bodies import NOT_CAPTURED, is_ok
from corpusloom.sources.scratch import stored


def run_state(documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """(site, domain, ord, url, slug, source, outcome, error, done_ms) per planned page of a job.

    documents as from `build_documents`, one row per (site, ord); attempts (url, attempt,
    at_ms, status, error), of which each URL's last one counts. A page with a body is a
    success, wherever the body came from and whatever became of the page itself. Without
    one: `exception` or `http_error` as the last attempt ended, `no_content` where
    something answered. Outcome and `done_ms` are NULL where nothing was tried yet.
    Bodies are not moved. Use `stored` where several reports read the state.
    """
    last = attempts.groupBy("url").agg(
        F.max_by(F.struct("status", "error", "at_ms"), F.struct("at_ms", "attempt")).alias("_last")
    )
    # Written, so that adaptive execution can split a URL that very many jobs plan.
    last = stored(last, "last-attempts")
    rows = documents.select(
        "site",
        "domain",
        "ord",
        "url",
        slug(F.col("title")).alias("slug"),
        "source",
        F.col("body").isNotNull().alias("_has"),
        "error",
    ).join(last, "url", "left")
    tried, status = F.col("_last").isNotNull(), F.col("_last")["status"]
    ended = F.coalesce(F.col("_last")["error"], F.lit("unknown error"))
    refused = F.coalesce(F.col("_last")["error"], F.concat(F.lit("HTTP "), status.cast("string")))
    outcome = (
        F.when(F.col("_has"), "success")
        .when(tried & status.isNull(), "exception")
        .when(tried & ~is_ok(status), "http_error")
        .when(tried, "no_content")
        .when(F.col("error").startswith("HTTP "), "http_error")
        .when(F.col("error") != NOT_CAPTURED, "no_content")
    )
    error = (
        F.when(F.col("outcome") == "success", None)
        .when(tried & status.isNull(), ended)
        .when(tried & ~is_ok(status), refused)
        .otherwise(F.col("error"))
    )
    return rows.withColumn("outcome", outcome).select(
        "site",
        "domain",
        "ord",
        "url",
        "slug",
        "source",
        "outcome",
        error.alias("error"),
        F.col("_last")["at_ms"].alias("done_ms"),
    )


def _kept_names(state: DataFrame) -> DataFrame:
    """(domain, slug, site): each written name and the job whose document stays under it.

    The order is that of `write_corpus` by `ord`.
    """
    written = state.where(F.col("outcome") == "success").groupBy("domain", "slug")
    return written.agg(F.max_by("site", F.struct("ord", "site", "url")).alias("site"))


def job_report(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """One row per job, also without pages: success flag, files, directory, counters, duration.

    jobs (site, domain, output_dir, error). A job succeeds unless its settings are refused;
    `n_files` counts the names under which a document of the job stays. Counts are
    taken per part of the rows before they move.
    """
    outcome = F.col("outcome")
    totals = state.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count(outcome).alias("completed"),
        F.count_if(outcome == "success").alias("success"),
        F.count_if(outcome != "success").alias("failed"),
        (F.max("done_ms") - F.min("done_ms")).alias("duration_ms"),
    )
    files = _kept_names(state).groupBy("site").agg(F.count("*").alias("n_files"))

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)

    return (
        jobs.select("site", "domain", "output_dir", "error")
        .join(totals, "site", "left")
        .join(files, "site", "left")
        .select(
            "site",
            F.col("error").isNull().alias("succeeded"),
            "error",
            corpus_folder(F.col("output_dir"), F.col("domain")).alias("output_directory"),
            *map(counted, ("n_files", "total", "completed", "success", "failed")),
            "duration_ms",
        )
    )


def job_files(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """(site, path) of every document that stays, one row each."""
    folder = corpus_folder(F.col("output_dir"), F.col("domain"))
    kept = _kept_names(state).join(jobs.select("site", "output_dir"), "site")
    return kept.select("site", F.concat(folder, F.lit("/"), "slug", F.lit(".md")).alias("path"))


def job_errors(state: DataFrame) -> DataFrame:
    """(site, ord, url, outcome, error, done_ms) of failed pages, one row each."""
    failed = state.where(F.col("outcome") != "success")
    return failed.select("site", "ord", "url", "outcome", "error", "done_ms")
