"""Reports over fetch logs: outcomes, retries, run summaries, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import corpus_folder
from corpusloom.operators.bodies import is_ok

# An error holding one of these texts is worth another attempt.
RETRYABLE = [
    "timeout",
    "ETIMEDOUT",
    "ECONNRESET",
    "ECONNREFUSED",
    "ENOTFOUND",
    "HTTP 429",
    "HTTP 500",
    "HTTP 502",
    "HTTP 503",
    "HTTP 504",
]
BASE_DELAY_MS = 1000
MAX_RETRIES = 3


def _holds_any(error: Column, tokens: list[str]) -> Column:
    return F.coalesce(F.lower(error).rlike("|".join(t.lower() for t in tokens)), F.lit(False))


def fetch_outcomes(attempts: DataFrame, areas: DataFrame) -> DataFrame:
    """(page_id, url, outcome, error, done_ms) by each page's last attempt.

    attempts (page_id, url, attempt, at_ms, status, error); areas as from
    `content_area`. Outcomes: success, http_error, no_content, exception.
    """
    # One layout for the group and the join: a page has one URL.
    last = attempts.groupBy("page_id").agg(
        F.max_by(F.struct("url", "status", "error", "at_ms"), F.col("attempt")).alias("_last")
    )
    joined = last.join(areas.select("page_id", F.col("error").alias("_area")), "page_id", "left")
    status, text = F.col("_last")["status"], F.col("_last")["error"]
    area = F.col("_area")
    outcome = (
        F.when(status.isNull(), "exception")
        .when(~is_ok(status), "http_error")
        .when(area.isNotNull(), "no_content")
        .otherwise("success")
    )
    error = (
        F.when(status.isNull(), F.coalesce(text, F.lit("unknown error")))
        .when(~is_ok(status), F.coalesce(text, F.concat(F.lit("HTTP "), status.cast("string"))))
        .otherwise(area)
    )
    return joined.select(
        "page_id",
        "_last.url",
        outcome.alias("outcome"),
        error.alias("error"),
        F.col("_last")["at_ms"].alias("done_ms"),
    )


def retry_audit(
    attempts: DataFrame, base_ms: int = BASE_DELAY_MS, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Per page: attempts, errors by kind, expected waiting, broken rules, gave-up flag.

    `http_only` counts errors that are retryable by text but never reach the retry
    rule, because an answered request is no exception. `broke_rule`: an attempt
    followed an error that must not be repeated, or the retry limit.
    """
    error, attempt = F.col("error"), F.col("attempt")
    failed = F.col("status").isNull() & error.isNotNull()
    retryable = _holds_any(error, RETRYABLE)
    http = _holds_any(error, [t for t in RETRYABLE if t.startswith("HTTP")])
    wait = F.lit(base_ms).cast("bigint") * F.pow(F.lit(2.0), attempt).cast("bigint")
    per_page = attempts.groupBy("page_id", "url").agg(
        F.count("*").alias("n_attempts"),
        F.count_if(failed & retryable).alias("n_retryable"),
        F.count_if(failed & ~retryable).alias("n_final"),
        F.count_if(~failed & http).alias("http_only"),
        F.max("attempt").alias("_last"),
        F.min(F.when(failed & ~retryable, attempt)).alias("_stop"),
        # Every exception but one on the last allowed attempt is waited for.
        F.coalesce(F.sum(F.when(failed & (attempt < max_retries), wait)), F.lit(0)).alias(
            "_waited"
        ),
        F.max_by(failed, attempt).alias("_failed_last"),
        F.coalesce(F.max_by(F.when(failed & (attempt < max_retries), wait), attempt), F.lit(0)).alias(
            "_last_wait"
        ),
    )
    last, stop = F.col("_last"), F.col("_stop")
    return per_page.select(
        "page_id",
        "url",
        "n_attempts",
        "n_retryable",
        "n_final",
        "http_only",
        # The last attempt is not waited for: nothing followed it.
        (F.col("_waited") - F.col("_last_wait")).alias("backoff_ms"),
        (F.coalesce(stop < last, F.lit(False)) | (last > max_retries)).alias("broke_rule"),
        F.col("_failed_last").alias("gave_up"),
    )


def run_summary(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(site, total, completed, success, failed, skipped, percent) per site.

    plan (site, page_id). Pages without outcome are still to do. Nothing in the
    engine skips pages, so `skipped` stays 0.
    """
    joined = plan.select("site", "page_id").join(
        outcomes.select("page_id", "outcome"), "page_id", "left"
    )
    outcome = F.col("outcome")
    counts = joined.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count("outcome").alias("completed"),
        F.count_if(outcome == "success").alias("success"),
        F.count_if(outcome.isNotNull() & (outcome != "success")).alias("failed"),
        F.lit(0).cast("bigint").alias("skipped"),
    )
    share = F.col("completed").cast("double") / F.col("total").cast("double") * F.lit(100.0)
    return counts.withColumn("percent", F.floor(share).cast("int"))


def failure_report(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(site, page_id, url, error) of failed pages, in the order they failed."""
    failed = outcomes.where(F.col("outcome") != "success")
    return (
        failed.join(plan.select("site", "page_id"), "page_id")
        .orderBy("site", "done_ms", "page_id")
        .select("site", "page_id", "url", "error")
    )


def run_report(
    summary: DataFrame, outcomes: DataFrame, plan: DataFrame, listing: DataFrame, output_dir: str
) -> DataFrame:
    """One row per site: success flag, files, directory, counters, duration.

    listing (domain, n_files) as from `list_corpus`; sites are domains here.
    """
    spans = (
        plan.select("site", "page_id")
        .join(outcomes.select("page_id", "done_ms"), "page_id")
        .groupBy("site")
        .agg((F.max("done_ms") - F.min("done_ms")).alias("duration_ms"))
    )
    files = listing.select(F.col("domain").alias("site"), "n_files")
    joined = summary.join(spans, "site", "left").join(files, "site", "left")
    return joined.select(
        "site",
        (F.col("completed") == F.col("total")).alias("finished"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        corpus_folder(F.lit(output_dir), F.col("site")).alias("output_directory"),
        "total",
        "success",
        "failed",
        "duration_ms",
    )
