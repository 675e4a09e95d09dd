"""Domains, fallback titles, and file names that would overwrite each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.layout import computed
from corpusloom.functions.names import slug
from corpusloom.functions.urls import domain, path_title


def domain_rollup(pages: DataFrame) -> DataFrame:
    """(domain, n_pages); what is no URL counts as `unknown`."""
    named = pages.select(domain(F.col("url")).alias("domain"))
    return named.groupBy("domain").agg(F.count("*").alias("n_pages"))


def path_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): last path segment, else `index`."""
    return pages.select("page_id", path_title(F.col("url")).alias("title"))


def named_documents(links: DataFrame) -> DataFrame:
    """Add `slug` and, unless given, `domain`: the place of each document in the corpus."""
    place = {} if "domain" in links.columns else {"domain": domain(F.col("url"))}
    return computed(links, **place, slug=slug(F.col("title")))


def name_collisions(links: DataFrame, order: list[str]) -> DataFrame:
    """(domain, slug, n, kept_url) of names that several links claim; the last one stays."""
    claims = named_documents(links).groupBy("domain", "slug")
    counted = claims.agg(
        F.count("*").alias("n"), F.max_by("url", F.struct(*order)).alias("kept_url")
    )
    return counted.where("n > 1")


def last_per_name(documents: DataFrame, order: list[str]) -> DataFrame:
    """One document per (domain, slug): the highest in `order`."""
    rest = [c for c in documents.columns if c not in ("domain", "slug")]
    kept = documents.groupBy("domain", "slug").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_doc")
    )
    return kept.select("domain", "slug", "_doc.*")
