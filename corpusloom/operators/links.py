"""Links of a page: selected anchors with text, resolved and de-duplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.layout import computed
from corpusloom.functions.text import decode_entities, js_trim, ordered_concat
from corpusloom.functions.urls import base_parts, resolve_against
from corpusloom.operators.own_selectors import OwnSelectors, own_tokens
from corpusloom.operators.selectors import (
    Selector,
    as_selector,
    flag_matches,
    needs_pairs,
    pair_for,
    selector_tags,
)
from corpusloom.operators.tokens import (
    attribute,
    page_tokens,
    page_window,
    so_far,
)

# Hrefs holding one of these are site resources, not pages.
RESOURCE_MARKS = ["_next", "sitemap", "favicon"]


def _flagged(
    pages: DataFrame, selector: str | Selector | OwnSelectors, clustered: bool
) -> DataFrame:
    """Tokens that links are made of, with the selected elements marked."""
    if isinstance(selector, OwnSelectors):
        return own_tokens(pages, selector, clustered)
    wanted = as_selector(selector)
    if needs_pairs(wanted):
        return flag_matches(pair_for(page_tokens(pages, clustered), wanted), wanted)
    # Only the named tags decide; the rest need not be sorted.
    tags = selector_tags(wanted)
    return flag_matches(page_tokens(pages, clustered, tags | {"a"} if tags else None), wanted)


def extract_links(
    pages: DataFrame, selector: str | Selector | OwnSelectors, clustered: bool = False
) -> DataFrame:
    """Selected anchors as (page_id, ord, href, title), in document order.

    An anchor ends at its close tag or at the next anchor. Anchors without href
    or text and those pointing at site resources are left out. With `OwnSelectors`,
    each page is asked by the selector in its key.
    """
    kind = F.col("kind")
    rows = _flagged(pages, selector, clustered)

    link_edge = (F.col("tag") == "a") & kind.isin("open", "close")
    current = F.last(
        F.when(link_edge, F.struct("pos", "tok", "matched")), ignorenulls=True
    ).over(so_far(page_window()))
    inside = rows.withColumn("_link", current).where((kind == "text") & F.col("_link")["matched"])
    anchors = inside.groupBy(
        "page_id", F.col("_link")["pos"].alias("pos"), F.col("_link")["tok"].alias("tok")
    ).agg(ordered_concat("tok", "pos").alias("_text"))
    links = computed(
        anchors,
        href=attribute(F.col("tok"), "href"),
        title=js_trim(decode_entities(F.col("_text"))),
    ).where((F.col("href") != "") & (F.col("title") != ""))
    for mark in RESOURCE_MARKS:
        links = links.where(~F.contains(F.col("href"), F.lit(mark)))
    order = Window.partitionBy("page_id").orderBy("pos")
    return links.select(
        "page_id", F.row_number().over(order).alias("ord"), "href", "title"
    )


def absolute_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Add each link's absolute `url` (NULL where unparsable), page by page."""
    bases = pages.select("page_id", base_parts(F.col("url")).alias("_base"))
    return resolve_against(links.join(bases, "page_id"), "_base", "href", "url").drop("_base")


def follow_links(
    pages: DataFrame,
    selector: str | Selector | OwnSelectors,
    clustered: bool = False,
    urls: DataFrame | None = None,
) -> DataFrame:
    """Pages to follow as (page_id, ord, url, title): first link per absolute URL.

    Links whose href is no URL are skipped. `urls` may give (page_id, url) where that
    is cheaper than reading `pages` for it.
    """
    bases = pages if urls is None else urls
    links = absolute_links(extract_links(pages, selector, clustered), bases)
    found = links.where(F.col("url").isNotNull())
    same = Window.partitionBy("page_id", "url").orderBy("ord")
    firsts = found.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    order = Window.partitionBy("page_id").orderBy("ord")
    return firsts.select(
        "page_id", F.row_number().over(order).alias("ord"), "url", "title"
    )
