"""The content area of a page: the inside of the first selected element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import js_trim, ordered_concat
from corpusloom.operators.own_selectors import OwnSelectors, own_tokens
from corpusloom.operators.selectors import Selector, as_selector, flag_matches, pair_for
from corpusloom.operators.tokens import (
    page_tokens,
    page_window,
    so_far,
    whole_page,
)

HEAD_TAGS = ["html", "head", "title", "meta", "link", "base"]


def missing_area(selector: str | OwnSelectors) -> Column:
    """Error text of a page without content area."""
    if isinstance(selector, OwnSelectors):
        return F.concat(F.lit("content area not found: "), F.col("page_id")["selector"])
    return F.lit(f"content area not found: {selector}")


def area_tokens(
    pages: DataFrame, selector: str | Selector | OwnSelectors = "body", clustered: bool = False
) -> DataFrame:
    """Token table plus `in_area`: whether a token lies inside the content area.

    For the plain selector `body`, a page without such a tag counts as all body
    after its head, as browsers read it. With `OwnSelectors`, each page is asked by
    the selector in its key.
    """
    if isinstance(selector, OwnSelectors):
        return _own_area(own_tokens(pages, selector, clustered))
    steps = as_selector(selector)
    tokens = page_tokens(pages, clustered)
    lone = steps[0][0] if len(steps) == 1 and len(steps[0]) == 1 else None
    if lone is not None and lone.bare and lone.tag == "body":
        return _bare_area(tokens, lone.tag)
    df = flag_matches(pair_for(tokens, steps), steps)
    return df.withColumns(_first_match()).withColumn("in_area", _in_match()).select(
        *tokens.columns, "in_area"
    )


def _first_match() -> dict[str, Column]:
    """`_area`: the first selected element so far."""
    match = F.when(F.col("matched"), F.struct("pos", "end_pos", "closed", "kind"))
    return {"_area": F.first(match, ignorenulls=True).over(so_far(page_window()))}


def _in_match() -> Column:
    area, pos = F.col("_area"), F.col("pos")
    inside = (pos > area["pos"]) & ((pos < area["end_pos"]) | (pos == area["end_pos"]) & ~area["closed"])
    return F.coalesce(inside, F.lit(False))


def head_row() -> Column:
    """Tags that belong to the head of a page without a body tag."""
    kind = F.col("kind")
    row = F.col("tag").isin(HEAD_TAGS) & kind.isin("open", "close", "void")
    return row & ((F.col("tag") != "html") | (kind == "open"))


def _own_area(rows: DataFrame) -> DataFrame:
    """The first match of each page's own selector; `body` without a tag as in `area_tokens`."""
    pos = F.col("pos")
    opened = (F.col("tag") == "body") & (F.col("kind") == "open")
    whole = {
        "_any": F.max(opened).over(whole_page()),
        "_head_end": F.max(F.when(head_row(), pos)).over(whole_page()),
    }
    plain = (js_trim(F.col("page_id")["selector"]) == "body") & ~F.coalesce("_any", F.lit(False))
    inside = _in_match() | plain & (pos > F.coalesce("_head_end", F.lit(-1)))
    df = rows.withColumns(_first_match() | whole)
    return df.withColumn("in_area", F.coalesce(inside, F.lit(False))).drop(
        "matched", "end_pos", "closed", "_area", "_any", "_head_end"
    )


def _bare_area(tokens: DataFrame, tag: str) -> DataFrame:
    """First element of one tag by running depth: no pairing, one sort."""
    page = page_window()
    pos, kind = F.col("pos"), F.col("kind")
    opened = (F.col("tag") == tag) & (kind == "open")
    closed = (F.col("tag") == tag) & (kind == "close")
    first = {"_first": F.min(F.when(opened, pos)).over(so_far(page))}
    if tag == "body":
        first["_any"] = F.min(F.when(opened, pos)).over(whole_page())
        first["_head_end"] = F.max(F.when(head_row(), pos)).over(whole_page())
    df = tokens.withColumns(first)
    # Counted from the first opening on; its element ends where the depth is 0 again.
    step = F.when(opened, 1).when(closed & F.col("_first").isNotNull(), -1).otherwise(0)
    df = df.withColumn("_depth", F.sum(step).over(so_far(page)))
    ended = F.when((F.col("_depth") == 0) & F.col("_first").isNotNull(), pos)
    df = df.withColumn("_ended", F.min(ended).over(so_far(page)))
    inside = (pos > F.col("_first")) & F.col("_ended").isNull()
    if tag == "body":
        inside = inside | F.col("_any").isNull() & (pos > F.coalesce("_head_end", F.lit(-1)))
    return df.withColumn("in_area", F.coalesce(inside, F.lit(False))).select(
        *tokens.columns, "in_area"
    )


def content_area(
    pages: DataFrame, selector: str | OwnSelectors = "body", clustered: bool = False
) -> DataFrame:
    """Inner markup per page as (page_id, inner, error); every page gives one row."""
    rows = area_tokens(pages, selector, clustered)
    inside = rows.withColumn("_inner", F.when(F.col("in_area"), F.col("tok")))
    areas = inside.groupBy("page_id").agg(ordered_concat("_inner", "pos").alias("inner"))
    empty = F.coalesce(F.col("inner"), F.lit("")) == ""
    return areas.select(
        "page_id",
        F.when(~empty, F.col("inner")).alias("inner"),
        F.when(empty, missing_area(selector)).alias("error"),
    )
