"""Markup outline of a page: tags with their telling attributes, texts cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import decode_entities, js_trim, ordered_concat
from corpusloom.operators.content import head_row
from corpusloom.operators.tokens import (
    attribute,
    pair_tags,
    page_tokens,
    page_window,
    so_far,
    whole_page,
)

# Subtrees the outline leaves out; lengths it cuts to.
DROPPED_TAGS = [
    "script", "style", "noscript", "iframe", "svg", "img", "picture", "video", "audio", "canvas"
]
HREF_LIMIT, HREF_KEPT = 50, 47
TEXT_LIMIT, TEXT_KEPT = 30, 27
PREVIEW_LIMIT = 1000
PREVIEW_NOTE = "...\n\n[truncated - see full file for complete structure]"


def _cut(c: Column, limit: int, kept: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, kept), F.lit("..."))).otherwise(c)


def _with_open_tag(df: DataFrame, tok: Column, tag: Column) -> DataFrame:
    """Add `_head`: `<tag id class role href` without the closing bracket."""
    named = df
    for name in ("id", "class", "role"):
        named = named.withColumn(f"_{name}", attribute(tok, name))
    named = named.withColumn(
        "_href", F.when(tag == "a", _cut(attribute(tok, "href"), HREF_LIMIT, HREF_KEPT))
    )

    def shown(name: str) -> Column:
        value = F.col(f"_{name}")
        return F.when(value != "", F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")

    head = F.concat(F.lit("<"), tag, *[shown(n) for n in ("id", "class", "role", "href")])
    return named.withColumn("_head", head).drop("_id", "_class", "_role", "_href")


def _with_body(rows: DataFrame) -> DataFrame:
    """Put a body element in front of what follows the head, on pages without body and html tag."""
    starts, pos = F.col("end_pos").isNotNull(), F.col("pos")
    df = rows.withColumns(
        {
            "_any": F.max(starts & F.col("tag").isin("body", "html")).over(whole_page()),
            "_head_end": F.max(F.when(head_row(), pos)).over(whole_page()),
        }
    )
    missing = ~F.coalesce("_any", F.lit(False))
    place = F.coalesce("_head_end", F.lit(-1))
    made = {
        "pos": place, "tok": F.lit("<body>"), "tag": F.lit("body"), "kind": F.lit("open"),
        "end_pos": F.greatest(place, F.col("n_tok") - 1), "closed": F.lit(False),
    }
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    body = F.struct(*[made.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in rows.columns if c != "page_id"])
    own = F.struct(*[c for c in rows.columns if c != "page_id"])
    # The last row of the head makes room for it, or else the first row of the page is doubled.
    at = F.coalesce(pos, F.lit(-1)) == F.coalesce("_head_end", F.lit(0))
    at = missing & (at | pos.isNull())
    both = F.when(at & F.col("_head_end").isNull(), F.array(body, own)).when(at, F.array(body)).otherwise(F.array(own))
    return df.select("page_id", F.explode(both).alias("_row")).select("page_id", "_row.*")


def html_skeleton(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Outline per page as (page_id, skeleton), from body, else html; every page gives one row.

    Elements without children show their text; others show only their children. What
    follows the head of a page with neither tag is its body.
    """
    page = page_window()
    kind, pos = F.col("kind"), F.col("pos")
    rows = _with_body(pair_tags(page_tokens(pages, clustered)))
    starts = F.col("end_pos").isNotNull()

    # Leave out dropped subtrees and what lies outside the root element.
    span = F.struct("pos", "end_pos")

    def first(tag: str) -> Column:
        return F.min(F.when(starts & (F.col("tag") == tag), span)).over(whole_page())

    dropped = F.max(F.when(starts & F.col("tag").isin(DROPPED_TAGS), F.col("end_pos")))
    kept = (
        rows.withColumns(
            {
                "_drop": dropped.over(so_far(page)),
                "_body": first("body"),
                "_html": first("html"),
            }
        )
        .withColumn("_root", F.coalesce("_body", "_html"))
        .where(kind.isin("text", "open", "void"))
        .where(F.coalesce(F.col("_drop") < pos, F.lit(True)))
        .where(pos.between(F.col("_root")["pos"], F.col("_root")["end_pos"]))
    )

    # A leaf is an element whose next element starts behind its end.
    own = F.struct("pos", "end_pos", "tag", "tok")
    placed = kept.withColumn("_starts_at", F.when(starts, pos)).withColumns(
        {
            "_next_start": F.expr(
                "lead(_starts_at) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)"
            ),
            "_el": F.last(F.when(starts, own), ignorenulls=True).over(so_far(page)),
        }
    )
    el = F.col("_el")
    inside = (kind == "text") & (pos <= el["end_pos"])
    elements = (
        placed.where(el.isNotNull() & (starts | inside))
        .withColumn("_text", F.when(inside, F.col("tok")))
        .groupBy("page_id", el.alias("el"))
        .agg(
            ordered_concat("_text", "pos").alias("_text"),
            F.max(F.when(starts, F.coalesce("_next_start", F.lit(2**31 - 1)))).alias("_next"),
            F.min(F.col("_root")["pos"]).alias("_root_pos"),
        )
    )
    e, text, head = F.col("el"), F.col("_shown"), F.col("_line")
    full_text = js_trim(decode_entities(F.coalesce(F.col("_text"), F.lit(""))))
    leaf = F.col("_next") > e["end_pos"]
    gap = F.when(e["pos"] == F.col("_root_pos"), "").otherwise("\n  ")
    drawn = (
        _with_open_tag(elements, e["tok"], e["tag"])
        .withColumn("_line", F.concat(gap, F.col("_head")))
        .withColumn("_full", F.when(leaf, full_text))
        .withColumn("_shown", _cut(F.col("_full"), TEXT_LIMIT, TEXT_KEPT))
    )
    close = F.concat(F.lit("</"), e["tag"], F.lit(">"))
    leaf_piece = F.when(text == "", F.concat(head, F.lit(" />"))).otherwise(
        F.concat(head, F.lit(">"), text, close)
    )
    pieces = drawn.select(
        "page_id",
        F.explode(
            F.when(leaf, F.array(_piece(e["pos"], 0, e["pos"], leaf_piece))).otherwise(
                F.array(
                    _piece(e["pos"], 0, e["pos"], F.concat(head, F.lit(">"))),
                    _piece(e["end_pos"], 1, -e["pos"], F.concat(F.lit("\n"), close)),
                )
            )
        ).alias("_p"),
    ).select("page_id", "_p.*")
    outline = pieces.groupBy("page_id").agg(
        F.expr(
            "listagg(piece, '') WITHIN GROUP (ORDER BY named_struct('a', at, 's', shut, 'n', nth))"
        ).alias("skeleton")
    )
    return outline


def _piece(at: Column, shut: int, nth: Column, piece: Column) -> Column:
    return F.struct(
        at.alias("at"), F.lit(shut).alias("shut"), nth.alias("nth"), piece.alias("piece")
    )


def skeleton_preview(skeletons: DataFrame) -> DataFrame:
    """(page_id, size, preview): the first 1,000 characters and a note if cut."""
    s = F.col("skeleton")
    note = F.concat(F.substring(s, 1, PREVIEW_LIMIT), F.lit(PREVIEW_NOTE))
    return skeletons.select(
        "page_id",
        F.length(s).alias("size"),
        F.when(F.length(s) > PREVIEW_LIMIT, note).otherwise(s).alias("preview"),
    )
