"""Content areas as Markdown: tokens join a rule table, pieces fold to blocks, blocks to pages.

Style: `#` headings, `-` bullets, fenced code, inline links, two spaces before a
line break, a blank line between blocks, nested list content indented by four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import decode_entities, js_trim, ordered_concat
from corpusloom.operators.content import area_tokens, missing_area
from corpusloom.functions.layout import computed, fixed_rows
from corpusloom.operators.own_selectors import OwnSelectors
from corpusloom.operators.tokens import (
    BLOCK_TAGS,
    LIST_TAGS,
    attribute,
    before,
    page_window,
    so_far,
    with_depths,
)

# Subtrees that hold no page text.
HIDDEN_TAGS = ["head", "title", "noscript", "template"]

# Stand-ins until a block is complete; noncharacters, so no page text holds them.
_BREAK, _RULE = "\ufdd0", "\ufdd1"
_STRONG_ON, _STRONG_OFF, _EM_ON, _EM_OFF = "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5"

RULES = (
    [(t, "block", None, None) for t in BLOCK_TAGS]
    + [(t, "mark", _STRONG_ON, _STRONG_OFF) for t in ("b", "strong")]
    + [(t, "mark", _EM_ON, _EM_OFF) for t in ("i", "em")]
    + [("code", "mark", "`", "`"), ("a", "link", "[", "]")]
)

_FENCE = "```"
_INDENT = "    "


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\*_#\[\]`])", r"\\$1")


def _collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\f]+", " ")


def _escape_target(c: Column) -> Column:
    return F.regexp_replace(c, r"([()])", r"\\$1")


def html_to_markdown(
    pages: DataFrame, selector: str | OwnSelectors = "body", clustered: bool = False
) -> DataFrame:
    """(page_id, markdown, error) of every page; markdown is NULL without content area."""
    rows = area_tokens(pages, selector, clustered)
    blocks = _blocks(rows, pages.sparkSession)
    done = _page_text(blocks)
    return done.select(
        "page_id",
        F.when(F.col("has_area"), F.coalesce(F.col("markdown"), F.lit(""))).alias("markdown"),
        F.when(~F.col("has_area"), missing_area(selector)).alias("error"),
    )


def _pieces(rows: DataFrame, spark) -> DataFrame:
    """One Markdown piece per token of the area, with the number of its block.

    Inline tags are paired inside their block only; what has no partner there
    leaves no mark. One row per page stays even if it has no area.
    """
    tag, kind, pos = F.col("tag"), F.col("kind"), F.col("pos")
    page = page_window()
    is_open, is_close = kind == "open", kind == "close"
    df = rows.where(F.col("in_area") | (F.coalesce(pos, F.lit(0)) == 0)).join(
        F.broadcast(fixed_rows(spark, ["tag", "role", "mark_on", "mark_off"], RULES)),
        "tag",
        "left",
    )
    hidden, pre = tag.isin(HIDDEN_TAGS), tag == "pre"
    df = with_depths(
        df,
        page,
        {"_hidden": (hidden & is_open, hidden & is_close), "_pre": (pre & is_open, pre & is_close)},
    )
    shown = (
        F.col("in_area")
        & (F.col("_hidden") == 0)
        & kind.isin("text", "open", "close", "void")
    )
    role = F.when(F.coalesce(shown, F.lit(False)), F.coalesce("role", F.lit("plain")))
    df = df.withColumn("role", role).withColumn(
        "block", F.sum(F.when(F.col("role") == "block", 1).otherwise(0)).over(so_far(page))
    )

    # Code spans, in document order: between an opening and the next close of one block.
    event = F.struct("block", "kind")
    df = df.withColumn("_event", F.when((tag == "code") & F.col("role").isNotNull(), event))
    df = df.withColumns(
        {
            "_code_on": F.last("_event", ignorenulls=True).over(so_far(page)),
            "_code_off": F.expr(
                "lead(_event) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)"
            ),
        }
    )
    on, off = F.col("_code_on"), F.col("_code_off")
    in_code = F.coalesce(
        (on["kind"] == "open")
        & (off["kind"] == "close")
        & (on["block"] == F.col("block"))
        & (off["block"] == F.col("block")),
        F.lit(False),
    )
    df = df.withColumn("_in_code", in_code)

    # Inline marks, per block and tag: the outermost pairs; links hold no links.
    in_block = Window.partitionBy("page_id", "block", "tag").orderBy("pos")
    marks = F.col("role").isin("mark", "link")
    df = with_depths(
        df,
        in_block,
        {"_nest": (marks & is_open, marks & is_close)},
        _next=F.lead(F.struct("pos", "kind")).over(in_block),
    )
    df = df.withColumn("_back", F.when(marks & is_close & (F.col("_nest") == 0), pos))
    partner = F.expr(
        "lead(_back) IGNORE NULLS OVER (PARTITION BY page_id, block, tag ORDER BY pos)"
    )
    df = df.withColumn("_partner", partner)
    next_close = F.when(F.col("_next")["kind"] == "close", F.col("_next")["pos"])
    ends = F.when(
        marks & is_open,
        F.when(F.col("role") == "link", next_close).when(F.col("_nest") == 1, F.col("_partner")),
    )
    df = df.withColumn("_ends", F.when(ends > pos + 1, ends))  # an empty element has no mark
    target = F.when(F.col("role") == "link", attribute(F.col("tok"), "href"))
    df = computed(df, _target=F.when(F.col("_ends").isNotNull(), target)).withColumn(
        "_opened",
        F.last(
            F.when(F.col("_ends").isNotNull(), F.struct("_ends", "_target")), ignorenulls=True
        ).over(before(in_block)),
    )

    verbatim = F.col("_pre") > 0
    in_code = F.col("_in_code")
    inner_mark = verbatim | in_code & (tag != "code")
    linked = F.coalesce(F.col("_target"), F.lit("")) != ""
    closes = F.col("_opened")["_ends"] == pos
    close_target = F.col("_opened")["_target"]
    is_text = (kind == "text") & F.col("role").isNotNull()
    df = computed(df, _plain=F.when(is_text, decode_entities(F.col("tok"))))
    plain = F.col("_plain")
    words = _collapse(plain)
    text = F.when(verbatim, plain).when(in_code, words).otherwise(_escape(words))
    shown = F.col("role").isNotNull()
    piece = (
        F.when(plain.isNotNull(), text)
        .when((tag == "br") & shown, F.when(verbatim, "\n").otherwise(_BREAK))
        .when((tag == "hr") & shown, F.lit(_RULE))
        .when((tag == "img") & shown & ~inner_mark, _image(F.col("tok")))
        .when(inner_mark, F.lit(None).cast("string"))
        .when(
            is_open & F.col("_ends").isNotNull() & ((F.col("role") == "mark") | linked),
            F.col("mark_on"),
        )
        .when(is_close & closes & (F.col("role") == "mark"), F.col("mark_off"))
        .when(
            is_close & closes & (F.coalesce(close_target, F.lit("")) != ""),
            F.concat(F.col("mark_off"), F.lit("("), _escape_target(close_target), F.lit(")")),
        )
    )
    return df.select(
        "page_id",
        "block",
        "pos",
        F.when(F.col("role") == "block", tag).alias("tag"),
        "kind",
        (verbatim & plain.isNotNull()).alias("verbatim"),
        "in_area",
        piece.alias("piece"),
    )


def _image(tok: Column) -> Column:
    src = attribute(tok, "src")
    alt = F.coalesce(attribute(tok, "alt"), F.lit(""))
    shown = F.concat(F.lit("!["), _escape(alt), F.lit("]("), _escape_target(src), F.lit(")"))
    return F.when(F.coalesce(src, F.lit("")) != "", shown)


def _block_text(raw: Column) -> Column:
    """Final inline text of a block: marks outside of spaces, breaks, single spaces."""
    on, off = f"[{_STRONG_ON}{_EM_ON}]", f"[{_STRONG_OFF}{_EM_OFF}]"
    moved = F.regexp_replace(F.regexp_replace(raw, f"({on}+)( +)", "$2$1"), f"( +)({off}+)", "$2$1")
    single = F.regexp_replace(moved, " {2,}", " ")
    broken = F.regexp_replace(js_trim(single), f" *{_BREAK} *", "  \n")
    ruled = F.regexp_replace(broken, f" *{_RULE} *", "* * *\n\n")
    marked = F.regexp_replace(ruled, f"[{_STRONG_ON}{_STRONG_OFF}]", "**")
    return js_trim(F.regexp_replace(marked, f"[{_EM_ON}{_EM_OFF}]", "_"))


def _blocks(rows: DataFrame, spark) -> DataFrame:
    """Blocks (page_id, block, tag, kind, verbatim, has_area, text) in page order."""
    grouped = (
        _pieces(rows, spark)
        .groupBy("page_id", "block")
        .agg(
            ordered_concat("piece", "pos").alias("_raw"),
            F.min(F.struct("pos", "tag", "kind")).alias("_start"),
            F.max(F.coalesce("verbatim", F.lit(False))).alias("verbatim"),
            F.max("in_area").alias("has_area"),
        )
    )
    code = F.regexp_replace(F.regexp_replace(F.col("_raw"), r"^\r?\n", ""), r"[ \t\r\n]+$", "")
    text = F.when(F.col("verbatim"), code).otherwise(_block_text(F.col("_raw")))
    done = computed(grouped, text=F.nullif(text, F.lit(""))).select(
        "page_id",
        "block",
        F.col("_start")["tag"].alias("tag"),
        F.col("_start")["kind"].alias("kind"),
        "verbatim",
        "has_area",
        "text",
    )
    # Blocks without text matter only where they open or close a list, item or quote;
    # the first two tell whether the page has an area at all.
    shapes = F.coalesce(F.col("tag").isin(*LIST_TAGS, "li", "blockquote"), F.lit(False))
    return done.where(F.col("text").isNotNull() | shapes | (F.col("block") <= 1))


def _page_text(blocks: DataFrame) -> DataFrame:
    """Fold blocks to pages: list items, quotes, headings, fences, separators."""
    tag, text = F.col("tag"), F.col("text")
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    order = Window.partitionBy("page_id").orderBy("block")
    df = blocks
    lists, quotes = tag.isin(LIST_TAGS), tag == "blockquote"
    df = with_depths(
        df,
        order,
        {
            "_lists": (lists & is_open, lists & is_close),
            "_quotes": (quotes & is_open, quotes & is_close),
        },
    )

    # Per list depth: the list and item a block belongs to, the item's number.
    level = Window.partitionBy("page_id", "_lists").orderBy("block")
    starts_list = lists & is_open
    starts_item = (tag == "li") & is_open
    df = df.withColumns(
        {
            "_items": F.sum(F.when(starts_item, 1).otherwise(0)).over(so_far(level)),
            "_item": F.last(F.when(starts_item, F.col("block")), ignorenulls=True).over(
                so_far(level)
            ),
        }
    )
    opened = F.when(starts_list, F.struct("tag", "_items"))
    df = df.withColumn("_list", F.last(opened, ignorenulls=True).over(so_far(level)))
    item = Window.partitionBy("page_id", "_lists", "_item").orderBy("block")
    filled = F.sum(F.when(text.isNotNull(), 1).otherwise(0)).over(so_far(item))
    df = df.withColumn("_filled", filled)
    leads = (F.col("_lists") > 0) & F.col("_item").isNotNull() & (F.col("_filled") == 1)
    number = (F.col("_items") - F.coalesce(F.col("_list")["_items"], F.lit(0))).cast("string")
    bullet = F.when(F.col("_list")["tag"] == "ol", F.concat(number, F.lit(". "))).otherwise("- ")

    quote = F.repeat(F.lit("> "), F.col("_quotes"))
    margin = F.concat(quote, F.repeat(F.lit(_INDENT), F.col("_lists")))
    outer = F.concat(quote, F.repeat(F.lit(_INDENT), F.col("_lists") - 1))
    heading = F.when(
        is_open & tag.rlike("^h[1-6]$"),
        F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")),
    )
    body = (
        F.when(F.col("verbatim"), F.concat(F.lit(_FENCE + "\n"), text, F.lit("\n" + _FENCE)))
        .when(heading.isNotNull(), F.concat(heading, F.regexp_replace(text, " *\n", " ")))
        .otherwise(text)
    )
    first = F.when(F.col("_leads"), F.concat(outer, bullet)).otherwise(margin)
    df = (
        df.withColumn("_leads", leads & text.isNotNull())
        .withColumn("_margin", margin)
        .withColumn("_body", body)
        .withColumn("_first", first)
    )
    lines = F.replace("_body", F.lit("\n"), F.concat(F.lit("\n"), F.col("_margin")))
    df = df.withColumn("_text", F.concat("_first", lines)).withColumn(
        "_before",
        F.last(
            F.when(text.isNotNull(), F.struct("_lists", "_quotes")), ignorenulls=True
        ).over(before(order)),
    )
    prior = F.col("_before")
    shared = F.least(prior["_quotes"], F.col("_quotes"))
    gap = (
        F.when(prior.isNull(), "")
        .when(F.col("_leads") & (prior["_lists"] > 0), "\n")
        .when(
            shared > 0,
            F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), shared)), F.lit("\n")),
        )
        .otherwise("\n\n")
    )
    df = df.withColumn("_out", F.when(text.isNotNull(), F.concat(gap, F.col("_text"))))
    return df.groupBy("page_id").agg(
        ordered_concat("_out", "block").alias("markdown"),
        F.coalesce(F.max("has_area"), F.lit(False)).alias("has_area"),
    )
