"""Pages as rows: one row per tag, text run or comment, and element intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import decode_entities
from corpusloom.functions.layout import computed, spread

# Fixed values of HTML: elements without content, elements that end an open
# paragraph, elements inside text, elements that cannot hold themselves.
VOID_TAGS = (
    "area base br col embed frame hr img input link meta param source track wbr"
).split()
BLOCK_TAGS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
INLINE_TAGS = (
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strong sub sup time tt u var"
).split()
FLAT_TAGS = ["a", "button"]
LIST_TAGS = ["ul", "ol"]
# Fixed values of HTML: elements whose end tag may be left out, by the containers that they
# belong to. One ends where the next of its rank or a lower one begins or ends.
OPTIONAL_ENDS = {
    ("ul", "ol", "menu"): {"li": 1},
    ("dl",): {"dt": 1, "dd": 1},
    ("table",): {"thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3},
    ("select",): {"optgroup": 1, "option": 2},
}
RANKS = {tag: rank for items in OPTIONAL_ENDS.values() for tag, rank in items.items()}
# Elements of drawings and formulas that HTML itself lacks: only there `/>` closes a tag.
FOREIGN_TAGS = (
    "animate animatemotion animatetransform circle clippath defs ellipse fecolormatrix feflood "
    "fegaussianblur femerge femergenode feoffset g line lineargradient mask mpath mprescripts none "
    "path pattern polygon polyline radialgradient rect set stop svg symbol tspan use view"
).split()

# Possessive groups: no backtracking and no stack growth on long or broken input.
TOKEN = (
    r"(?is)[^<]+"
    r"|<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+[^>=]*+)*+>"""
    r"|<(?:[!?]|/[^a-z>])[^>]*>"
    r"|<[a-z/!?][^>]*\z"
    r"|<"
)

_ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>`]+))?"""


def page_window():
    """Document order within a page."""
    return Window.partitionBy("page_id").orderBy("pos")


def so_far(window):
    """Running frame; the default one is a slower range frame."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_page():
    return page_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def page_tokens(
    pages: DataFrame,
    clustered: bool = False,
    tags: Iterable[str] | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Tokens of every page: (page_id, n_tok, pos, tok, tag, kind).

    `kind` is open, close, void, raw (whole script or style), comment, cut (a tag
    the page end cuts off) or text. A page without markup gives one row of NULLs,
    so no page is lost. Pages move once, before they grow into tokens, to as many tasks
    as their bytes ask for (see `spread`); pass
    `clustered=True` for a table that is bucketed by page_id already. With `tags`,
    only text and tokens of those tags are kept, before anything else looks at them.
    `also` names columns that are worked out once per page, each from those before it, and
    given to all its tokens.
    """
    also = also or {}
    source = pages.select("page_id", "html")
    if not clustered:
        source = spread(source, "page_id", sized_by="html")
    for name, column in also.items():
        source = computed(source, **{name: column})
    split = source.select(
        "page_id",
        *also,
        F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)).alias("_toks"),
    )
    # The count is taken below the explode, so that no row carries the whole array.
    sized = split.select("page_id", *also, F.size("_toks").alias("n_tok"), "_toks")
    rows = sized.select(
        "page_id", *also, "n_tok", F.posexplode_outer("_toks").alias("pos", "tok")
    )
    tok = F.col("tok")
    if tags is not None:
        named = rf"(?i)^</?(?:{'|'.join(sorted(tags))})[\s/>]"
        rows = rows.where(~tok.startswith("<") | (tok == "<") | tok.rlike(named))
    name = F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][^\s/>]*)", 1))
    tagged = computed(rows, tag=F.when(tok.startswith("<"), F.nullif(name, F.lit(""))))
    tag = F.col("tag")
    kind = (
        F.when(tok.isNull(), F.lit(None).cast("string"))
        .when(~tok.startswith("<") | (tok == "<"), "text")
        .when(tok.startswith("<!") | tok.startswith("<?"), "comment")
        .when(tag.isNull(), F.when(tok.endswith(">"), "comment").otherwise("cut"))
        .when(tag.isin("script", "style") & ~tok.startswith("</"), "raw")
        .when(~tok.endswith(">"), "cut")
        .when(tok.startswith("</"), "close")
        .when(tag.isin(VOID_TAGS) | tag.isin(FOREIGN_TAGS) & tok.endswith("/>"), "void")
        .otherwise("open")
    )
    return tagged.withColumn("kind", kind)


def _attribute_pairs(tok: Column) -> Column:
    # A slash before the end belongs to the value where that has no quotes.
    body = F.regexp_replace(tok, r"^</?[A-Za-z][^\s/>]*|>$", "")
    return F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))


def _attribute_value(pair: Column) -> Column:
    raw = F.regexp_replace(pair, r"(?s)^[^=]*=?\s*", "")
    value = F.regexp_replace(raw, """(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
    return decode_entities(value, in_attribute=True)


def attributes(tok: Column) -> Column:
    """All attributes of a tag in order, as array of struct (name, value); names in lower case."""

    def named(pair: Column) -> Column:
        name = F.lower(F.regexp_extract(pair, r"^[^\s=]+", 0))
        return F.struct(name.alias("name"), _attribute_value(pair).alias("value"))

    return F.transform(_attribute_pairs(tok), named)


def attribute(tok: Column, name: str) -> Column:
    """Decoded value of attribute `name` of a tag; '' without value, NULL if absent."""
    pairs = _attribute_pairs(tok)
    named = F.filter(pairs, lambda p: p.rlike(f"(?i)^{name}\\s*(=|$)"))
    value = _attribute_value(F.try_element_at(named, F.lit(1)))
    # Cheap test first: most tags carry no attribute of that name.
    return F.when(F.contains(F.lower(tok), F.lit(name)), value)


def with_depths(
    df: DataFrame, window, depths: dict[str, tuple[Column, Column]], **also: Column
) -> DataFrame:
    """Add per name the open elements after each row, from (is open, is close) tests.

    Stray closes never take a depth below 0. All sums share one pass and all low
    marks another; `also` are further columns over the same window for the first.
    """
    steps = {
        name: F.when(is_open, 1).when(is_close, -1).otherwise(0)
        for name, (is_open, is_close) in depths.items()
    }
    sums = {f"_{name}_sum": F.sum(step).over(so_far(window)) for name, step in steps.items()}
    lows = {f"_{name}_low": F.min(f"_{name}_sum").over(so_far(window)) for name in depths}
    return (
        df.withColumns(sums | also)
        .withColumns(lows)
        .withColumns(
            {
                name: (F.col(f"_{name}_sum") - F.least(F.lit(0), F.col(f"_{name}_low"))).cast("int")
                for name in depths
            }
        )
        .drop(*sums, *lows)
    )


def with_depth(df: DataFrame, name: str, is_open: Column, is_close: Column, window) -> DataFrame:
    return with_depths(df, window, {name: (is_open, is_close)})


def pair_tags(tokens: DataFrame, items: bool = True) -> DataFrame:
    """Add `end_pos` and `closed` to the opening and void rows of a token table.

    An element reaches to its close tag. Without one: p ends before the next block tag,
    list items, cells, rows and the like before the next tag of their container that must
    end them, inline elements before the next block, links before the next link. All
    end with the element around them at the latest, others there or at the page end.
    Each tag is paired on its own, so one broken element does not spoil the others.
    `items=False` saves a pass where no element of `RANKS` is asked for.
    """
    tag, kind, pos = F.col("tag"), F.col("kind"), F.col("pos")
    page = page_window()
    is_open, is_close = kind == "open", kind == "close"
    is_tag = kind.isin("open", "close", "void")

    # Document order: the block boundaries around, the containers open.
    edge = F.struct("pos", "tag", "kind")
    boundary = is_tag & tag.isin(BLOCK_TAGS)
    depths = {f"_in{k}": names for k, names in enumerate(OPTIONAL_ENDS)} if items else {}
    df = with_depths(
        tokens.withColumn("_edge", F.when(boundary, edge)),
        page,
        {name: (tag.isin(*tags) & is_open, tag.isin(*tags) & is_close) for name, tags in depths.items()},
        _next_block=_next_in_page("_edge"),
        _last_block=F.last("_edge", ignorenulls=True).over(before(page)),
    )
    df = _item_events(df) if items else df.withColumns({c: F.when(F.lit(False), edge) for c in ("_next_item", "_last_item")})

    # Per tag: nesting level, then the next tag of the same level.
    per_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    df = with_depth(df, "_open", is_open, is_close, per_tag)
    level = F.when(tag.isin(FLAT_TAGS), 1).otherwise(
        F.col("_open") + F.when(is_close, 1).otherwise(0)
    )
    df = df.withColumn("_level", F.when(is_open | is_close, level))
    per_level = Window.partitionBy("page_id", "tag", "_level").orderBy("pos")
    df = df.withColumns(
        {
            "_next_pos": F.lead("pos").over(per_level),
            "_next_kind": F.lead("kind").over(per_level),
            "_last_kind": F.lag("kind").over(per_level),
        }
    )

    page_end = F.col("n_tok") - 1
    ranked = tag.isin(*RANKS)

    def own_end(edge: str) -> Column:
        return (F.col(edge)["tag"] == tag) & (F.col(edge)["kind"] == "close")

    def implied(edge: str) -> Column:
        at = F.col(edge)["pos"]
        return F.coalesce(F.when(own_end(edge), at).otherwise(at - 1), page_end)

    paired = F.when(F.col("_next_kind") == "close", F.col("_next_pos"))
    before_block = F.coalesce(F.col("_next_block")["pos"] - 1, page_end)
    end = (
        F.when(kind == "void", pos)
        .when(tag == "p", implied("_next_block"))
        .when(ranked, implied("_next_item"))
        .when(
            tag.isin(FLAT_TAGS),
            F.coalesce(paired, F.least(F.col("_next_pos") - 1, before_block)),
        )
        .when(tag.isin(INLINE_TAGS), F.coalesce(paired, before_block))
        .otherwise(F.coalesce(paired, page_end))
    )
    own_close = (
        F.when(kind == "void", True)
        .when(tag == "p", own_end("_next_block"))
        .when(ranked, own_end("_next_item"))
        .otherwise(paired.isNotNull())
    )
    # The same seen from a close tag: whether it ends an element.
    opened = F.struct(tag.alias("tag"), F.lit("open").alias("kind"))

    def own_start(edge: str) -> Column:
        return F.struct(F.col(edge)["tag"].alias("tag"), F.col(edge)["kind"].alias("kind")) == opened

    ends_one = (
        F.when(tag == "p", own_start("_last_block"))
        .when(ranked, own_start("_last_item"))
        .otherwise(F.col("_last_kind") == "open")
    )
    starts = kind.isin("open", "void")
    df = df.withColumns(
        {
            "end_pos": F.when(starts, end).cast("int"),
            "closed": F.when(starts, F.coalesce(own_close, F.lit(False))),
            "_shuts": is_close & F.coalesce(ends_one, F.lit(False)),
        }
    )
    return _within_parents(df).select(*tokens.columns, "end_pos", "closed")


def _within_parents(df: DataFrame) -> DataFrame:
    """Let elements without a close tag end before that of the closed element around them.

    That is the next close tag of their own depth, as counted over closed elements.
    """
    pos, shuts, void = F.col("pos"), F.col("_shuts"), F.col("kind") == "void"
    step = F.when(F.col("closed") & ~void, 1).when(shuts, -1).otherwise(0)
    df = df.withColumn("_around", F.sum(step).over(so_far(page_window())))
    level = F.col("_around") + F.when(shuts, 1).otherwise(0)
    df = df.withColumns({"_around": level, "_shut_at": F.when(shuts, pos)})
    shut_at = F.expr("lead(_shut_at) IGNORE NULLS OVER (PARTITION BY page_id, _around ORDER BY pos)")
    df = df.withColumn("_parent_end", shut_at)
    # Depth 0 has nothing around it.
    limit = F.when(F.col("_around") > 0, F.col("_parent_end") - 1)
    end = F.when(~F.col("closed"), F.least("end_pos", limit)).otherwise(F.col("end_pos"))
    return df.withColumn("end_pos", end)


def _next_in_page(column: str) -> Column:
    """The next filled `column` after each row, in one pass over the page."""
    return F.expr(f"lead({column}) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)")


def _item_events(df: DataFrame) -> DataFrame:
    """Add `_next_item` and `_last_item`: the tags around that end an element of `RANKS`.

    They are of the same container, and of its rank or a lower one.
    """
    tag, kind = F.col("tag"), F.col("kind")
    scope, depth, rank = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (containers, ranks) in enumerate(OPTIONAL_ENDS.items()):
        shut = tag.isin(*containers) & (kind == "close")
        member = tag.isin(*ranks) & kind.isin("open", "close")
        scope = F.when(shut | member, k).otherwise(scope)
        depth = F.when(shut | member, F.col(f"_in{k}") + F.when(shut, 1).otherwise(0)).otherwise(depth)
        for name, own in ranks.items():
            rank = F.when((tag == name) & kind.isin("open", "close"), own).otherwise(rank)
        rank = F.when(shut, 0).otherwise(rank)
    df = df.withColumns({"_scope": scope, "_depth_in": depth, "_rank": rank})
    event = F.struct("pos", "tag", "kind")
    levels = sorted(set(RANKS.values()))
    df = df.withColumns({f"_upto{r}": F.when(F.col("_rank") <= r, event) for r in levels})
    within = "OVER (PARTITION BY page_id, _scope, _depth_in ORDER BY pos)"
    ordered = Window.partitionBy("page_id", "_scope", "_depth_in").orderBy("pos")
    around = {f"_next{r}": F.expr(f"lead(_upto{r}) IGNORE NULLS {within}") for r in levels}
    around |= {f"_prev{r}": F.last(f"_upto{r}", ignorenulls=True).over(before(ordered)) for r in levels}

    def own(name: str) -> Column:
        picked = F.when(F.col("_rank") == levels[0], F.col(f"{name}{levels[0]}"))
        for r in levels[1:]:
            picked = picked.when(F.col("_rank") == r, F.col(f"{name}{r}"))
        return picked

    return df.withColumns(around).withColumns({"_next_item": own("_next"), "_last_item": own("_prev")})


def page_nodes(tokens: DataFrame) -> DataFrame:
    """Element intervals (page_id, pos, end_pos, tag, id, classes, role, href, tok).

    `with_parents` adds the tree that they form.
    """
    tags = tokens.where(F.col("kind").isin("open", "close", "void"))
    nodes = pair_tags(tags).where(F.col("end_pos").isNotNull())
    tok = F.col("tok")
    return nodes.select(
        "page_id",
        "n_tok",
        "pos",
        "end_pos",
        "closed",
        "tag",
        "kind",
        attribute(tok, "id").alias("id"),
        attribute(tok, "class").alias("classes"),
        attribute(tok, "role").alias("role"),
        attribute(tok, "href").alias("href"),
        "tok",
    )
