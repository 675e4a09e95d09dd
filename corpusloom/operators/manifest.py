"""Site manifests: a Markdown link list per site, read line by line.

A manifest row is (site, base_url, content). All steps partition by site, that is
by one manifest text; rows move once, before the text grows into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import JS_SPACE, js_trim, ordered_concat
from corpusloom.functions.urls import (
    base_parts,
    hostname,
    normal_host,
    normal_path,
    resolve_against,
)
from corpusloom.functions.layout import computed, spread
from corpusloom.operators.tokens import before, so_far

# Fixed value: an item's link, and notes after a colon; the first match counts.
_LINK = rf"\[([^\]]+)\]\(([^)]+)\)(?:(:)[{JS_SPACE}]*(.*))?"


def _lines_window():
    return Window.partitionBy("site").orderBy("pos")


def _whole_site():
    return _lines_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _all_lines(manifests: DataFrame, *carried: str) -> DataFrame:
    """Every line, also `empty` ones, so that each site keeps at least one row."""
    text = spread(manifests.select("site", *carried, "content"), "site")
    rows = text.select(
        "site",
        *carried,
        F.posexplode_outer(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"),
    )
    rows = computed(rows, trimmed=js_trim(F.col("line")))
    t = F.col("trimmed")
    kind = (
        F.when(F.col("line") == "", "empty")
        .when(t == "", "blank")
        .when(t.startswith("# "), "h1")
        .when(t.startswith(">"), "quote")
        .when(t.startswith("## "), "h2")
        .when(t.startswith("-") | t.startswith("*"), "item")
        .otherwise("other")
    )
    return rows.withColumn("kind", kind)


def manifest_lines(manifests: DataFrame) -> DataFrame:
    """Classified lines (site, pos, line, kind); empty lines count for nothing."""
    lines = _all_lines(manifests).where(F.col("kind") != "empty")
    return lines.select("site", "pos", "line", "kind")


def _after(c: Column, n: int) -> Column:
    return js_trim(F.substring(c, n + 1, 2**31 - 1))


def manifest_header(manifests: DataFrame) -> DataFrame:
    """(site, title, description): the last first-level heading, the last quote."""
    t, kind, pos = F.col("trimmed"), F.col("kind"), F.col("pos")
    lines = _all_lines(manifests)
    return lines.groupBy("site").agg(
        F.coalesce(
            F.max_by(_after(t, 2), F.when(kind == "h1", pos)), F.lit("")
        ).alias("title"),
        F.max_by(_after(t, 1), F.when(kind == "quote", pos)).alias("description"),
    )


def manifest_details(manifests: DataFrame) -> DataFrame:
    """(site, details): free text gathered after quotes, NULL if none was kept.

    A quote starts gathering, a first-level heading stops it; a section heading
    keeps what was gathered so far and stops it, if there is anything. The end of
    the text keeps it too while gathering. Items are never gathered.
    """
    kind, pos = F.col("kind"), F.col("pos")
    lines, whole = _lines_window(), _whole_site()
    free = kind.isin("blank", "other")
    on_off = F.when(kind == "quote", 1).when(kind == "h1", 0)
    df = _all_lines(manifests).withColumn(
        "_s1", F.last(on_off, ignorenulls=True).over(before(lines))
    )
    first_free = F.min(F.when(free & (F.col("_s1") == 1), pos)).over(whole)
    df = df.withColumn("_first", first_free)
    stops = (kind == "h2") & (pos > F.col("_first"))
    switch = on_off.when(stops, 0)
    df = df.withColumn("_state", F.last(switch, ignorenulls=True).over(before(lines))).withColumn(
        "_final", F.last(switch, ignorenulls=True).over(whole)
    )
    kept_at = F.max(F.when(stops & (F.col("_state") == 1), pos)).over(whole)
    end = F.when(F.col("_final") == 1, F.lit(2**31 - 1)).otherwise(kept_at)
    df = df.withColumn("_end", end)
    gathered = free & (F.col("_state") == 1) & (pos < F.col("_end"))
    text = F.when(gathered, F.when(kind == "blank", "").otherwise(F.col("line")))
    joined = F.expr("listagg(_text, '\\n') WITHIN GROUP (ORDER BY pos)")
    return df.withColumn("_text", text).groupBy("site").agg(js_trim(joined).alias("details"))


def _sectioned(manifests: DataFrame, *carried: str) -> DataFrame:
    """Heading and item lines with the section they belong to (0: none yet)."""
    kind = F.col("kind")
    title = _after(F.col("trimmed"), 3)
    lines = _lines_window()
    head = F.when(
        kind == "h2",
        F.struct(title.alias("title"), (F.lower(title) == "optional").alias("is_optional")),
    )
    return (
        _all_lines(manifests, *carried)
        .withColumn("section_ord", F.sum(F.when(kind == "h2", 1).otherwise(0)).over(so_far(lines)))
        .withColumn("section_ord", F.col("section_ord").cast("int"))
        .withColumn("_head", F.last(head, ignorenulls=True).over(so_far(lines)))
        .withColumn("section", F.col("_head")["title"])
        .withColumn("is_optional", F.coalesce(F.col("_head")["is_optional"], F.lit(False)))
        .drop("_head")
    )


def manifest_sections(manifests: DataFrame) -> DataFrame:
    """(site, section_ord, title, is_optional), also of sections without links."""
    return (
        _sectioned(manifests)
        .where(F.col("kind") == "h2")
        .select("site", "section_ord", F.col("section").alias("title"), "is_optional")
    )


def _with_link(lines: DataFrame) -> DataFrame:
    """Add `link` (title, url, notes) to item lines of a section, else NULL."""
    text = _after(F.col("trimmed"), 1)
    is_item = (F.col("kind") == "item") & (F.col("section_ord") > 0)
    found = lines.withColumn("_text", F.when(is_item, text)).withColumn(
        "_url", F.regexp_extract("_text", _LINK, 2)
    )
    link = F.struct(
        js_trim(F.regexp_extract("_text", _LINK, 1)).alias("title"),
        js_trim(F.col("_url")).alias("url"),
        F.when(
            F.regexp_extract("_text", _LINK, 3) != "",
            js_trim(F.regexp_extract("_text", _LINK, 4)),
        ).alias("notes"),
    )
    return found.withColumn("link", F.when(F.col("_url") != "", link)).drop("_text", "_url")


def manifest_links(manifests: DataFrame) -> DataFrame:
    """(site, section_ord, pos, title, url, notes), one row per item with a link."""
    links = _with_link(_sectioned(manifests)).where(F.col("link").isNotNull())
    return links.select("site", "section_ord", "pos", "link.*")


def classified_links(manifests: DataFrame, include_optional: bool | str = False) -> DataFrame:
    """All lines with, for links, the absolute `url` and its `fate`.

    Fates: invalid, external (tested before optional), optional, kept. Hosts
    compare exactly, `www.` included. `include_optional` may name a column.
    """
    by_column = isinstance(include_optional, str)
    wanted = F.col(include_optional) if by_column else F.lit(include_optional)
    base = F.col("base_url")
    based = computed(manifests, _base=base_parts(base), _host=hostname(base))
    carried = ["_base", "_host", *([include_optional] if by_column else [])]
    lines = _with_link(_sectioned(based, *carried)).withColumn("_href", F.col("link.url"))
    df = resolve_against(lines, "_base", "_href", "url")
    df = df.withColumn("_link_host", normal_host(F.col("url")))
    fate = F.when(
        F.col("link").isNotNull(),
        F.when(F.col("_link_host").isNull(), "invalid")
        .when(F.col("_link_host") != F.col("_host"), "external")
        .when(F.col("is_optional") & ~wanted, "optional")
        .otherwise("kept"),
    )
    return df.withColumn("fate", fate).drop("_base", "_host", "_link_host", "_href")


def manifest_page_links(classified: DataFrame) -> DataFrame:
    """Pages a manifest names: (site, ord, url, title, is_full_content), duplicates kept."""
    kept = classified.where(F.col("fate") == "kept")
    return kept.select(
        "site",
        F.row_number().over(_lines_window()).alias("ord"),
        "url",
        F.col("link.title").alias("title"),
        normal_path(F.col("url")).endswith(".txt").alias("is_full_content"),
    )


def manifest_stats(classified: DataFrame, include_optional: bool = False) -> DataFrame:
    """(site, total_sections, total_links, skipped_optional, skipped_external)."""
    fate = F.col("fate")
    counted = (F.col("kind") == "h2") & (~F.col("is_optional") | F.lit(include_optional))
    return classified.groupBy("site").agg(
        F.count_if(counted).alias("total_sections"),
        F.count_if(fate == "kept").alias("total_links"),
        F.count_if(fate == "optional").alias("skipped_optional"),
        F.count_if(fate == "external").alias("skipped_external"),
    )


def manifest_section_stats(classified: DataFrame, include_optional: bool = False) -> DataFrame:
    """(site, section_ord, title, is_optional, link_count) of sections taken or with links."""
    sections = (
        classified.where(F.col("section_ord") > 0)
        .groupBy("site", "section_ord", F.col("section").alias("title"), "is_optional")
        .agg(F.count_if(F.col("fate") == "kept").alias("link_count"))
    )
    return sections.where(
        (F.col("link_count") > 0) | ~F.col("is_optional") | F.lit(include_optional)
    )


def manifest_check(looked_up: DataFrame, include_optional: bool = False) -> DataFrame:
    """Found flag, header, counters and sections per site; unusable manifests have NULLs.

    Takes the result of `lookup_manifests`. `sections` is an array of struct (title,
    is_optional, link_count), in order, of sections that are taken or have links. Each
    text is split once: its lines are counted per section, and sections per site.
    """
    usable = looked_up.where("usable")
    lines = classified_links(usable, include_optional)
    t, kind, pos, fate = F.col("trimmed"), F.col("kind"), F.col("pos"), F.col("fate")
    last_line = {"h1": _after(t, 2), "quote": _after(t, 1)}
    per_section = lines.groupBy("site", "section_ord").agg(
        F.max_by("section", pos).alias("title"),
        F.max_by("is_optional", pos).alias("is_optional"),
        *[F.count_if(fate == f).alias(f) for f in ("kept", "optional", "external")],
        *[F.max(F.when(kind == k, F.struct("pos", text.alias("text")))).alias(f"_{k}") for k, text in last_line.items()],
    )
    real = F.col("section_ord") > 0
    taken = ~F.col("is_optional") | F.lit(include_optional)
    shown = F.struct(
        "section_ord", "title", "is_optional", F.col("kept").alias("link_count")
    )
    listed = F.sort_array(F.collect_list(F.when(real & (taken | (F.col("kept") > 0)), shown)))
    totals = per_section.groupBy("site").agg(
        F.coalesce(F.max("_h1")["text"], F.lit("")).alias("title"),
        F.max("_quote")["text"].alias("description"),
        F.sum("kept").alias("total_links"),
        F.sum("optional").alias("skipped_optional"),
        F.sum("external").alias("skipped_external"),
        F.count_if(real & taken).alias("total_sections"),
        F.transform(
            listed, lambda s: F.struct(s["title"].alias("title"), s["is_optional"].alias("is_optional"), s["link_count"].alias("link_count"))
        ).alias("sections"),
    )
    return (
        looked_up.select("site", "manifest_url", F.col("usable").alias("found"))
        .join(totals, "site", "left")
        .select(
            "site",
            "found",
            F.when(F.col("found"), F.col("manifest_url")).alias("manifest_url"),
            "title",
            "description",
            "total_links",
            "skipped_optional",
            "skipped_external",
            "total_sections",
            "sections",
        )
    )
