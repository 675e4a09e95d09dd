"""Element selection by a small selector subset.

A selector is a list of alternatives; each alternative is a list of steps, the
last one naming the wanted element. `parse_selector` turns the usual string
spelling (type, #id, .class, [attr], =, ^=, $=, *=, descendant, child, comma)
into steps and rejects anything else before a job starts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tokens import (
    FLAT_TAGS,
    INLINE_TAGS,
    RANKS,
    VOID_TAGS,
    attribute,
    before,
    pair_tags,
    page_window,
    with_depth,
)


@dataclass(frozen=True)
class Step:
    """One compound: all given conditions must hold."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()  # (name, operator, value)
    combinator: str = " "  # how it hangs on the step before: " " or ">"

    @property
    def bare(self) -> bool:
        """A tag name alone whose nesting a running depth describes."""
        implied = {"p", *RANKS, *FLAT_TAGS, *INLINE_TAGS, *VOID_TAGS}
        return (
            self.tag is not None
            and self.tag not in implied
            and not (self.id or self.classes or self.attrs)
        )


Selector = list[list[Step]]

_NAME = r"[A-Za-z_\-][\w\-]*"
_ATTR = re.compile(
    rf"\[\s*({_NAME})\s*(?:([\^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]\"']+))\s*)?\]"
)
_COMPOUND = re.compile(rf"(?:{_NAME}|\*)?(?:#{_NAME}|\.{_NAME}|{_ATTR.pattern})*")


def parse_selector(text: str) -> Selector:
    """Split a selector string into steps; ValueError for what is not covered."""

    def fail() -> ValueError:
        return ValueError(f"unsupported selector: {text!r}")

    alternatives: Selector = [[]]
    rest, combinator = text.strip(), " "
    while True:
        found = _COMPOUND.match(rest)
        if not found or not found.group(0):
            raise fail()
        compound, rest = found.group(0), rest[found.end() :]
        attrs = tuple(
            (m[1].lower(), m[2] or "", next((v for v in m.groups()[2:] if v is not None), ""))
            for m in _ATTR.finditer(compound)
        )
        plain = _ATTR.sub("", compound)
        tag = re.match(rf"{_NAME}", plain)
        ids = re.findall(rf"#({_NAME})", plain)
        if len(ids) > 1:
            raise fail()
        alternatives[-1].append(
            Step(
                tag=tag.group(0).lower() if tag else None,
                id=ids[0] if ids else None,
                classes=tuple(re.findall(rf"\.({_NAME})", plain)),
                attrs=attrs,
                combinator=combinator,
            )
        )
        if not rest:
            return alternatives
        joint = re.match(r"\s*([>,])\s*|\s+", rest)
        if not joint:
            raise fail()
        rest, combinator = rest[joint.end() :], joint.group(1) or " "
        if combinator == ",":
            alternatives.append([])
            combinator = " "


def as_selector(selector: str | Selector) -> Selector:
    return parse_selector(selector) if isinstance(selector, str) else selector


def step_matches(step: Step) -> Column:
    """Whether an opening row of a token table satisfies one compound."""
    tok = F.col("tok")
    tests = [F.col("kind").isin("open", "void")]
    if step.tag:
        tests.append(F.col("tag") == step.tag)
    if step.id is not None:
        tests.append(attribute(tok, "id") == step.id)
    for name in step.classes:
        # Padded, so that a class name is found as a whole word.
        padded = F.concat(
            F.lit(" "), F.translate(attribute(tok, "class"), "\t\n\r\f", "    "), F.lit(" ")
        )
        tests.append(F.contains(padded, F.lit(f" {name} ")))
    for name, op, value in step.attrs:
        got, want = attribute(tok, name), F.lit(value)
        if op == "":
            tests.append(got.isNotNull())
        elif op == "=":
            tests.append(got == want)
        elif value == "":  # an empty part matches nothing
            tests.append(F.lit(False))
        else:
            tests.append({"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](got, want))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def needs_pairs(selector: Selector) -> bool:
    """Whether ancestor tests need element ends, not only running depths."""
    return any(
        not s.bare or follower.combinator != " "
        for steps in selector
        for s, follower in zip(steps, steps[1:])
    )


def pair_for(tokens: DataFrame, selector: Selector) -> DataFrame:
    """Pair tags as far as `selector` needs it."""
    tags = selector_tags(selector)
    return pair_tags(tokens, items=tags is None or bool(tags & set(RANKS)))


def selector_tags(selector: Selector) -> set[str] | None:
    """Tags the selector looks at; None when it may look at any."""
    tags = {s.tag for steps in selector for s in steps}
    child = any(s.combinator == ">" for steps in selector for s in steps[1:])
    return None if None in tags or child else tags


def with_open_count(df: DataFrame) -> DataFrame:
    """Add `_depth`: how many elements are open around each opening row."""
    starts = F.col("end_pos").isNotNull()
    row = F.struct(*df.columns)
    events = df.select(
        "page_id",
        F.explode(
            F.when(
                starts,
                F.array(
                    F.struct(F.col("pos").alias("at"), F.lit(0).alias("shut"), row.alias("row")),
                    F.struct(
                        F.col("end_pos").alias("at"),
                        F.lit(1).alias("shut"),
                        F.lit(None).cast(df.select(row).schema[0].dataType).alias("row"),
                    ),
                ),
            ).otherwise(
                F.array(F.struct(F.col("pos").alias("at"), F.lit(0).alias("shut"), row.alias("row")))
            )
        ).alias("_e"),
    ).select("page_id", "_e.*")
    starting = F.col("row")["end_pos"].isNotNull()
    step = F.when(F.col("shut") == 1, -1).when(starting, 1).otherwise(0)
    order = Window.partitionBy("page_id").orderBy("at", "shut")
    deep = events.withColumn("_depth", F.sum(step).over(before(order)))
    # page_id stays the plain column, so that the layout of the rows is still known.
    rest = [F.col("row")[c].alias(c) for c in df.columns if c != "page_id"]
    return deep.where("shut = 0").select(
        "page_id", *rest, F.coalesce("_depth", F.lit(0)).alias("_depth")
    )


def flag_matches(tokens: DataFrame, selector: str | Selector, flag: str = "matched") -> DataFrame:
    """Add the boolean `flag` to a token table: rows that open a selected element.

    Rows must carry `end_pos` when `needs_pairs(selector)`. Descendant steps are
    running values in document order, never a self-join: with ends known, a row
    lies inside some earlier match exactly if the largest end so far reaches it.
    """
    steps_list = as_selector(selector)
    base = tokens.columns
    df = tokens
    if any(s.combinator == ">" for steps in steps_list for s in steps[1:]):
        df = with_open_count(df)
    page = page_window()
    flags = []
    for a, steps in enumerate(steps_list):
        paired = needs_pairs([steps])
        inside = F.lit(True)
        for k, step in enumerate(steps):
            name = f"_s{a}_{k}"
            if k and step.combinator == ">":
                df, inside = _child_of(df, f"_s{a}_{k - 1}", name)
            df = df.withColumn(name, step_matches(step) & inside)
            flags = flags[: -1 if k else None] + [F.col(name)]
            if k == len(steps) - 1 or steps[k + 1].combinator != " ":
                continue
            if paired:
                reach = f"{name}_reach"
                df = df.withColumn(
                    reach, F.max(F.when(F.col(name), F.col("end_pos"))).over(before(page))
                )
                inside = F.coalesce(F.col(reach) >= F.col("pos"), F.lit(False))
            else:
                # Bare tags: a chain `a b` needs b's opened inside a.
                opened = F.col(name) if k else (F.col("tag") == step.tag) & (F.col("kind") == "open")
                closed = (F.col("tag") == step.tag) & (F.col("kind") == "close")
                if k:
                    closed = closed & inside
                depth = f"{name}_depth"
                df = with_depth(df, depth, opened, closed, page)
                # An element does not lie inside itself, as `ul ul` shows.
                around = F.col(depth) - F.when(opened, 1).otherwise(0)
                inside = (around > 0) & inside
    return df.withColumn(flag, reduce(lambda a, b: a | b, flags)).select(*base, flag)


def _child_of(df: DataFrame, parent: str, name: str) -> tuple[DataFrame, Column]:
    """Test of `parent` on the enclosing element."""
    up = f"{name}_up"
    return enclosing(df, parent, up), F.coalesce(F.col(up), F.lit(False))


def enclosing(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add `name`: the value of `column` on the enclosing element, NULL where there is none.

    Rows carry `_depth` (see `with_open_count`); it is the latest element one level up.
    """
    cols = df.columns
    row = F.struct(*cols)
    roles = df.select(
        "page_id",
        "pos",
        row.alias("_row"),
        F.explode(
            F.array(
                F.struct(F.col("_depth").alias("level"), F.lit(True).alias("as_parent")),
                F.struct((F.col("_depth") - 1).alias("level"), F.lit(False).alias("as_parent")),
            )
        ).alias("_role"),
    )
    starting = F.col("_row")["end_pos"].isNotNull()
    family = Window.partitionBy("page_id", "_role.level").orderBy("pos")
    is_parent = F.when(F.col("_role")["as_parent"] & starting, F.col("_row")[column])
    seen = roles.withColumn(name, F.last(is_parent, ignorenulls=True).over(before(family)))
    rest = [F.col("_row")[c].alias(c) for c in cols if c != "page_id"]
    return seen.where(~F.col("_role")["as_parent"]).select("page_id", *rest, name)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Add `parent_pos`, the place of the element around each, and `depth`, how many there are."""
    deep = enclosing(with_open_count(nodes), "pos", "parent_pos")
    return deep.withColumn("depth", F.col("_depth").cast("int")).drop("_depth")


def select_nodes(tokens: DataFrame, selector: str | Selector) -> DataFrame:
    """Selected elements as (page_id, pos, end_pos, tag)."""
    wanted = as_selector(selector)
    # Tags of other names count too: an unclosed element ends with the one around it.
    rows = tokens.where(F.col("kind").isin("open", "close", "void"))
    hits = flag_matches(pair_for(rows, wanted), wanted).where("matched")
    return hits.select("page_id", "pos", "end_pos", "tag")
