"""Selectors as data: every page brings its own, and one pass matches them all.

Pages are keyed by a struct that holds a `selector` (see `asked_pages`). A selector string
becomes a grid of steps, alternative by alternative, through column expressions; a token
is tested against the steps of its own page. Step k of all alternatives is then decided
at once, from what step k - 1 found: a descendant step by a running maximum of element
ends, a child step by the enclosing element. The plan grows with the longest selector,
never with how many there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import js_trim
from corpusloom.operators.selectors import enclosing, with_open_count
from corpusloom.operators.tokens import attributes, before, page_tokens, page_window, pair_tags

# The same spelling as `parse_selector` takes.
_NAME = r"[A-Za-z_\-][\w\-]*"
_ATTR = rf"""\[\s*{_NAME}\s*(?:[\^$*]?=\s*(?:"[^"]*"|'[^']*'|[^\s\]"']+)\s*)?\]"""
_MARK = rf"(?:#{_NAME}|\.{_NAME}|{_ATTR})"
_COMPOUND = rf"(?:(?:{_NAME}|\*){_MARK}*|{_MARK}+)"
_JOINT = r"(?:\s*[>,]\s*|\s+)"
_WHOLE = rf"(?U)^{_COMPOUND}(?:{_JOINT}{_COMPOUND})*$"
_PIECE = rf"(?U)(?:^|{_JOINT}){_COMPOUND}"
# No compound may name two ids; attributes are cut out before the test.
_TWO_IDS = rf"(?U)#{_NAME}(?:\.{_NAME}|\[\])*#"


def is_supported(selector: Column) -> Column:
    """Whether `parse_selector` would take the selector; a null or blank one is not."""
    text = js_trim(selector)
    bare = F.regexp_replace(text, rf"(?U){_ATTR}", "[]")
    return F.coalesce(text.rlike(_WHOLE) & ~bare.rlike(_TWO_IDS), F.lit(False))


def _steps(selector: Column) -> Column:
    """Array of steps (alt, step, child, last, tag, id, classes, attrs) of a selector string."""
    text = js_trim(selector)
    text = F.when(is_supported(selector), text).otherwise(
        F.raise_error(F.concat(F.lit("unsupported selector: "), F.coalesce(selector, F.lit(""))))
    )
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    joints = F.transform(pieces, lambda p: F.regexp_extract(p, r"(?U)^\s*([>,]?)", 1))

    def step(piece: Column, i: Column) -> Column:
        upto = F.slice(joints, F.lit(1), i + 1)
        alt = F.size(F.filter(upto, lambda j: j == ","))
        since = F.nullif(F.array_position(F.reverse(upto), ","), F.lit(0).cast("long"))
        begun = F.size(upto) - F.coalesce(since, F.size(upto))
        compound = F.regexp_replace(piece, r"(?U)^\s*[>,]?\s*", "")
        plain = F.regexp_replace(compound, rf"(?U){_ATTR}", "")

        def attr(a: Column) -> Column:
            raw = F.regexp_extract(a, rf"(?Us)^\[\s*{_NAME}\s*[\^$*]?=\s*(.*?)\s*\]$", 1)
            return F.struct(
                F.lower(F.regexp_extract(a, rf"(?U)^\[\s*({_NAME})", 1)).alias("name"),
                F.regexp_extract(a, rf"(?U)^\[\s*{_NAME}\s*([\^$*]?=)", 1).alias("op"),
                F.regexp_replace(raw, """(?s)^"(.*)"$|^'(.*)'$""", "$1$2").alias("value"),
            )

        return F.struct(
            alt.alias("alt"),
            (i - begun).cast("int").alias("step"),
            (F.get(joints, i) == ">").alias("child"),
            F.coalesce(F.get(joints, i + 1) == ",", F.lit(True)).alias("last"),
            F.lower(F.regexp_extract(plain, rf"(?U)^{_NAME}", 0)).alias("tag"),
            F.regexp_extract(plain, rf"(?U)#({_NAME})", 1).alias("id"),
            F.regexp_extract_all(plain, F.lit(rf"(?U)\.({_NAME})"), F.lit(1)).alias("classes"),
            F.transform(F.regexp_extract_all(compound, F.lit(rf"(?U){_ATTR}"), F.lit(0)), attr).alias("attrs"),
        )

    return F.transform(pieces, step)


@dataclass(frozen=True)
class OwnSelectors:
    """How large the grid must be for the selectors of a table."""

    alternatives: int
    steps: int
    child_steps: frozenset[int]

    @classmethod
    def of(cls, table: DataFrame, column: str) -> OwnSelectors:
        """The sizes over all selectors of a column: three numbers, whatever the rows.

        A selector that is not supported raises when it is read (see `is_supported`).
        """
        steps = table.select(F.explode(_steps(F.col(column))).alias("s"))
        found = steps.agg(
            F.max("s.alt").alias("alt"), F.max("s.step").alias("step"),
            F.collect_set(F.when(F.col("s.child"), F.col("s.step"))).alias("child"),
        ).first()
        return cls((found["alt"] or 0) + 1, (found["step"] or 0) + 1, frozenset(found["child"]))

    def grid(self, steps: Column) -> Column:
        """Steps by alternative and number; null where a selector has none."""

        def at(alt: int, k: int) -> Column:
            found = F.filter(steps, lambda s: (s["alt"] == alt) & (s["step"] == k))
            return F.try_element_at(found, F.lit(1))

        return F.array(*[at(a, k) for a in range(self.alternatives) for k in range(self.steps)])


def asked_pages(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Pages once per selector asked of them, keyed by struct (page_id, selector).

    `asked` (page_id, selector) has a row per page and selector; it is joined by page_id.
    """
    rows = pages.join(asked.distinct(), "page_id")
    return rows.withColumn("page_id", F.struct("page_id", "selector")).drop("selector")


def _matches(step: Column) -> Column:
    """Whether a token row satisfies one compound."""

    def value(name: Column) -> Column:
        named = F.filter("_attrs", lambda a: a["name"] == name)
        return F.try_element_at(named, F.lit(1))["value"]

    padded = F.concat(F.lit(" "), F.translate(value(F.lit("class")), "\t\n\r\f", "    "), F.lit(" "))

    def attr(a: Column) -> Column:
        got, want = value(a["name"]), a["value"]
        part = F.when(want == "", False)  # an empty part matches nothing
        return F.coalesce(
            F.when(a["op"] == "", got.isNotNull())
            .when(a["op"] == "=", got == want)
            .when(a["op"] == "^=", part.otherwise(F.startswith(got, want)))
            .when(a["op"] == "$=", part.otherwise(F.endswith(got, want)))
            .otherwise(part.otherwise(F.contains(got, want))),
            F.lit(False),
        )

    return F.coalesce(
        ((step["tag"] == "") | (step["tag"] == F.col("tag")))
        & ((step["id"] == "") | (value(F.lit("id")) == step["id"]))
        & F.forall(step["classes"], lambda c: F.coalesce(F.contains(padded, F.concat(F.lit(" "), c, F.lit(" "))), F.lit(False)))
        & F.forall(step["attrs"], attr),
        F.lit(False),
    )


def own_tokens(pages: DataFrame, own: OwnSelectors, clustered: bool = False) -> DataFrame:
    """Paired tokens of pages keyed by `asked_pages`, plus `matched` by each page's own selector."""
    also = {"_steps": _steps(F.col("page_id")["selector"]), "_grid": own.grid(F.col("_steps"))}
    tokens = page_tokens(pages, clustered, also=also)
    base = [c for c in tokens.columns if c not in also]
    starts = F.col("kind").isin("open", "void")
    needed = F.exists("_grid", lambda s: (s["id"] != "") | (F.size(s["classes"]) > 0) | (F.size(s["attrs"]) > 0))
    tokens = tokens.withColumn("_attrs", F.when(starts & needed, attributes(F.col("tok"))))
    tokens = tokens.select(
        *base,
        F.when(starts, F.transform("_grid", lambda s: F.when(s.isNotNull(), _matches(s)))).alias("_hits"),
        F.transform("_grid", lambda s: s["child"]).alias("_child"),
        F.transform("_grid", lambda s: s["last"]).alias("_last"),
    )
    df = pair_tags(tokens)
    kept = [*base, "end_pos", "closed"]
    if own.child_steps:
        df = with_open_count(df)
    page, pos, flags = page_window(), F.col("pos"), []
    for k in range(own.steps):
        found = {}
        for a in range(own.alternatives):
            place = a * own.steps + k
            hit = F.coalesce(F.col("_hits")[place], F.lit(False))
            if k:
                inside = F.coalesce(F.col(f"_reach{a}") >= pos, F.lit(False))
                if k in own.child_steps:
                    up = F.coalesce(F.col("_up")[a], F.lit(False))
                    inside = F.when(F.col("_child")[place], up).otherwise(inside)
                hit = hit & inside
            found[f"_m{a}_{k}"] = hit
            flags.append(F.col(f"_m{a}_{k}") & F.coalesce(F.col("_last")[place], F.lit(False)))
        df = df.withColumns(found).drop("_up")
        if k + 1 < own.steps:
            ends = {a: F.when(F.col(f"_m{a}_{k}"), F.col("end_pos")) for a in range(own.alternatives)}
            df = df.withColumns({f"_reach{a}": F.max(end).over(before(page)) for a, end in ends.items()})
            if k + 1 in own.child_steps:
                df = df.withColumn("_now", F.array(*[F.col(f"_m{a}_{k}") for a in range(own.alternatives)]))
                df = enclosing(df, "_now", "_up").drop("_now")
    return df.withColumn("matched", reduce(lambda x, y: x | y, flags)).select(*kept, "matched")
