"""Inputs that the given tables lack, derived from them by Spark: list changes, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First day of the invented crawl.
FIRST_DAY = "2024-01-01"


def drawn(value: Column, below: int) -> Column:
    """A number from 0 that only depends on `value`, the same in any engine."""
    return (F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % below).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """Each page with the day of its fetch, one of 400; a third lie four folders deeper."""
    later = drawn(F.concat(F.lit("fetched "), F.col("page_id").cast("string")), 400)
    return pages.select("page_id", _deeper().alias("url"), F.date_add(F.lit(FIRST_DAY).cast("date"), later).alias("fetched"))


def _deeper() -> Column:
    """The page's URL, for a third of them without what follows the path and with more of it."""
    bare = F.regexp_replace("url", "/*([?#].*)?$", "")
    lot = drawn(F.concat(F.lit("deeper "), F.col("page_id").cast("string")), 3)
    return F.when(lot == 0, F.concat(bare, F.lit("/v1/en/Api/ref"))).otherwise(F.col("url"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of lists of hosts, their parent domains, top-level domains and paths.

    Paths are listed by their first segment and by all but the last. A third of all targets is listed; half of those are removed after a while, and a
    part of these comes back with the other action.
    """
    pages = pages.select(_deeper().alias("url"))
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    folder = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]+)/[^/?#]+", 1))
    segment = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]+)", 1))
    parent = F.regexp_extract(host, r"^[^.]+\.(.+)$", 1)
    named = F.array(
        F.struct(F.lit("hosts").alias("list"), host.alias("target")),
        F.struct(F.lit("domains").alias("list"), parent.alias("target")),
        F.struct(
            F.lit("paths").alias("list"),
            F.when(segment != "", F.concat(host, F.lit("/"), segment)).otherwise("").alias("target"),
        ),
        F.struct(F.lit("folders").alias("list"), F.when(folder != "", F.concat(host, folder)).otherwise("").alias("target")),
        F.struct(F.lit("top").alias("list"), F.substring_index(host, ".", -1).alias("target")),
    )
    entries = pages.select(F.inline(named)).where("target <> ''").distinct()
    key = F.concat("list", F.lit(" "), "target")
    entries = entries.withColumn("lot", drawn(key, 36)).where("lot < 12")
    begin = F.date_add(F.lit(FIRST_DAY).cast("date"), drawn(F.concat(F.lit("from "), key), 300) - 20)
    last = drawn(F.concat(F.lit("days "), key), 120) + 1
    action = F.when(F.col("lot") % 3 == 0, "allow").otherwise("block")
    other = F.when(F.col("lot") % 3 == 0, "block").otherwise("allow")
    steps = F.array(
        F.struct(begin.alias("day"), action.alias("action")),
        F.when(F.col("lot") % 2 == 0, F.struct(F.date_add(begin, last).alias("day"), F.lit("remove").alias("action"))),
        F.when(F.col("lot") % 4 == 0, F.struct(F.date_add(begin, last * 2).alias("day"), other.alias("action"))),
    )
    changes = entries.select("list", "target", F.explode(steps).alias("step")).where("step IS NOT NULL")
    return changes.select("list", "target", "step.day", "step.action")


# Tools of the derived conversations and what their arguments must look like.
TOOLS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
        "additionalProperties": False,
    },
    "fetch": {
        "type": "object",
        "required": ["url"],
        "properties": {"url": {"type": "string"}, "retries": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    },
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations in which assistants call tools and the next user turn is the result.

    Names, arguments and what a call waits for follow from the texts; some arguments
    break their schema, some calls name no known tool, some results answer no call. In
    half of the conversations the numbers of the ids start again every four turns.
    """
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    lot = drawn(F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 60)
    rows = conversations.select("conv_id", "turn", "role", "text", words.alias("words"), lot.alias("lot"))
    query = F.trim(F.coalesce("text", F.lit("")))
    limit = F.col("lot") % 60
    search = F.when(
        F.col("lot") % 7 == 0, F.to_json(F.struct(query.alias("query"), limit.cast("string").alias("limit")))
    ).otherwise(F.to_json(F.struct(query.alias("query"), limit.alias("limit"))))
    fetch = F.to_json(
        F.struct(
            F.concat(F.lit("https://example.com/"), F.element_at("words", 1)).alias("url"),
            (F.col("lot") % 4).cast("double").alias("retries"),
        )
    )
    again = drawn(F.concat(F.lit("ids "), F.col("conv_id").cast("string")), 2) == 0

    def number(turn: Column) -> Column:
        return F.when(again, F.pmod(turn, F.lit(4))).otherwise(turn).cast("string")

    turn = number(F.col("turn"))

    def call(suffix: str, name: Column, arguments: Column, after: Column) -> Column:
        return F.struct(
            F.concat(F.lit("call-"), turn, F.lit(suffix)).alias("id"),
            name.alias("name"), arguments.alias("arguments"), after.alias("after"),
        )

    before = F.when(F.col("lot") % 2 == 0, F.concat(F.lit("call-"), number(F.col("turn") - 2)))
    first = call("", F.when(F.col("lot") % 11 == 0, "guess").otherwise("search"), search, before)
    second = call("-b", F.lit("fetch"), fetch, F.concat(F.lit("call-"), turn))
    calls = F.when(F.col("lot") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    answers = F.when(F.col("turn") > 0, F.concat(F.lit("call-"), number(F.col("turn") - 1)))
    return rows.select(
        "conv_id", "turn", "text",
        F.when(F.col("role") == "assistant", calls).alias("calls"),
        F.when(F.col("role") == "user", answers).alias("answers"),
    )
