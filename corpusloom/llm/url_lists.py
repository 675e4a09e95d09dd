"""URL filters whose lists change over time, evaluated as of each capture's fetch.

List entries come as dated changes: an entry is added, changed or removed on a day. Per
entry they become validity intervals, which do not overlap. Captures meet the entries
of their host, its parent domains and their path prefixes that were active when they
were fetched, and the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.layout import computed

# Days per period: an entry is joined once for each period in which it is active.
PERIOD_DAYS = 32


def validity(changes: DataFrame) -> DataFrame:
    """Intervals (list, target, action, valid_from, valid_to) of dated changes.

    `changes` has list, target, day, action ('block', 'allow' or 'remove'). A target is
    a domain, which covers its subdomains, or a domain with a path prefix. A change
    holds from its day until the entry's next change; valid_to is null while none
    follows. Of changes on one day a removal counts last, then block, then allow, so
    the strictest entry left is known. Rows lacking any of the four are no change;
    repeated changes count once.
    """
    whole = changes.dropna(subset=["list", "target", "day", "action"])
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    target = F.regexp_replace(F.lower("target"), "/+$", "")
    daily = whole.groupBy("list", target.alias("target"), "day").agg(F.max_by("action", rank).alias("action"))
    turn = Window.partitionBy("list", "target").orderBy("day")
    spans = daily.withColumn("valid_to", F.lead("day").over(turn)).withColumnRenamed("day", "valid_from")
    return spans.where("action <> 'remove'").select("list", "target", "action", "valid_from", "valid_to")


def url_targets(
    url: Column, depths: Column | None = None, sizes: Column | None = None, top_level: bool = True
) -> Column:
    """Targets that cover a URL, most specific first: path prefixes, host, parents.

    All of them, however long the path or the host is. `depths` and `sizes` (falling
    numbers of path segments and of domain labels) leave only the prefixes and parents
    that have so many; the host always stays. A parent of one label, such as a top-level
    domain, is left out without `top_level`.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    least = 1 if top_level else 2
    prefixes = F.transform(
        _falling(depths, F.lit(1), F.size(segments)),
        lambda n: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(segments, 1, n), "/"))),
    )
    parents = F.transform(
        _falling(sizes, F.lit(least), F.size(labels) - 1), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    return F.when(host != "", F.concat(prefixes, F.array(host), parents)).otherwise(F.array().cast("array<string>"))


def _falling(numbers: Column | None, first: Column, last: Column) -> Column:
    """`numbers`, by default all, that are between the two, largest first."""
    if numbers is not None:
        return F.filter(numbers, lambda n: (n >= first) & (n <= last))
    return F.when(first <= last, F.sequence(last, first, F.lit(-1))).otherwise(F.array().cast("array<int>"))


def judged(captures: DataFrame, changes: DataFrame, top_level: bool = True) -> DataFrame:
    """Per row of `captures` (page_id, url, fetched): the verdict of the lists that day.

    Returns page_id, fetched, action ('block', 'allow' or null if no entry was active),
    list, target and active (number of active entries that cover the URL). The most
    specific target decides (a path prefix before the host, the host before parents);
    among equals block goes before allow, then the least list name. A null or
    unparsable url and a null day match nothing. page_id tells rows apart: rows that
    repeat it are judged together if url and day are equal too, and give one row each.
    Other columns are not looked at; no rows give no rows. Entries may name any number of
    path segments and domain labels; one on a bare top-level domain covers the hosts
    below it, or just a host of that name where `top_level` is False.

    A URL is keyed by those prefixes and parents whose length occurs among the entries,
    so that a very long path does not grow with the square of its length. Both sides are keyed by target and period of days, so that a host with very many
    captures is split by time, and further by adaptive execution.
    """
    day = F.col("fetched").cast("date")
    rows = captures.select("page_id", "url", day.alias("fetched"))
    target = F.regexp_replace(F.lower("target"), "/+$", "")
    named = changes.select(
        (F.size(F.split(target, "/")) - 1).alias("depth"),
        F.when(~F.contains(target, F.lit("/")), F.size(F.split(target, r"\."))).alias("size"),
    )
    lengths = named.agg(*[F.sort_array(F.collect_set(c), asc=False).alias(f"{c}s") for c in ("depth", "size")])
    keyed = rows.distinct().crossJoin(F.broadcast(lengths))  # one row of two short arrays
    keyed = computed(keyed, targets=url_targets(F.col("url"), F.col("depths"), F.col("sizes"), top_level))
    keyed = keyed.select("page_id", "url", "fetched", F.posexplode("targets").alias("depth", "target"))
    keyed = keyed.withColumn("period", _period(F.col("fetched")))

    # Intervals are cut to the days on which anything was fetched.
    days = rows.agg(F.min("fetched").alias("first_day"), F.max("fetched").alias("last_day"))
    spans = validity(changes).crossJoin(F.broadcast(days))  # one row of two days
    begin = F.greatest("valid_from", "first_day")
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last_day")), F.col("last_day"))
    spans = spans.where(begin <= end)
    periods = F.explode(F.sequence(_period(begin), _period(end))).alias("period")
    spans = spans.select("list", "target", "action", "valid_from", "valid_to", periods)

    active = keyed.join(spans, ["target", "period"]).where(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    order = F.struct("depth", (F.col("action") != "block").alias("lenient"), "list", "target", "action")
    verdicts = active.groupBy("page_id", "url", "fetched").agg(F.min(order).alias("best"), F.count("*").alias("active"))
    verdicts = verdicts.toDF("page_id_", "url_", "fetched_", "best", "active")
    same = (
        rows["page_id"].eqNullSafe(verdicts["page_id_"])
        & rows["url"].eqNullSafe(verdicts["url_"])
        & rows["fetched"].eqNullSafe(verdicts["fetched_"])
    )
    return rows.join(verdicts, same, "left").select(
        "page_id", "fetched", "best.action", "best.list", "best.target", F.coalesce("active", F.lit(0)).alias("active")
    )


def _period(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / PERIOD_DAYS).cast("int")
