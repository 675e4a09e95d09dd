"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import stored


# Links that one task takes on; a small graph needs no more tasks than that.
_LINKS_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (a, b): root is the component's least node.

    Large-star and small-star steps hang each node under ever lower neighbours until
    nothing changes, which takes about log(n) rounds; each round is two shuffles of
    narrow rows, and its minima are written first, so that the joins on them have two
    plain sides and a node with very many neighbours is split. Null ends and loops are
    ignored; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct()
    links = stored(links, "links")
    before, now = None, _mark(links)
    while now != before:
        tasks = 1 + 2 * now[0] // _LINKS_PER_TASK
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        least = F.least(F.min("v"), F.col("u"))
        links = stored(_hung(both, least, F.col("v") > F.col("u"), tasks).coalesce(tasks), "links").distinct()
        least = F.min("v")
        # The least neighbour itself has nothing lower here; its node keeps the link.
        kept = _hung(links, least, F.col("v") > F.col("m"), tasks)
        tops = links.groupBy("u").agg(F.min("v").alias("v"))
        links = stored(kept.union(tops).distinct().coalesce(tasks), "links")
        before, now = now, _mark(links)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _hung(links: DataFrame, least: Column, moved: Column, tasks: int) -> DataFrame:
    """Link every `moved` neighbour v of u to the least of u's neighbours instead."""
    minima = stored(links.groupBy("u").agg(least.alias("m")).coalesce(tasks), "minima")
    joined = links.join(minima, "u").where(moved)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _mark(links: DataFrame) -> tuple:
    """Tells two edge tables apart: their size and two sums over their rows."""
    one, two = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    wide = "decimal(38,0)"
    return tuple(links.agg(F.count("*"), F.sum(one.cast(wide)), F.sum(two.cast(wide))).first())
