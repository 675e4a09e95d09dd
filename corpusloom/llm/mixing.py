"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of all words by its weight. Shares above `max_epochs` times
what the source holds are clamped there, and the excess goes to the others by weight,
until none is above. A document is then taken a whole number of times: each one as
often as its source's share goes into it whole, and documents in seeded order once more
until the rest of the share is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.layout import computed
from corpusloom.sources.scratch import stored

# Hex digits of a document's hash that name its slice: 4,096 slices of each source, so
# that running sums over a source of any size are sums of small pieces.
_SLICE_DIGITS = 3


def with_words(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Add the number of words: runs of other characters than space and tab to return."""
    space = r"\x20\x09-\x0D"
    # One x per word: the pattern takes the blanks around it along.
    marks = F.regexp_replace(text, f"[{space}]*+[^{space}]++[{space}]*+", "x")
    docs = computed(docs, **{f"{name}_marks": marks})
    count = F.when(F.col(f"{name}_marks").startswith("x"), F.length(f"{name}_marks")).otherwise(0)
    return docs.withColumn(name, count.cast("long")).drop(f"{name}_marks")


def capped_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target` to `sources` (source, source_size, weight): words the mix should hold.

    Targets add up to all words unless every source is clamped. Null, zero or negative
    weights get nothing. One row of sums per round comes to the driver; every round
    clamps another source or is the last.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("double")
    limit = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    total, free = sources.agg(F.sum("source_size").cast("double"), F.sum(weight)).first()
    level, clamped = (total / free if free else 0.0), -1
    while free:
        over = weight * level >= limit
        fixed, free, count = sources.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if count == clamped or not free:
            break
        level, clamped = (total - fixed) / free, count
    return sources.withColumn("target", F.least(weight * level, limit))


def mixed(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """`docs` (doc_id, source, text and any others) with how often the mix takes each row.

    `weights` has a row per source (source, weight); a null source is a source, and one
    without weight gives nothing. Adds size, source_size, target, copies, taken (copies
    times size), in place of columns of those names. A source's taken words miss its
    target by at most half of one document, and no document is taken more than
    `max_epochs` times. A null text has size 0. Equal ids share their place in the
    seeded order, smaller sizes first; reruns agree. No rows give no rows.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = with_words(docs, name="mix_size").withColumn("mix_order", order)
    sized = sized.withColumn("mix_slice", F.substring("mix_order", 1, _SLICE_DIGITS))
    # A key without nulls: the join and the window then share one layout.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = sized.withColumn("mix_source", key)

    slices = sized.groupBy("source", "mix_source", "mix_slice").agg(F.sum("mix_size").alias("slice_size"))
    slices = stored(slices, "slices")
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    weights = weights.select(F.col("source").alias("named"), "weight")
    sources = sizes.join(weights, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    targets = capped_targets(stored(sources, "sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    targets = stored(targets.withColumn("rest", rest).withColumnRenamed("source", "named"), "targets")

    # Slices before this one take part of the rest; what remains is the slice's room.
    before = Window.partitionBy("source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.coalesce(F.sum("slice_size").over(before), F.lit(0))
    slices = slices.join(targets, F.col("source").eqNullSafe(F.col("named")))
    facts = ["source_size", "target", "whole", "rest", "room"]
    slices = slices.withColumn("room", room).select("mix_source", "mix_slice", *[F.col(c).alias(f"mix_{c}") for c in facts])
    placed = sized.join(stored(slices, "rooms"), ["mix_source", "mix_slice"])
    inside = Window.partitionBy("mix_source", "mix_slice").orderBy("mix_order", "doc_id", "mix_size")
    earlier = F.coalesce(F.sum("mix_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The document on the edge is in if at least half of it fits.
    extra = (earlier + F.col("mix_size") / 2 <= F.col("mix_room")) & (F.col("mix_rest") > 0)
    copies = (F.col("mix_whole") + extra.cast("long")).alias("copies")
    found = [F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target")]
    rows = placed.select(*docs.columns, *found, copies)
    return rows.withColumn("taken", F.col("copies") * F.col("size"))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its `copies` say."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.where("copies > 0").select("*", times.alias("mix_copy")).drop("mix_copy")


def ranked_weights(docs: DataFrame, weights: list[int], source: str = "source") -> DataFrame:
    """A weight for each source: `weights` in turn, by code point order, null last.

    Sources are settings of a mix, so ranking their names in one task is safe.
    """
    names = docs.select(F.col(source).alias("source")).distinct()
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return names.select("source", _nth(weights, turn % len(weights)).alias("weight"))


def _nth(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
