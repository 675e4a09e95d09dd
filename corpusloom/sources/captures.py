"""Captured pages and settings, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("captured_at", T.TimestampType()),
    ]
)

# NULL means: not set here.
SITE_CONFIG = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("follow_selector", T.StringType()),
        T.StructField("content_selector", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("use_native_md", T.BooleanType()),
        T.StructField("use_manifest", T.BooleanType()),
        T.StructField("include_optional", T.BooleanType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages from parquet; unused columns are not read.

    Status and captured_at are there where the table records them.
    """
    rows = spark.read.parquet(path)
    fields = [f for f in PAGES.fields if f.name in rows.columns]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def write_clustered_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by page_id, so that structure jobs run without a shuffle.

    Read it with `spark.table` and pass `clustered=True` to the operators.
    """
    (
        pages.repartition(buckets, "page_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "page_id")
        .sortBy("page_id")
        .saveAsTable(table)
    )


def captured(pages: DataFrame) -> DataFrame:
    """Add `ok`; where no status is recorded at all, captures count as answered."""
    if "status" in pages.columns:
        return pages.withColumn("ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    return pages.withColumn("ok", F.lit(True))


def newest(df: DataFrame, *rest: str) -> Column:
    """Order of captures of one key: by `captured_at` where the table has it, then `rest`."""
    time = ["captured_at"] if "captured_at" in df.columns else []
    return F.struct(*time, *rest)


# Characters of a text by which captures of one time are put in order.
_HEAD = 64


def is_ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _stamped(captures: DataFrame, key: str, value: str) -> DataFrame:
    """Answered captures with `_at` and `_digest`, by which one of them is found again."""
    time = F.col("captured_at") if "captured_at" in captures.columns else F.lit(0)
    answered = captures.where(is_ok(F.col("status")))
    return answered.select(key, value, time.alias("_at"), F.xxhash64(value).alias("_digest"))


def newest_answers(
    captures: DataFrame, key: str, value: str, last: bool = False, **flags: Column
) -> DataFrame:
    """(key, _at, _digest, _copies, flags): each key's newest answered capture.

    `flags` say what must be known of `value`; only they, its first characters and a digest
    are grouped, never the value itself. Of captures of one time the first by their
    beginning counts (the last, if `last`), then by digest; `_copies` counts those that are
    equal in all. `fetched` brings the values.
    """
    head = F.left(F.col(value), F.lit(_HEAD)).alias("_head")
    stamped = _stamped(captures, key, value)
    narrow = stamped.select(key, "_at", head, "_digest", *[c.alias(name) for name, c in flags.items()])
    copies = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_copies"))
    one = (F.max if last else F.min)(F.struct("_head", "_digest", "_copies", *flags)).alias("_one")
    newest_one = F.max(F.struct("_at", "_one")).alias("_new")
    of_each = copies.groupBy(key, "_at").agg(one).groupBy(key).agg(newest_one)
    return of_each.select(key, "_new._at", "_new._one.*").drop("_head")


def fetched(asked: DataFrame, captures: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """`asked` (key, _at, _digest, _copies, ...; one row per `row`) with the `value` it names.

    Values move once, to where they are asked for. Only captures that were stored more than
    once, equal in all, are grouped.
    """
    source = _stamped(captures, key, value).toDF("_key", value, "_at_", "_digest_")
    same = (
        (F.col(key) == F.col("_key"))
        & (F.col("_digest") == F.col("_digest_"))
        & F.col("_at").eqNullSafe(F.col("_at_"))
    )
    kept = [c for c in asked.columns if c not in ("_at", "_digest", "_copies")]
    once = asked.where("_copies = 1").join(source, same).select(*kept, value)
    again = asked.where("_copies > 1").join(source, same).select(*kept, value)
    return once.unionByName(again.dropDuplicates([row]))


def read_site_config(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Per-domain settings from a file set with the fixed schema."""
    return spark.read.schema(SITE_CONFIG).format(fmt).load(path)


def as_site_config(df: DataFrame) -> DataFrame:
    """Bring a table with some of the settings to the full schema."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SITE_CONFIG.fields
        ]
    )
