"""How much text one task takes on."""

from pyspark.sql import functions as F

from corpusloom.functions.layout import PARTITIONS, TASK_BYTES
from corpusloom.operators.tokens import page_tokens


def tasks_of(pages):
    """Bytes of tokens in each task."""
    size = F.coalesce(F.sum(F.octet_length("tok")), F.lit(0)).alias("size")
    held = page_tokens(pages).groupBy(F.spark_partition_id().alias("task")).agg(size)
    return [r["size"] for r in held.collect()]


def large(spark, count):
    """Pages of 128 KB that compress to almost nothing; one has no markup at all."""
    html = F.when(F.col("id") > 0, F.concat(F.lit("<p>"), F.repeat(F.lit("x y "), F.lit(1 << 15))))
    return spark.range(0, count).select(F.col("id").alias("page_id"), html.alias("html"))


def test_tasks_grow_in_number_not_in_text(spark):
    cores = spark.sparkContext.defaultParallelism
    count = 64 * (cores + 1)
    once, twice = tasks_of(large(spark, count)), tasks_of(large(spark, 2 * count))
    assert len(once) > cores and len(twice) > 1.5 * len(once)
    assert max(once + twice) < 4 * TASK_BYTES
    assert 2 * sum(once) < sum(twice) + TASK_BYTES


def test_small_and_empty_tables(spark):
    assert len(tasks_of(large(spark, 1))) == 1
    assert page_tokens(large(spark, 0)).collect() == []


def test_the_setting_names_the_count(spark):
    spark.conf.set(PARTITIONS, "3")
    try:
        assert page_tokens(large(spark, 100)).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(PARTITIONS)
