"""Tables that later joins read where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.sources.scratch import scratch_path


def bucketed(df: DataFrame, name: str, key: str, **options: str) -> DataFrame:
    """Write `df` once into buckets by `key`, in the shared folder, and read it back.

    Joins and groups on `key` do not shuffle it again. It has as many buckets as the session
    has shuffle partitions; its name in the session's catalog is as unique as its path.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).options(path=path, **options).saveAsTable(table)
    return spark.table(table)
