"""The written corpus: one row per document, partitioned by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.naming import last_per_name, named_documents

CORPUS = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("domain", T.StringType()),
    ]
)


def corpus_documents(documents: DataFrame, order: list[str]) -> DataFrame:
    """(domain, slug, url, title, body): the last document per name, bodies only.

    Where `order` leaves two documents equal, site and URL decide.
    """
    named = named_documents(documents.where(F.col("body").isNotNull()))
    order = [*order, *(c for c in ("site", "url") if c in named.columns and c not in order)]
    return last_per_name(named, order).select(
        "slug", "url", "title", "body", "domain"
    )


def write_corpus(documents: DataFrame, path: str, order: list[str]) -> None:
    """Write documents (url, title, body, ...) as parquet partitioned by domain.

    Rows are rebalanced by domain, which splits large domains over many files and
    keeps small ones in one.
    """
    rows = corpus_documents(documents, order)
    rows.hint("rebalance", "domain").write.mode("overwrite").partitionBy("domain").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The written corpus; filters on `domain` prune whole folders."""
    return spark.read.schema(CORPUS).parquet(path)


def export_text(corpus: DataFrame, path: str) -> None:
    """Bodies as text files per domain, one document per record separator line."""
    corpus.select("domain", F.col("body").alias("value")).write.mode("overwrite").option(
        "lineSep", "\n\x1e\n"
    ).partitionBy("domain").text(path)


def list_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(domain, n_files) of a written corpus; bodies are not read."""
    return read_corpus(spark, path).groupBy("domain").agg(F.count("*").alias("n_files"))
