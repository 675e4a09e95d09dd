"""The corpus pipeline: documents through filters, mixing and sharding, one stage at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.llm import toxicity
from corpusloom.llm.decontam import without_leaks
from corpusloom.llm.mixing import mixed, ranked_weights, repeated
from corpusloom.llm.ngram_join import similarity_classes
from corpusloom.llm.queries import CATEGORIES, SHARDS, SLOTS, toxicity_labels
from corpusloom.llm.sharding import placed
from corpusloom.sources.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Removed rows whose keys take up to this many bytes go to all executors; more are joined.
BROADCAST_BYTES = 16 << 20
# A key with its hash table entry; ids longer than a few words count their own bytes.
_KEY_BYTES = 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a chain fitted on the labelled ones flags as toxic go.

    Documents without text, and all documents if nothing is labelled, stay.
    """
    chain = toxicity.train(docs, toxicity_labels(spark, sf_dir), CATEGORIES)
    return toxicity.without(docs, chain, CATEGORIES.index("toxic"))


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: the id, in its order and null last, then a digest of the text."""
    kind, doc_id = docs.schema["doc_id"].dataType, F.col("doc_id")
    if isinstance(kind, IntegralType):
        # With the sign bit turned, bytes sort as the numbers do.
        ordered = F.unhex(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        ordered = F.encode(doc_id.cast("string"), "UTF-8")
    named = F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), ordered))
    said = F.when(F.col("text").isNull(), F.unhex(F.lit("00"))).otherwise(F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    return F.concat(named, said)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts stays: the least id (null last), then text digest.

    Texts are similar from 0.8 of their five-word shingles on; texts without words are
    similar to none, and all stay. Rows are told apart by id and text, so a row that shares
    its id with a copy of something stays; of rows that repeat both, one stays.
    """
    keyed = docs.withColumn("_key", row_key(docs))
    classes = similarity_classes(keyed.select(F.col("_key").alias("doc_id"), "text"), width=5, percent=80)
    classes = stored(classes.where("n_shingles > 0"), "similar")
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_key")).distinct()
    named = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n"))
    gone, repeated_rows = stored(gone, "gone"), stored(named.where("n > 1").select("_key"), "repeated-rows")
    left = keyed.join(_small(gone), "_key", "left_anti")
    if repeated_rows.limit(1).count():
        # Rows equal in id and text meet; one of them stays, counted before the shuffle.
        again = left.join(_small(repeated_rows), "_key", "left_semi").dropDuplicates(["_key"])
        left = left.join(_small(repeated_rows), "_key", "left_anti").unionByName(again)
    return left.select(docs.columns)


def _small(keys: DataFrame) -> DataFrame:
    """Keys that all executors may hold, marked so; others as they are."""
    size = keys.agg(F.sum(F.octet_length("_key") + _KEY_BYTES)).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take its error budget, go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; sources weigh 5, 2, 1 in turn, 3 epochs at most."""
    rows = mixed(docs, ranked_weights(docs, [5, 2, 1]), max_epochs=3, seed=7)
    return repeated(rows).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the slot and shard of their id."""
    return placed(docs, SHARDS, SLOTS, F.col("doc_id"), F.col("text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("similar", keep_one_of_similar),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Fitted models, edit distances and hashed lists are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
