"""Exact duplicates by exchange of Golomb-coded fingerprints.

Each partition sends the fingerprints it holds, sorted and Golomb-coded, to the owners
of their ranges. An owner answers every message with one bit per fingerprint: set if
another partition has it too. Only texts under a set bit, or met twice in their own
partition, are read again and shuffled, and their bytes decide. Fingerprints
cost a few bytes each on the way; texts without a copy never leave their partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import golomb
from corpusloom.llm.words import SPACES
from corpusloom.sources.scratch import stored

# Deleted before texts are compared.
_DELETED = r"[\x20\x09-\x0D]+"
# Rows a partition gathers before it sends: bounds the memory of one sender.
_SENDER_ROWS = 1 << 20
# Suspects up to this count go to all executors as a list of ids (16 MB); more are joined.
BROADCAST_IDS = 1 << 20


def _cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, length in code points and digest of the normalised text of each row."""
    for batch in batches:
        text = batch["text"].cast(pa.large_string()).fill_null("")
        digests = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, SPACES)).digest() for t in text.cast(pa.large_binary())]
        chars = pc.utf8_length(text).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], chars, pa.array(digests, pa.binary())], names=["doc_id", "chars", "digest"]
        )


def _fingerprints(digests: pa.Array) -> np.ndarray:
    raw = b"".join(d[:8] for d in digests.to_pylist())
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64)


def _send(owners: int, id_type: pa.DataType):
    """Messages of a partition: its distinct fingerprints per owner, and whose they are."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        part = 0
        held, rows = [], 0
        for batch in batches:
            held.append((batch["doc_id"], _fingerprints(batch["digest"])))
            rows += batch.num_rows
            if rows >= _SENDER_ROWS:
                yield packed(f"{sender}-{part}", held)
                held, rows, part = [], 0, part + 1
        if rows:
            yield packed(f"{sender}-{part}", held)

    def packed(sender: str, held: list) -> pa.RecordBatch:
        prints = np.concatenate([p for _, p in held])
        order = np.argsort(prints, kind="stable")
        ids = pa.chunked_array([i for i, _ in held], id_type).take(pa.array(order)).combine_chunks()
        values, counts = np.unique(prints[order], return_counts=True)
        edges = np.array([(k << 64) // owners for k in range(owners)], dtype=np.uint64)
        bounds = [*np.searchsorted(values, edges).tolist(), len(values)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = [(o, i, j) for o, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]
        id_ends = pa.array([int(ends[i]) for _, i, _ in out] + [len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([sender] * len(out)),
                pa.array([o for o, _, _ in out], pa.int32()),
                pa.array([golomb.encode(values[i:j]) for _, i, j in out], pa.binary()),
                pa.array([counts[i:j].tolist() for _, i, j in out], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(id_ends, ids),
            ],
            names=["sender", "owner", "prints", "copies", "ids"],
        )

    return messages


def _answer(table: pa.Table) -> pa.Table:
    """One bit per fingerprint of each message: whether another message has it."""
    lists = [golomb.decode(b.as_py()) for b in table["prints"]]
    values = np.sort(np.concatenate(lists))
    again = values[1:][values[1:] == values[:-1]]
    marks = []
    for found in lists:
        at = np.minimum(np.searchsorted(again, found), max(len(again) - 1, 0))
        bits = again[at] == found if len(again) else np.zeros(len(found), dtype=bool)
        marks.append(np.packbits(bits).tobytes())
    return pa.table(
        {
            "sender": table["sender"].combine_chunks(),
            "owner": table["owner"].combine_chunks(),
            "marks": pa.array(marks, pa.binary()),
        }
    )


def _suspects(id_type: pa.DataType):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, copies, ids in zip(batch["marks"], batch["copies"], batch["ids"], strict=True):
                counts = np.array(copies.as_py(), dtype=np.int64)
                bits = np.unpackbits(np.frombuffer(marks.as_py(), dtype=np.uint8))[: len(counts)]
                chosen = np.repeat((bits == 1) | (counts > 1), counts)
                if chosen.any():
                    found = ids.values.filter(pa.array(chosen))
                    yield pa.RecordBatch.from_arrays([found.cast(id_type)], names=["doc_id"])

    return expand


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after every space and tab to carriage return is
    deleted; a null text counts as empty, and empty texts are equal to each other. Of
    equal texts the one with the most code points stays, then the least doc_id (a null
    id last). Rows that repeat id and text count in group_size and share their flag.
    Other columns are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    docs = docs.select("doc_id", "text")
    cards = docs.mapInArrow(_cards, f"doc_id {id_name}, chars long, digest binary")
    cards = stored(cards, "cards")

    kind = f"sender string, owner int, prints binary, copies array<int>, ids array<{id_name}>"
    sent = stored(cards.select("doc_id", "digest").mapInArrow(_send(owners, id_type), kind), "prints")
    answers = (
        sent.select("sender", "owner", "prints")
        .groupBy("owner")
        .applyInArrow(_answer, "sender string, owner int, marks binary")
    )
    told = answers.join(sent.select("sender", "owner", "copies", "ids"), ["sender", "owner"])
    told = told.select("marks", "copies", "ids")
    suspects = stored(told.mapInArrow(_suspects(id_type), f"doc_id {id_name}").distinct(), "suspects")
    if suspects.count() <= BROADCAST_IDS:
        suspects = F.broadcast(suspects)
    same_id = docs["doc_id"].eqNullSafe(suspects["doc_id"])
    read_again = docs.join(suspects, same_id, "left_semi")

    text = F.coalesce("text", F.lit(""))
    bare = read_again.select("doc_id", F.length(text).alias("chars"), F.regexp_replace(text, _DELETED, "").alias("bare"))
    # Equal bytes meet here; copies are counted before the shuffle, however many there are.
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id")).alias("best")
    groups = bare.groupBy("bare").agg(best, F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.lit(True).alias("copied"),
    )
    rows = cards.join(stored(groups, "copies"), "digest", "left")
    keep = F.when(F.col("copied"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
