import hashlib
import random
import re

import pytest
from llm_rows import docs
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup
from corpusloom.llm.exact_dedup import exact_duplicates


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id))
    out = []
    for doc_id, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[bare])[1]
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out.append((doc_id, keep, len(groups[bare]), doc_id == keep, digest))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in exact_duplicates(df).collect())


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, " a b"), (5, None), (6, ""), (7, " \n"), (8, "AB"), (9, "é b"), (10, "éb"),
    (11, "a\x1cb"), (12, "a\x85b"), (13, "x" * 300_000), (14, "x" * 300_000), (15, "alone"), (16, "a b"), (16, "a b"),
]


def test_edge_rows(spark):
    assert found(docs(spark, ROWS)) == expected(ROWS)
    assert found(docs(spark, [])) == []


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_large_group_over_many_partitions(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(exact_dedup, "_SENDER_ROWS", 40)
    rng = random.Random(1)
    rows = [(k, "same text" + " " * rng.randrange(3) if k % 3 == 0 else f"text {rng.randrange(500)}") for k in range(900)]
    assert found(docs(spark, rows).repartition(13)) == expected(rows)


def test_null_ids_and_clashing_columns(spark):
    df = docs(spark, [(None, "a"), (4, "a"), (None, "b"), (None, "b")]).withColumn("digest", F.lit("x"))
    df = df.withColumn("keep_id", F.lit(9)).withColumn("chars", F.lit(9))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_duplicates(df).collect())
    assert got == [("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]
