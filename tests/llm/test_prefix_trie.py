"""The trie against a walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import prefix_trie as pt

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], TURNS)


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    said = {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(said[c]) == len(path))
        out[path] = {
            "conv_id": min(convs), "depth": len(path), "n_convs": len(convs), "n_children": 0, "n_leaves": 0, "saved_tokens": 0,
            "parent_conv_id": min(members[path[:-1]]) if path else None,
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        }
    for path in members:
        if path:
            out[path[:-1]]["n_children"] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            out[path[:d]]["n_leaves"] += out[path]["n_children"] == 0
            out[path[:d]]["saved_tokens"] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    return out.values()


def trie(spark, rows, band=None):
    turns, conv = pt.numbered_turns(table(spark, rows)), F.col("conv_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return pt.prefix_trie(*pt.rebuilt_turns(turns, conv - conv % 5, taken, most=8), band=band)


def compare(df, want):
    def key(row):
        return [(row[c] is not None, row[c] or 0) for c in sorted(row)]

    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("band", "pieces"), [(None, 64), (1, 3), (4, 2)])
def test_equals_brute_force(spark, monkeypatch, band, pieces):
    monkeypatch.setattr(pt, "_BANDS_IN_A_ROW", pieces)
    monkeypatch.setattr(pt, "_PIECE", 3)
    draw = random.Random(4)
    rows = []
    for conv in draw.sample(range(90), 70):
        length = draw.choice([0, 1, 3, 9, 12, 25])
        rows += [(conv, t, draw.choice("ua"), draw.choice(["hi", "yes ü", ""])) for t in range(length)]
    # Many copies of one conversation, with tails of their own.
    for conv in range(100, 140):
        rows += [(conv, t, "u", "same") for t in range(10)] + [(conv, 10, "a", str(conv % 3))]
    draw.shuffle(rows)
    compare(trie(spark, rows, band), brute_force(rows))


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "nobody"), (5, None, None, None), (5, 0, "u", "x"), (5, 0, "a", "x"), (5, 0, "u", "x"),
        (6, 3, "ab", "c"), (7, 3, "a", "bc"), (0, 1, "u", "w " * 30_000), (1, 1, "u", "w " * 30_000), (99, 2, "", ""),
    ]
    compare(trie(spark, rows), brute_force(rows))
    assert trie(spark, []).collect() == [] and trie(spark, rows[:1]).collect() == []


def test_one_conversation_over_many_ranges(spark):
    rows = [(3, t, "u", f"{t % 7}") for t in range(3_000)] + [(4, 0, "u", "0")]
    turns = pt.numbered_turns(table(spark, rows).repartition(6))
    got = sorted((r.conv_id, r.pos) for r in turns.collect())
    assert got == [(3, k + 1) for k in range(3_000)] + [(4, 1)]
