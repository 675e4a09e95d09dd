from collections import Counter, defaultdict

import pytest
from llm_rows import docs
from pyspark.sql import functions as F

from corpusloom.llm.mixing import capped_targets, mixed, ranked_weights, repeated, with_words
from corpusloom.llm.sharding import is_prime, placed, slot_table


def water(sources, cap):
    """Brute force: raise the level by halving until the shares add up."""
    total = sum(s for s, _ in sources)
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(cap * s, level * w) for s, w in sources) < total:
            low = level
        else:
            high = level
    return [min(cap * s, low * w) for s, w in sources]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 2, 3, 400], [5], [0, 7, 1], [1, 1, 1, 1, 900, 30]])
def test_water_filling(spark, sizes):
    sources = [(s, (5, 2, 1)[k % 3]) for k, s in enumerate(sizes)]
    df = spark.createDataFrame([(k, *s) for k, s in enumerate(sources)], "source int, source_size long, weight int")
    got = [r.target for r in capped_targets(df, 3).orderBy("source").collect()]
    assert got == pytest.approx(water(sources, 3), rel=1e-6, abs=1e-6)
    assert sum(got) == pytest.approx(sum(sizes))


def test_weights_that_cannot_be_met(spark):
    df = spark.createDataFrame([(1, 10, 0), (2, 5, None), (3, 4, 2)], "source int, source_size long, weight int")
    assert [r.target for r in capped_targets(df, 3).orderBy("source").collect()] == [0, 0, 12]


def test_words(spark):
    texts = ["", None, " \n", "a", " a b\t", "a\x1cb c", "é  é\x0b", "w " * 50_000]
    df = with_words(docs(spark, list(enumerate(texts))))
    assert [r.size for r in df.orderBy("doc_id").collect()] == [0, 0, 0, 1, 2, 2, 2, 50_000]


def rows_of(spark):
    sizes = {"a": [5] * 40 + [300], "b": [7] * 200, "c": [1, 2, 0], None: [9] * 6, "d": [0]}
    rows = [(source, n) for source, lengths in sizes.items() for n in lengths]
    return docs(spark, [(k, "w " * n if n else None, "en", source) for k, (source, n) in enumerate(rows)])


def test_mix_meets_its_targets(spark):
    df = rows_of(spark)
    weights = ranked_weights(df, [5, 2, 1])
    assert {r.source: r.weight for r in weights.collect()} == {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    got = mixed(df, weights, 3, seed=1).collect()
    sums, targets, largest = Counter(), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sums[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(sums[s] - t) <= largest[s] / 2 + 1e-6 for s, t in targets.items())
    again = mixed(df.repartition(7), weights, 3, seed=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixed(df, weights, 3, seed=2).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))


def test_repeats_and_clashing_columns(spark):
    df = rows_of(spark)
    clashing = df.withColumn("size", F.lit("x")).withColumn("room", F.lit(1)).withColumn("slice", F.lit("s"))
    rows = mixed(clashing.withColumn("weight", F.lit(1)), ranked_weights(df, [5, 2, 1]), 3, seed=1)
    assert Counter(r.doc_id for r in repeated(rows).collect()) == Counter(
        {r.doc_id: r.copies for r in rows.collect() if r.copies}
    )
    assert {r.room for r in rows.collect()} == {1}


def test_empty_table_and_repeated_rows(spark):
    none = docs(spark, [])
    assert mixed(none, ranked_weights(none, [5])).collect() == []
    same = docs(spark, [(1, "a b", "en", "s")] * 4 + [(None, "c", "en", "s")])
    got = mixed(same, ranked_weights(same, [1]), 3).collect()
    assert sorted(r.taken for r in got) == [1, 2, 2, 2, 2]


# --- sharding ----------------------------------------------------------------------


def greedy(starts, steps, slots):
    """Brute force: whole preference lists, shards in turn."""
    wanted = [iter([(a + k * s) % slots for k in range(slots)]) for a, s in zip(starts, steps)]
    owner = {}
    while len(owner) < slots:
        for k, mine in enumerate(wanted):
            if len(owner) < slots:
                owner[next(x for x in mine if x not in owner)] = k
    return [owner[x] for x in range(slots)]


def test_table_follows_preferences():
    from corpusloom.llm.sharding import _drawn

    names = [f"s{k}" for k in range(7)]
    starts = [_drawn(n, "start", 101) for n in names]
    steps = [1 + _drawn(n, "step", 100) for n in names]
    assert slot_table(names, 101) == greedy(starts, steps, 101)


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    table = slot_table(names, 5003)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = slot_table(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved / 5003 < 0.15


@pytest.mark.parametrize(("names", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 1 << 21)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        slot_table(names, slots)


def test_placement(spark):
    names = [f"s{k}" for k in range(5)]
    df = docs(spark, [(k % 50, f"t{k}") for k in range(200)] + [(None, "x"), (None, "x"), (None, None)])
    df = df.withColumn("shard", F.lit("old"))
    got = placed(df, names, 101, F.col("doc_id"), F.col("text"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    table, rows = slot_table(names, 101), got.collect()
    assert len(rows) == 203 and all(names[table[r.slot]] == r.shard for r in rows)
    by_key = defaultdict(set)
    for r in rows:
        by_key[r.doc_id if r.doc_id is not None else r.text].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    assert placed(docs(spark, []), names, 101, F.col("doc_id")).collect() == []
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_primes():
    assert [n for n in range(30) if is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
