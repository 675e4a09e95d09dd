"""The registered queries of this folder and the pipeline, on the given small tables."""

from collections import Counter

import pytest
from check_oracles import difference, duck
from llm_rows import docs, linked_components, shingle_set

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import decontam, queries, toxicity
from corpusloom.llm.sharding import slot_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, name):
    df, rel = queries.registered()[name](spark, SF), duck(SF).sql(queries.oracles()[name])
    assert difference(df.collect(), df.columns, rel.fetchall(), rel.columns) is None


def test_entry_registers_all():
    assert set(queries.registered()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.registered()} == {f"op{k}" for k in range(1, 14)}


def test_join_equals_brute_force(spark, rows):
    sets = {r.doc_id: shingle_set(r.text, 4) for r in rows}
    roots = linked_components(sets, 85)
    got = queries.registered()["op10_ngram_join"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), roots[i]) for i in sets)


def test_leaks_contain_all_exact_passages(spark, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    exact = {(r.doc_id, i.item_id) for r in rows for i in items if decontam.folded(i.text) in decontam.folded(r.text)}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.registered()["op3_decontamination"](spark, SF).collect()}
    assert exact == {k for k, e in got.items() if e == 0} and exact


def test_tool_calls_have_every_state(spark):
    got = queries.registered()["op8_tool_calls"](spark, SF).collect()
    assert {"answered", "unanswered"} <= {r.status for r in got} and {True, False} <= {r.valid for r in got}


def test_languages_held_out(spark, rows):
    lang = {r.doc_id: r.lang for r in rows}
    got = [r for r in queries.registered()["op6_language_id"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.95


def test_pipeline_equals_brute_force(spark, rows):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    chain = toxicity.train(frame, queries.toxicity_labels(spark, SF), queries.CATEGORIES)
    flagged = toxicity.scored(frame, chain, queries.CATEGORIES).where("toxic").collect()
    left = {r.doc_id: r for r in rows if r.doc_id not in {f.doc_id for f in flagged}}
    roots = linked_components({i: shingle_set(r.text, 5) for i, r in left.items()}, 80)
    left = {i: r for i, r in left.items() if roots[i] == i}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaky = {r.doc_id for r in decontam.leaks(docs(spark, [(i, r.text) for i, r in left.items()]), items).collect()}
    left = {i: r for i, r in left.items() if i not in leaky}
    # The mix takes each document up to three times, and comes near every target.
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(left) and max(times.values()) <= 3
    size = {i: len(shingle_set(r.text, 1)) and len(r.text.split()) for i, r in left.items()}
    total, most = sum(size.values()), max(size.values())
    assert abs(sum(size[i] * n for i, n in times.items()) - total) <= 21 * most / 2
    table = slot_table(queries.SHARDS, queries.SLOTS)
    assert all(r.text == left[r.doc_id].text and queries.SHARDS[table[r.slot]] == r.shard for r in got)


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_similar_rows_go_one_by_one(spark, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", most)
    one, other, third = ("alpha beta gamma delta epsilon zeta eta theta", "a b c d e f g h i j k", "r s t u v w x y z")
    table = [(-5, third), (1, one), (2, one), (2, other), (3, other), (None, one), (None, third), (4, ""), (4, ""), (None, None), (7, one), (7, one), (-5, third)]
    frame = docs(spark, table)
    kept = corpus_pipeline.keep_one_of_similar(spark, frame, SF)
    want = [(-5, third), (1, one), (2, other), (4, ""), (4, ""), (None, None)]
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_similar_rows_with_names_for_ids(spark):
    table = [("b", "alpha beta gamma delta epsilon zeta"), ("a", "alpha beta gamma delta epsilon zeta"), ("c", "one two three four five six")]
    frame = spark.createDataFrame(table, "doc_id string, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, frame, SF).collect()) == ["a", "c"]


def test_stages_survive_odd_tables(spark):
    odd = [(1, None), (2, ""), (3, " "), (None, "x y z"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "w " * 50_000)]
    for table in ([], odd):
        frame = docs(spark, table)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert name == "sharding" or out.columns == frame.columns
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert kept <= set(table) and (name == "mixing" or len(kept) == len(set(table)))
