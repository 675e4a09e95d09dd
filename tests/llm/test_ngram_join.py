import random

import pytest
from llm_rows import docs, linked_components, shingle_set

from corpusloom.llm import ngram_join
from corpusloom.llm.graph import components
from corpusloom.llm.ngram_join import overlap, partner_sizes, similarity_classes


def expected(rows, width, percent):
    by_set = {}
    for doc_id, text in rows:
        found = frozenset(shingle_set(text, width))
        key = found or ("empty", doc_id)
        by_set[key] = min(doc_id, by_set.get(key, doc_id))
    sets = {i: s for s, i in by_set.items() if isinstance(s, frozenset)}
    roots = linked_components(sets, percent)
    out = []
    for doc_id, text in rows:
        found = frozenset(shingle_set(text, width))
        out.append((doc_id, len(found), roots[by_set[found]] if found else doc_id))
    return sorted(out)


def found(spark, rows, width, percent):
    got = similarity_classes(docs(spark, rows), width, percent).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def varied(seed, sizes, copies):
    """Families of texts with a few words changed, dropped or added."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text)) if text else 0
                text[at : at + rng.randrange(2)] = [f"w{rng.randrange(10**6)}"] * rng.randrange(2)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = varied(width, [1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 14, 18, 25, 60, 150], 9)
    rows += [(1000 + k, f"common line of text number {k % 3} with words in it") for k in range(30)]
    assert found(spark, rows, width, percent) == expected(rows, width, percent)


@pytest.mark.parametrize("most", [0, 40])
def test_any_boundary_gives_the_same(spark, monkeypatch, most):
    rows = varied(7, [5, 8, 9, 11, 13, 16], 6)
    monkeypatch.setattr(ngram_join._Join, "boundary", lambda self: most)
    percent = 85 if most < 40 else 92  # subsets of large sets stay few
    assert found(spark, rows, 4, percent) == expected(rows, 4, percent)


def test_many_hub_rounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_HUBS", 2)
    rows = varied(3, [40] * 4, 25)
    assert found(spark, rows, 4, 85) == expected(rows, 4, 85)


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (2, "ONE"), (7, "one two"), (7, "one two"), (8, "é É")]
    assert found(spark, rows, 4, 85) == [
        (2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7), (7, 1, 7), (8, 1, 8), (9, 1, 2)
    ]
    assert found(spark, [], 4, 85) == []
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (None, "x y z")]
    got = similarity_classes(docs(spark, rows), 4, 85).collect()
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "3", "None"]


def test_extra_columns_may_clash(spark):
    rows = docs(spark, [(1, "a b c d"), (2, "A b c d")])
    for name in ("digest", "bucket", "component_id", "n_shingles"):
        rows = rows.withColumn(name, rows.text)
    got = similarity_classes(rows, 4, 85)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.component_id for r in got.collect()} == {1}


def test_overlap_is_the_least_that_links():
    for percent in (60, 80, 85):
        for a in range(1, 40):
            for b in range(1, 40):
                o = overlap(a, b, percent)
                assert 100 * o >= percent * (a + b - o) and 100 * (o - 1) < percent * (a + b - o + 1)
                assert (b in partner_sizes(a, percent)) == (o <= min(a, b))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    sets = {x: {x} for p in pairs for x in p}
    root = {x: x for x in sets}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_equal_sets_are_written_once(spark, monkeypatch, kind):
    written, write = {}, ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: written.setdefault(name, write(df, name)))
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[:-1] + [f"last{k}"]) for k in range(3)]
    rows = [(i, texts[i % 3]) for i in range(60)] + [(None, texts[0]), (61, "")]
    table = docs(spark, rows).selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    got = similarity_classes(table, 4, 85).collect()
    assert len(got) == len(rows)
    assert {str(r.component_id) for r in got if r.n_shingles} == {"0"}
    carried = written["sets"].where("items IS NOT NULL").collect()
    ids = str if kind == "string" else int
    least = {min(ids(i) for i, text in rows if text == t and i is not None) for t in texts}
    assert {r.doc_id for r in carried} == least and len(carried) == 3
    assert len({r.node for r in carried}) == 3


def test_pairs_move_only_the_sets_they_name(spark, monkeypatch):
    asked, write = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (asked.append(name), write(df, name))[1])
    rows = varied(3, [25, 60], 9)
    assert found(spark, rows, 4, 85) == expected(rows, 4, 85)
    assert asked.count("pair-ends") == asked.count("pairs") > 0
