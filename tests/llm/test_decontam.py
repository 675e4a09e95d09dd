import random

import pytest
from llm_rows import docs

from corpusloom.llm import decontam
from corpusloom.llm.decontam import folded, leaks, myers, pieces, without_leaks


def distance(pattern, text):
    """Brute force: least edits of the pattern to any part of the text, and its first end."""
    row = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (pattern[i - 1] != text[j - 1])))
        row = new
    return min(row), row.index(min(row))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_myers_equals_the_table():
    rng = random.Random(5)
    for _ in range(400):
        pattern = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randrange(120)))
        assert myers(pattern, text) == distance(pattern, text)
    assert myers("", "abc") == (0, 0)


def test_pieces_cover_the_item():
    for length in range(1, 60):
        item = "".join(chr(97 + k % 26) for k in range(length))
        for edits in range(0, length):
            parts = pieces(item, edits)
            assert len(parts) == edits + 1 and "".join(p for _, p in parts) == item
            assert all(item[o : o + len(p)] == p for o, p in parts)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choices("qxz", k=rng.randrange(2))
    return "".join(out)


@pytest.mark.parametrize("block", [4 << 20, 1])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    rng = random.Random(8)
    vocabulary = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    tests = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 25))) for _ in range(8)] + ["eta", "", " "]
    rows = []
    for k in range(60):
        item = tests[rng.randrange(8)]
        inner = edited(rng, item, rng.randrange(0, 2 + int(0.09 * len(item))))
        around = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(2)]
        rows.append((k, f"{around[0]}\n\n {inner.upper()}\t{around[1]}" if k % 4 else around[0]))
    got = leaks(docs(spark, rows), items(spark, list(enumerate(tests))))
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in got.collect()}
    want = {}
    for k, text in rows:
        for n, item in enumerate(tests):
            item = folded(item)
            if item:
                best = distance(item, folded(text))[0]
                if best <= int(decontam.EDIT_RATE * len(item)):
                    want[k, n] = best
    assert {key: value[0] for key, value in got.items()} == want
    texts = dict(rows)
    for (k, n), (edits, start, end) in got.items():
        assert distance(folded(tests[n]), folded(texts[k][start:end]))[0] == edits
    kept = {r.doc_id for r in without_leaks(docs(spark, rows), items(spark, list(enumerate(tests)))).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in want}


def test_edge_rows(spark):
    tests = [(1, "one short test item here"), (2, None), (3, "  "), (None, "another test item with words"), (1, "one short test item here")]
    rows = [(1, None), (2, ""), (3, " "), (4, "x ONE short\n test   item here y"), (4, "x ONE short\n test   item here y"),
            (None, "another test item with words"), (6, "y " * 100_000 + "one short test item here")]
    df = docs(spark, rows).withColumnRenamed("source", "start").withColumnRenamed("lang", "item_id")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in leaks(df, items(spark, tests)).collect())))
    assert got == sorted(map(str, [(4, 1, 0, 2, 29)] * 4 + [(None, None, 0, 0, 28)] + [(6, 1, 0, 200_000, 200_024)] * 2))
    kept = without_leaks(df, items(spark, tests))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert leaks(docs(spark, []), items(spark, tests)).collect() == []
    assert leaks(df, items(spark, [])).collect() == []
    assert without_leaks(df, items(spark, [])).count() == len(rows)
