"""Toxicity chain and language codes: held-out accuracy, odd rows, unit checks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs
from pyspark.sql import functions as F

from corpusloom.llm import language_id, toxicity
from corpusloom.llm.language_id import codewords, has_letter, shares

BAD = ["vileword", "nastyword", "uglyword"]


def labelled(seed, n):
    """Texts with two categories: shouting texts, and texts with bad words."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        rude, loud = rng.random() < 0.2, rng.random() < 0.3
        if rude:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        if loud:
            text = [w if rng.random() < 0.5 else "!!!loud!!!" for w in text]
        rows.append((seed * 100_000 + k, " ".join(text)))
        labels.append((seed * 100_000 + k, int(loud), int(rude) if k % 9 else None))
    return rows, labels


@pytest.fixture(scope="module")
def chain(spark):
    rows, labels = labelled(1, 900)
    table = spark.createDataFrame(labels, "doc_id long, loud int, rude int")
    return toxicity.train(docs(spark, rows), table, ["loud", "rude"])


def test_chain_on_held_out_rows(spark, chain):
    rows, labels = labelled(2, 400)
    got = {r.doc_id: r for r in toxicity.scored(docs(spark, rows), chain, ["loud", "rude"]).collect()}
    assert np.mean([got[i].loud == bool(loud) for i, loud, _ in labels]) > 0.98
    assert np.mean([got[i].rude == bool(rude) for i, _, rude in labels if rude is not None]) > 0.98
    kept = {r.doc_id for r in toxicity.without(docs(spark, rows), chain, 1).collect()}
    assert kept == {i for i, r in got.items() if not r.rude}


def test_later_models_read_earlier_probabilities(chain):
    assert len(chain[0].weights) == len(chain[0].chosen)
    assert len(chain[1].weights) == len(chain[1].chosen) + 1


def test_earlier_probabilities_are_out_of_fold():
    rng = np.random.default_rng(0)
    n = 300
    # Every row has a feature of its own and noise labels: only rows seen can be known.
    row = np.concatenate([np.arange(n), np.repeat(np.arange(n), 4)]).astype(np.int32)
    feature = np.concatenate([np.arange(n) // 3, rng.integers(500, 560, 4 * n)]).astype(np.int32)
    first = rng.integers(0, 2, n).astype(float)
    rows = toxicity._Rows(row, feature, np.ones(len(row), np.float32), n)
    models = toxicity.fit_chain(rows, [first, first], rng.integers(0, 5, n))
    # Fed with in-sample probabilities, the second model would lean on them alone.
    assert abs(models[1].weights[-1]) < 1.5


def test_odd_rows(spark, chain):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "vileword"), (4, "vileword"), (None, "word1 word2"), (5, "word1 " * 200_000)]
    df = docs(spark, rows).withColumn("p_rude", F.lit("x")).withColumn("features", F.lit("x"))
    got = toxicity.scored(df, chain, ["loud", "rude"]).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "4", "5", "None"]
    assert not any(r.loud or r.rude for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.scored(docs(spark, []), chain, ["loud", "rude"]).collect() == []
    kept = toxicity.without(df, chain, 1)
    assert kept.columns == df.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, loud int, rude int")
    none = toxicity.train(docs(spark, [(1, "a")]), labels, ["loud", "rude"])
    assert none == []
    row = toxicity.scored(docs(spark, [(1, "a")]), none, ["loud", "rude"]).first()
    assert (row.p_rude, row.rude) == (None, False)
    assert toxicity.without(docs(spark, [(1, "a")]), none, 1).count() == 1
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (1, 0, None)], "doc_id long, loud int, rude int")
    one = toxicity.train(docs(spark, [(1, "a b")]), labels, ["loud", "rude"])
    assert not toxicity.scored(docs(spark, [(1, "a b")]), one, ["loud", "rude"]).first().rude


def test_slices_of_long_columns_agree(monkeypatch):
    texts = pa.array(["a b c a", None, "d e", "", "f " * 50, "g"])
    whole = [(r + low, f) for low, r, f, _ in toxicity.features(texts)]
    monkeypatch.setattr(toxicity, "_SLICE", 4)
    parts = [(r + low, f) for low, r, f, _ in toxicity.features(texts)]
    assert len(parts) > 3

    def pairs(found):
        return sorted((int(a), int(b)) for r, f in found for a, b in zip(r, f))

    assert pairs(whole) == pairs(parts)


# --- languages ---------------------------------------------------------------------

SOUNDS = {"aa": "ba ku mo ri ta".split(), "bb": "schl ung keit ver".split(), "cc": "ción que ñe lle".split(), "dd": "eau oux çé".split(),
          "ee": "ый ов ка ть".split(), "ff": "wa shi tsu ga".split(), "gg": "zz qx vv".split()}


def spoken(seed, n, names):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        name = names[k % len(names)]
        text = " ".join("".join(rng.choices(SOUNDS[name], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40)))
        rows.append((seed * 10_000 + k, text.capitalize() + ".", name))
    return rows


@pytest.mark.parametrize("names", [["aa"], ["aa", "bb"], ["aa", "bb", "cc", "dd"], list(SOUNDS)])
def test_languages_on_held_out_rows(spark, names):
    codes = language_id.train(docs(spark, spoken(1, 60 * len(names), names)), F.lit(True))
    rows = spoken(2, 40 * len(names), names)
    got = {r.doc_id: r for r in language_id.identified(docs(spark, rows), codes).collect()}
    assert np.mean([got[i].lang_pred == name for i, _, name in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.ambiguous for r in got.values()]) < 0.1


def test_only_what_may_be_learned(spark):
    rows = spoken(3, 80, ["aa", "bb"]) + [(90_000 + k, "zz qx", "gg") for k in range(9)]
    codes = language_id.train(docs(spark, rows + [(1, "x", None), (2, None, "hh"), (3, "12", "ii")]), F.col("doc_id") < 90_000)
    assert codes.languages == ("aa", "bb")
    assert language_id.train(docs(spark, []), F.lit(True)) is None


def test_odd_texts(spark):
    codes = language_id.train(docs(spark, spoken(1, 100, ["aa", "bb"])), F.lit(True))
    rows = [(1, None), (2, ""), (3, "12 – !"), (4, "中"), (None, "bakumo"), (5, "baku " * 100_000), (5, "ungkeit")]
    df = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("cells", F.lit("x"))
    got = language_id.identified(df, codes).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    assert all(r.lang_pred != "und" for r in got if r.doc_id not in (1, 2, 3)) and len(got) == len(rows)
    assert language_id.identified(docs(spark, []), codes).collect() == []
    nothing = language_id.identified(docs(spark, [(1, "abc")]), None).first()
    assert (nothing.lang_pred, nothing.score, nothing.ambiguous) == ("und", 0.0, True)


def test_mixed_texts_are_ambiguous(spark):
    names = ["aa", "bb", "cc", "dd"]
    codes = language_id.train(docs(spark, spoken(1, 400, names)), F.lit(True))
    x = shares(pa.array([r[1] for r in spoken(5, 80, names)]))
    close = codes.decoded((x[0::4] + x[1::4]) / 2)[2]
    assert close.mean() > codes.decoded(x)[2].mean()


def test_codewords_are_apart():
    for n in range(2, 12):
        code = codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)
        assert (np.abs(code.sum(0)) < n).all()


def test_shares_do_not_depend_on_neighbours_or_steps(monkeypatch):
    texts = pa.array(["ab cd", None, "xyz " * 30, "", "é", "ab cd"])
    whole = shares(texts)
    assert (whole[0] == whole[5]).all() and whole[1].sum() == whole[3].sum() == 0
    monkeypatch.setattr(language_id, "_SLICE", 7)
    assert np.abs(shares(texts) - whole).max() < 1e-6


def test_letters():
    texts = ["12", "é", "", None, "a", "中", "–—!", "1x", "٣"]
    assert has_letter(pa.array(texts)).tolist() == [any(c.isalpha() for c in t or "") for t in texts]
