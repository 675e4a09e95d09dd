"""Golomb codes and word hashes, without Spark."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import shingle_set

from corpusloom.llm import golomb
from corpusloom.llm.words import shingle_sets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, dtype=np.uint64))
    assert (golomb.decode(golomb.encode(values)) == values).all()


def test_golomb_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 44, 50_000, dtype=np.uint64))
    assert len(golomb.encode(values)) < 50_000 * (44 - 15.6 + 2) / 8
    assert (golomb.decode(golomb.encode(values)) == values).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbB \t\n\x0b\x1cé", max_size=40)), max_size=8))
def test_shingles_equal_words(texts):
    found = [set(s.tolist()) for s in shingle_sets(pa.array(texts, pa.string()), 3)]
    known = [shingle_set(t, 3) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in known]
    for a, x in zip(found, known):
        for b, y in zip(found, known):
            assert len(a & b) == len(x & y)


def test_very_long_words_and_texts():
    word = "x" * 200_000
    a, b, c = shingle_sets(pa.array([f"{word} a b", f" {word}\ta B ", f"{word}y a b"]), 4)
    assert set(a) == set(b) != set(c)
    many = " ".join(str(k) for k in range(400_000))
    assert len(shingle_sets(pa.array([many]), 4)[0]) == 399_997
