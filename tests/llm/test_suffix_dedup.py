"""Repeated passages against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import docs

from corpusloom.llm import suffix_dedup as sd


def brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone, upto = bytearray(len(r)), 0
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[max(i, upto) : i + length] = b"\1" * (i + length - max(i, upto))
                upto = i + length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    """Texts made of cut passages, repeated signs, periods and words of their own."""
    draw = random.Random(seed)

    def prose(n):
        return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(n))

    pool = [prose(draw.randint(30, 200)) for _ in range(6)]

    def part():
        kind = draw.random()
        if kind < 0.5:
            text = draw.choice(pool)
            begin = draw.randint(0, len(text))
            return text[begin : begin + draw.randint(0, 500)]
        if kind < 0.7:
            return draw.choice("ab ") * draw.randint(1, 600)
        if kind < 0.8:
            return ("xyz" * 300)[: draw.randint(1, 900)]
        return prose(draw.randint(1, 80))

    texts = ["".join(part() for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 20))]
    return [*texts, None, "", texts[0], "short " * 10, "short " * 10]


@pytest.mark.parametrize(("seed", "length", "step"), [(1, 200, 300), (2, 200, 1 << 19), (3, 64, 1000), (4, 100, 700)])
def test_equals_brute_force(spark, monkeypatch, seed, length, step):
    monkeypatch.setattr(sd, "_STEP", step)
    monkeypatch.setattr(sd, "_BLOCK", 4000)
    monkeypatch.setattr(sd, "_OWNER", 3000)
    texts = [t for k in range(3) for t in passages(10 * seed + k)]
    rows = sd.repeated_spans(docs(spark, list(enumerate(texts))).repartition(3), length).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[k] for k in range(len(texts))] == brute_force(texts, length)


def test_odd_rows(spark):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300_000))
    table = [(1, None), (2, ""), (None, "x" * 500), (3, "a b"), (3, "a b"), (4, long), (4, long), (5, "q" + long[:199])]
    rows = sd.repeated_spans(docs(spark, table)).collect()
    want = [(i, *b) for (i, _), b in zip(table[:3], brute_force([t for _, t in table[:3]], 200), strict=True)]
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert all(found[w] for w in want) and len(rows) == len(table)
    assert sorted((r.n_removed, r.n_spans) for r in rows if r.doc_id == 4) == [(len(long), 1)] * 2
    assert [r.n_removed for r in rows if r.doc_id in (3, 5)] == [0] * 3
    assert sd.repeated_spans(docs(spark, [])).collect() == []
    named = docs(spark, table[:4]).selectExpr("cast(doc_id AS decimal(5,0)) AS doc_id", "text", "1 AS block", "2 AS owner")
    assert sd.repeated_spans(named).count() == 4
    with pytest.raises(ValueError):
        sd.repeated_spans(named, 63)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=9))
def test_family_marks_what_occurs_again(batches):
    family = sd.Family()
    for batch in batches:
        values, copies = np.unique(np.array(batch, dtype=np.uint64), return_counts=True)
        family.add(sd.Level.of([values], [copies > 1], [values % 3 == 0]))
        sizes = [level.batches for level in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    whole, seen = family.whole(), Counter(v for b in batches for v in b)
    assert dict(zip(whole.values.tolist(), whole.again.tolist(), strict=True)) == {v: n > 1 for v, n in seen.items()}
    assert whole.alone.tolist() == [v % 3 == 0 for v in sorted(seen)]
