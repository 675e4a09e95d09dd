"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier on byte n-grams predicts each bit.
A text gets the language whose codeword costs least: losses of the bits' margins, each
weighted by how reliable its classifier was on rows it had not seen. A close second, or
more wrong bits than the code can correct, marks the answer ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.words import flat

# Labelled rows that a fit uses at most, spread evenly over the languages.
MAX_ROWS = 4_000
UNKNOWN = "und"
_BITS = 11
# All ways to part the languages in two are used up to this many languages.
_EXHAUSTIVE = 5
_STEPS, _PENALTY = 80, 1e-3
# A second language this close in probability makes an answer ambiguous.
_CLOSE = 0.2
# Text bytes and texts counted at once: bounds the memory of one step.
_SLICE, _ROWS = 1 << 20, 512

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
# Letters in lower case, bytes of longer characters as they are, all else a blank.
_FOLD = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language, as far apart as found."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= _EXHAUSTIVE:
        cuts = [c for c in itertools.product((1, -1), repeat=languages - 1) if -1 in c]
        return np.array([[1] * len(cuts), *zip(*cuts, strict=True)], dtype=float)
    width = math.ceil(10 * math.log2(languages))
    best, far = None, -1
    random = np.random.default_rng(languages)
    for _ in range(200):
        code = np.where(random.random((languages, width)) < 0.5, -1.0, 1.0)
        apart = (code @ code.T - width * np.eye(languages) * 2).max()
        distance = (width - apart) / 2
        mixed = (np.abs(code.sum(0)) < languages).all()
        if mixed and distance > far:
            best, far = code, distance
    return best


def _slices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = flat(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + _SLICE, side="right")) - 1
        high = min(max(high, low + 1), low + _ROWS, rows)
        yield data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def shares(column) -> np.ndarray:
    """Per text, the square roots of the shares of its hashed byte pairs and triples."""
    out = []
    for data, offsets in _slices(column):
        rows, width = len(offsets) - 1, 1 << _BITS
        counts = np.zeros(rows * width, dtype=np.int64)
        # Long texts are counted in steps; a step looks two bytes back.
        for at in range(0, len(data), _SLICE):
            begin = max(0, at - 2)
            counts += _counted(data[begin : at + _SLICE], begin, at, offsets, rows)
        counts = counts.reshape(rows, width).astype(np.float32)
        out.append(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))
    return np.concatenate(out) if out else np.zeros((0, 1 << _BITS), np.float32)


def _counted(data: np.ndarray, begin: int, at: int, offsets: np.ndarray, rows: int) -> np.ndarray:
    byte = _FOLD[data]
    starts = offsets[:-1]
    row = np.repeat(np.arange(rows), np.diff(np.clip(offsets, begin, begin + len(data))))
    place = np.arange(begin, begin + len(data)) - starts[row]
    cells = np.zeros(rows << _BITS, dtype=np.int64)
    for n, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(byte) < n:
            continue
        gram = np.zeros(len(byte) - n + 1, dtype=np.uint32)
        letters = np.zeros(len(gram), dtype=bool)
        for k in range(n):
            part = byte[k : k + len(gram)]
            gram = gram * np.uint32(257) + part
            letters |= part != 32
        # A gram belongs to the step and the text that hold its last byte.
        last = np.arange(n - 1, len(byte))
        good = letters & (place[last] >= n - 1) & (last + begin >= at)
        hashed = (gram * np.uint32(factor)) >> np.uint32(32 - _BITS)
        cell = (row[last[good]] << _BITS) + hashed[good]
        cells += np.bincount(cell, minlength=rows << _BITS)
    return cells


def has_letter(column) -> np.ndarray:
    """Whether each text holds any letter of any script."""
    found = [np.zeros(0, dtype=bool)]
    for data, offsets in _slices(column):
        seen = np.concatenate(([0], np.cumsum(_IS_LETTER[data], dtype=np.int32)))[offsets]
        out = np.diff(seen) > 0
        for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
            text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
            out[row] = any(c.isalpha() for c in text)
        found.append(out)
    return np.concatenate(found)


@dataclass(frozen=True)
class Codes:
    """Languages, their codewords, the bits' classifiers and how far each is trusted."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability and whether it is ambiguous, per row."""
        margins = x @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        chance = np.exp(-(losses - losses.min(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        best = losses.argmin(1)
        top = np.sort(chance, axis=1)
        second = top[:, -2] if chance.shape[1] > 1 else np.zeros(len(x))
        wrong = (np.sign(margins) != self.code[best]).sum(1)
        return best, chance[np.arange(len(x)), best], (top[:, -1] - second < _CLOSE) | (wrong > self._corrects())

    def _corrects(self) -> int:
        if len(self.code) < 2:
            return self.code.shape[1]
        apart = (self.code.shape[1] - self.code @ self.code.T) / 2
        return int(apart[~np.eye(len(apart), dtype=bool)].min() - 1) // 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Penalised logistic regression of every bit at once, by accelerated descent."""
    centre = x.mean(0)
    z = x - centre
    rate = 4 / max(float((z**2).sum(1).mean()), 1e-6)
    w = v = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    b = np.zeros(y.shape[1], dtype=np.float32)
    for step in range(_STEPS):
        ahead = w + (step / (step + 3)) * (w - v)
        slope = -y / (1 + np.exp(np.clip(y * (z @ ahead + b), -30, 30)))
        v, w = w, ahead - rate * (z.T @ slope / len(x) + _PENALTY / rate * ahead)
        b = b - slope.mean(0)
    return w, b - centre @ w


def fit_codes(x: np.ndarray, labels: list[str]) -> Codes:
    """Learn the classifiers of all bits; every fifth row tells how far to trust each."""
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    index = {name: k for k, name in enumerate(languages)}
    y = code[[index[name] for name in labels]].astype(np.float32)
    tested = np.arange(len(x)) % 5 == 4
    trust = np.full(code.shape[1], 1.0)
    if tested.any():
        w, b = _logistic(x[~tested], y[~tested])
        wrong = np.logaddexp(0, -(x[tested] @ w + b) * y[tested]).mean(0)
        trust = 1 / (0.05 + wrong)
    w, b = _logistic(x, y)
    return Codes(languages, code, w, b, trust / trust.mean())


def train(docs: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> Codes | None:
    """Fit on at most `max_rows` rows of `docs` (doc_id, text, lang) where `learn` holds.

    Each language gives up to an equal part, by the hash of the id. Texts without a
    letter and rows without a language teach nothing. None if no row is left.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    quota = max(1, max_rows // len(counts))
    wanted = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * quota / n))])
    place = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.where(F.pmod(place, F.lit(1 << 30)) / (1 << 30) <= F.element_at(wanted, F.col("lang")))
    # What is left is about max_rows rows, so the exact bound costs little.
    ranked = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id")))
    rows = ranked.where(F.col("nth") <= quota).select("text", "lang")
    found = rows.mapInArrow(_training_rows, "lang string, cells binary, vals binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["cells", "vals"], kind="stable").reset_index(drop=True)
    x = np.zeros((len(found), 1 << _BITS), dtype=np.float32)
    for k, (cells, values) in enumerate(zip(found["cells"], found["vals"], strict=True)):
        x[k, np.frombuffer(cells, np.uint16)] = np.frombuffer(values, np.float32)
    return fit_codes(x, found["lang"].tolist())


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, good = shares(batch["text"]), has_letter(batch["text"])
        cells = [np.flatnonzero(row).astype(np.uint16) for row in x]
        rows = [(c.tobytes(), row[c].tobytes()) for c, row in zip(cells, x, strict=True)]
        out = pa.RecordBatch.from_arrays(
            [batch["lang"], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            names=["lang", "cells", "vals"],
        )
        yield out.filter(pa.array(good))


def identified(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang_pred, score (0 to 1), ambiguous.

    A null text, or one without a letter of any script, is `und` with score 0, and so
    is every text if nothing was learned. Repeated rows each get a row; other columns
    are not looked at; no rows give no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(astuple(codes) if codes else None)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Codes(*shared.value) if shared.value else None
        for batch in batches:
            text, n = batch["text"], batch.num_rows
            known = has_letter(text) if model else np.zeros(n, dtype=bool)
            names, score, close = np.full(n, UNKNOWN, dtype=object), np.zeros(n), ~known
            if known.any():
                for at in np.array_split(np.flatnonzero(known), -(-int(known.sum()) // _ROWS)):
                    best, score[at], close[at] = model.decoded(shares(text.take(pa.array(at))))
                    names[at] = [model.languages[k] for k in best]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(score), pa.array(close)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        identify, f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean"
    )
