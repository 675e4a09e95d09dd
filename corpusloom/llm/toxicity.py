"""Toxicity by a classifier chain over label categories.

Categories are predicted one after the other by linear models on word features; each
model also sees the probabilities of the categories before it. In training those
probabilities come from models that did not see the row (out-of-fold), so later models
learn from inputs as uncertain as those they meet in use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import Words, distinct, flat
from corpusloom.sources.scratch import stored

# Labelled rows that a fit uses at most: those with the least hashes of their ids.
MAX_ROWS = 4_000
# Whole words, and word beginnings of so many bytes, are features of their own.
_HEADS = (None, 4, 6, 8)
_BITS = 22
# Features a model may use besides earlier probabilities, and the share of the rows
# that one must occur in (three rows at least).
_FEATURES, _LEAST_SHARE = 128, 0.003
_FOLDS, _PENALTY = 5, 3.0
# Text bytes scored at once.
_SLICE = 1 << 20


def features(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each feature, feature, words per row) of slices of a column."""
    data, offsets = flat(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _SLICE, side="right")) - 1)
        high = min(high, len(offsets) - 1)
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        counts = np.diff(words.first)
        rows = np.repeat(np.arange(high - low), counts)
        made = []
        for kind, head in enumerate(_HEADS):
            hashed = words.hashes(head) * np.uint64(2 * kind + 1)
            made.append((hashed >> np.uint64(64 - _BITS)).astype(np.int32))
        yield low, np.tile(rows, len(_HEADS)), np.concatenate(made), counts
        low = high


def _values(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Feature values: square roots of shares, so that long texts weigh no more."""
    return np.sqrt(counts / np.maximum(words, 1))


@dataclass(frozen=True)
class Model:
    """One category: its features, their centres and scales, weights, bias, threshold."""

    chosen: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def probability(self, values: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        """`values`: a column per chosen feature; `earlier`: probabilities so far."""
        x = np.column_stack([values, *[_logit(p) for p in earlier]])
        return _sigmoid((x - self.centre) / self.scale @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _least_rows(size: int) -> int:
    return max(3, math.ceil(_LEAST_SHARE * size))


class _Rows:
    """Sparse training rows: (row, feature, value), sorted by feature, without rare features."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, size: int):
        self.least = _least_rows(size)
        often = np.flatnonzero((np.bincount(feature, minlength=1) >= self.least)[feature])
        order = often[np.argsort(feature[often], kind="stable")]
        self.row, self.feature, self.value, self.size = row[order], feature[order], value[order], size
        self.names, self.first = np.unique(self.feature, return_index=True)
        self.at = np.repeat(np.arange(len(self.names)), np.diff(np.append(self.first, len(self.feature))))

    def best(self, use: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Features of the rows `use` that correlate most with the label."""
        inside = use[self.row]
        at, value, y = self.at[inside], self.value[inside].astype(float), label[self.row[inside]]
        n, k = use.sum(), len(self.names)
        total = np.bincount(at, value, k)
        square = np.bincount(at, value * value, k)
        joint = np.bincount(at, value * y, k)
        rows = np.bincount(at, minlength=k)
        mean = label[use].mean()
        spread = np.sqrt(np.maximum(square / n - (total / n) ** 2, 1e-12))
        score = np.where(rows >= self.least, np.abs(joint / n - total / n * mean) / spread, 0)
        order = np.argsort(-score, kind="stable")[:_FEATURES]
        return np.sort(self.names[order[score[order] > 0]])

    def columns(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, len(chosen)))
        at = np.searchsorted(chosen, self.feature)
        hit = chosen[np.minimum(at, len(chosen) - 1)] == self.feature if len(chosen) else np.zeros(len(at), bool)
        out[self.row[hit], at[hit]] = self.value[hit]
        return out


def _fit(x: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> Model:
    """Penalised logistic regression by Newton steps."""
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(z.shape[1]), float(np.log(mean / (1 - mean)))
    design = np.column_stack([z, np.ones(len(z))])
    penalty = np.append(np.full(z.shape[1], _PENALTY), 1e-6)
    for _ in range(25):
        beta = np.append(w, bias)
        p = _sigmoid(design @ beta)
        slope = design.T @ (p - y) + penalty * beta
        bend = (design.T * np.maximum(p * (1 - p), 1e-6)) @ design + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w, bias = w - step[:-1], bias - float(step[-1])
        if np.abs(step).max() < 1e-4:
            break
    return Model(chosen, centre, scale, w, bias)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the two probabilities where rejecting from there up has the best F1."""
    order = np.argsort(-p, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    cut = int(np.argmax(f1))
    below = p[order[cut + 1]] if cut + 1 < len(y) else 0.0
    return float((p[order[cut]] + below) / 2)


def fit_chain(rows: _Rows, labels: list[np.ndarray], folds: np.ndarray) -> list[Model]:
    """A model per category, in order; null labels (nan) leave a row out of that category."""
    chain: list[Model] = []
    if not rows.size:
        return chain
    earlier: list[np.ndarray] = []
    for label in labels:
        known = ~np.isnan(label)
        y = np.where(known, label, 0.0)

        def fit(use: np.ndarray, y=y) -> Model:
            chosen = rows.best(use, y)
            x = np.column_stack([rows.columns(chosen), *[_logit(p) for p in earlier]])
            return _fit(x[use], y[use], chosen)

        if not known.any():
            known = np.ones(rows.size, dtype=bool)
        model = fit(known)
        held_out = model.probability(rows.columns(model.chosen), earlier)
        for fold in range(_FOLDS):
            use = known & (folds != fold)
            if use.any():
                part = fit(use)
                out = folds == fold
                held_out[out] = part.probability(rows.columns(part.chosen), earlier)[out]
        threshold = _threshold(held_out[known], y[known]) if y[known].any() else 1.0
        chain.append(Model(*astuple(model)[:-1], threshold))
        earlier.append(held_out)
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> list[Model]:
    """Fit a chain on at most `max_rows` labelled rows of `docs` (doc_id, text).

    `labels` has doc_id and a 0/1/null column per category; rows are taken by the hash
    of their id, so the sample is spread over all. A few million numbers come to the
    driver, row by row. Without labelled rows the chain is empty.
    """
    labels = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids: a proven size.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(_FOLDS)).cast("int").alias("fold")
    marks = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(categories)]
    kind = ", ".join(["features binary", "vals binary", "fold int", *[f"c{k} double" for k in range(len(categories))]])
    made = stored(chosen.select("text", fold, *marks).mapInArrow(_training_rows, kind), "training-rows")
    return fit_chain(*_gathered(made, len(categories)))


def _gathered(made: DataFrame, categories: int) -> tuple[_Rows, list[np.ndarray], np.ndarray]:
    """Training rows on the driver, one at a time, without the features few rows have."""
    counts = np.zeros(1 << _BITS, dtype=np.int32)
    size = 0
    for r in made.select("features").toLocalIterator():
        counts[np.frombuffer(r["features"], np.int32)] += 1
        size += 1
    often = counts >= _least_rows(size)
    row, feature, value, rest = [], [], [], []
    for n, r in enumerate(made.toLocalIterator()):
        names = np.frombuffer(r["features"], np.int32)
        kept = often[names]
        feature.append(names[kept])
        value.append(np.frombuffer(r["vals"], np.float32)[kept])
        row.append(np.full(len(feature[-1]), n, dtype=np.int32))
        rest.append([np.nan if v is None else v for v in r[2:]])
    given = np.array(rest, dtype=float).reshape(len(rest), 1 + categories)
    empty = [np.zeros(0, dtype=np.int32)]
    rows = _Rows(*(np.concatenate(x or empty) for x in (row, feature, value)), len(rest))
    return rows, list(given[:, 1:].T), given[:, 0]


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values = [], []
        for _, row, feature, words in features(batch["text"]):
            keys, counts = np.unique((row.astype(np.int64) << _BITS) | feature, return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(words) + 1, dtype=np.int64) << _BITS)
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                names.append((keys[a:b] & ((1 << _BITS) - 1)).astype(np.int32).tobytes())
                values.append(_values(counts[a:b], words[k]).astype(np.float32).tobytes())
        rest = batch.schema.names[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(values, pa.binary()), *[batch[c] for c in rest]],
            names=["features", "vals", *rest],
        )


def _probabilities(chain: list[Model], column) -> tuple[np.ndarray, np.ndarray]:
    """A row per text with a column per category, and whether each text has no words."""
    every = distinct(np.concatenate([m.chosen for m in chain]))
    place = np.full(1 << _BITS, -1, dtype=np.int16)
    place[every] = np.arange(len(every))
    out, blank = [np.zeros((0, len(chain)))], [np.zeros(0, dtype=bool)]
    for _, row, feature, words in features(column):
        at = place[feature]
        hit = np.flatnonzero(at >= 0)
        cell = row[hit].astype(np.int64) * len(every) + at[hit]
        counts = np.bincount(cell, minlength=len(words) * len(every)).reshape(len(words), len(every))
        values = _values(counts, words[:, None])
        earlier: list[np.ndarray] = []
        for model in chain:
            earlier.append(model.probability(values[:, np.searchsorted(every, model.chosen)], earlier))
        out.append(np.column_stack(earlier))
        blank.append(words == 0)
    return np.concatenate(out), np.concatenate(blank)


def scored(docs: DataFrame, chain: list[Model], categories: list[str]) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, p_<category> and <category> (boolean).

    Null, empty and blank texts have no words and get the chance of such a text, which
    no model rejects alone: they are never flagged. An empty chain flags nothing and
    gives null probabilities. Repeated rows each get a row; other columns are not
    looked at; no rows give no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [f"doc_id {id_type}", *[f"p_{c} double" for c in categories], *[f"{c} boolean" for c in categories]]
    shared = docs.sparkSession.sparkContext.broadcast([astuple(m) for m in chain])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(*m) for m in shared.value]
        for batch in batches:
            p, flags = _judged(models, batch["text"], len(categories))
            arrays = [batch["doc_id"], *[pa.array(c, from_pandas=True) for c in p], *[pa.array(c) for c in flags]]
            names = ["doc_id", *[f"p_{c}" for c in categories], *categories]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(score, ", ".join(fields))


def _judged(models: list[Model], column, categories: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    if not models:
        none = np.full(len(column), np.nan)
        return [none] * categories, [np.zeros(len(column), dtype=bool)] * categories
    p, blank = _probabilities(models, column)
    return list(p.T), [(p[:, k] >= m.threshold) & ~blank for k, m in enumerate(models)]


def without(docs: DataFrame, chain: list[Model], category: int) -> DataFrame:
    """The rows of `docs` that the chain does not flag for a category, decided where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast([astuple(m) for m in chain])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(*m) for m in shared.value]
        for batch in batches:
            flagged = _judged(models, batch["text"], category + 1)[1][category]
            yield batch.filter(pa.array(~flagged))

    return docs.mapInArrow(keep, docs.schema)
