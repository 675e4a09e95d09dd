"""Whitening of embeddings by an incremental eigendecomposition.

1. Vectors become whole numbers, and each distinct one is kept once: the fit list. Its size
   and its sums per dimension are exact.
2. Each partition of the fit list starts from no variance at all and adds its centred
   vectors by rank-one updates. An update needs the roots of a secular equation, one
   between each two neighbouring eigenvalues; directions that the vector does not touch,
   and all but one of equal eigenvalues, are deflated first. Vectors are folded beforehand:
   an orthogonal transformation of a few thousand of them leaves as many as there are
   dimensions, with the same sum of outer products, so there are far fewer updates than rows.
3. Spectra of partitions meet in groups of a fixed number, round by round: the eigenvectors of
   one, scaled by the roots of its eigenvalues, are rank-one updates of the next.
4. A Rayleigh-Ritz step over the fit list refines the last spectrum to double precision: the
   covariance within the basis that it spans, summed over partitions, is nearly diagonal, and
   its own small eigenproblem gives the components.

What a task or the driver holds are matrices of dimension by dimension, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.sources.scratch import stored

SCALE, OFFSET = 64, 1_000_000
# Rows folded into one set of updates, and matrices that one task adds up.
_FOLD, _GROUP = 4096, 16
_LONG = (1 << 63) - 1
_EPS = float(np.finfo(np.float64).eps)


# --- rank-one updates ----------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) as (nearest pole, distance from it).

    Poles ascend and differ; weights are positive. One root lies above each pole. Each is
    sought from the nearer end of its interval, so that small distances keep their digits:
    by the equation with its two nearest poles exact, or by halving where that leaves
    the interval in which the root must lie.
    """
    k = len(poles)
    rows = np.arange(k)
    far = np.append(poles[1:], poles[-1] + weights.sum())
    middle = (far - poles) / 2
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        f = 1 + (weights / (poles[None, :] - poles[:, None] - middle[:, None])).sum(axis=1)
        right = (f < 0) & (rows < k - 1)
        origin = np.where(right, np.minimum(rows + 1, k - 1), rows)
        delta = poles[None, :] - poles[origin][:, None]
        low = np.where(right, -middle, np.where(f < 0, middle, 0.0))
        high = np.where(right, 0.0, np.where(f < 0, far - poles, middle))
        x = (low + high) / 2
        upper = np.arange(k)[None, :] > rows[:, None]
        for _ in range(100):
            t = delta - x[:, None]
            q = weights / t
            slope = q / t
            f = 1 + q.sum(axis=1)
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            above = np.where(upper, slope, 0.0).sum(axis=1)
            below = slope.sum(axis=1) - above
            near, next_ = t[rows, rows], t[rows, np.minimum(rows + 1, k - 1)]
            c = f - below * near - np.where(rows < k - 1, above * next_, 0.0)
            a = c * (near + next_) + below * near**2 + above * next_**2
            b = near * next_ * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = near[-1] + below[-1] * near[-1] ** 2 / c[-1]
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            # Done where rounding decides the sign of the sum.
            done = np.abs(f) <= 4 * _EPS * (1 + np.abs(q).sum(axis=1))
            new = np.where(done, x, new)
            if np.all(np.abs(new - x) <= 2 * _EPS * np.abs(new)):
                break
            x = new
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after adding the outer product of `vector`."""
    z = basis.T @ vector
    length = float(z @ z)
    if length == 0:
        return values, basis
    tiny = 8 * _EPS * max(float(values[-1]), length)
    # Equal eigenvalues: a reflection turns their part of the vector into one direction.
    starts = np.flatnonzero(np.concatenate(([True], np.diff(values) > tiny)))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
        part = z[i:j].copy()
        size = float(np.linalg.norm(part))
        if j - i == 1 or size == 0:
            continue
        sign = 1.0 if part[-1] >= 0 else -1.0
        part[-1] += sign * size
        part /= np.linalg.norm(part)
        basis = basis.copy()
        basis[:, i:j] -= 2 * np.outer(basis[:, i:j] @ part, part)
        z[i:j] = 0
        z[j - 1] = -sign * size
    live = np.abs(z) * np.sqrt(length) > tiny
    if not live.any():
        return values, basis
    poles, weights = values[live], z[live] ** 2
    origin, apart = secular_roots(poles, weights)
    # root k minus pole i, without cancellation
    gaps = (poles[origin][:, None] - poles[None, :]) + apart[:, None]
    # The vector that has exactly these roots: its eigenvectors are orthogonal to working precision.
    spread = poles[None, :] - poles[:, None]
    np.fill_diagonal(spread, 1.0)
    ratio = np.prod(gaps.T / spread, axis=1)
    exact = np.sqrt(np.abs(ratio)) * np.sign(z[live])
    vectors = exact[:, None] / gaps.T
    vectors /= np.linalg.norm(vectors, axis=0)
    out_values, out_basis = values.copy(), basis.copy()
    out_values[live] = poles[origin] + apart
    out_basis[:, live] = basis[:, live] @ vectors
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_basis[:, order]


# --- partitions ------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as long integers; shorter rows end in zeros."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def _scaled(id_type: pa.DataType):
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vector"]
            numbers = np.floor(np.asarray(vectors.values, dtype=np.float64) * SCALE)
            # The nearest long of what is beyond its range.
            with np.errstate(invalid="ignore"):
                whole = np.where(np.abs(numbers) < 2.0**62, numbers, 0).astype(np.int64)
            whole[numbers >= 2.0**62], whole[numbers <= -(2.0**62)] = 1 << 62, -(1 << 62)
            y = pa.ListArray.from_arrays(vectors.offsets, pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(id_type), y], names=["vec_id", "y"])

    return scale


def _dimension_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums per dimension of a partition, as digits."""
    totals: list[int] = []
    for batch in batches:
        y = _matrix(batch["y"])
        totals += [0] * (y.shape[1] - len(totals))
        # Halves of 32 bits cannot overflow over one batch.
        high, low = (y >> 32).sum(axis=0), (y & 0xFFFFFFFF).sum(axis=0)
        for k, (a, b) in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
            totals[k] += (a << 32) + b
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(totals)), pa.int32()), pa.array([str(t) for t in totals], pa.string())], names=["dim", "total"]
    )


def _centred(y: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.zeros((len(y), len(centre)))
    out[:, : y.shape[1]] = y
    return out - centre


def _blocks(batches: Iterator[pa.RecordBatch], centre: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Centred rows of a partition, `size` at a time."""
    held, rows = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = _centred(_matrix(batch["y"].slice(k, size)), centre)
            held.append(part)
            rows += len(part)
            if rows >= size:
                yield np.concatenate(held)
                held, rows = [], 0
    if held:
        yield np.concatenate(held)


def _packed(values: np.ndarray, basis: np.ndarray) -> bytes:
    return np.concatenate((values[None, :], basis)).astype("<f8").tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = (int(np.sqrt(1 + 4 * (len(raw) // 8))) - 1) // 2
    both = np.frombuffer(raw, dtype="<f8").reshape(d + 1, d)
    return both[0].copy(), both[1:].copy()


def _node(raw: bytes) -> pa.RecordBatch:
    at = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([raw], pa.binary())], names=["node", "held"])


def _spectrum(centre: np.ndarray):
    """The spectrum of a partition's sum of outer products, by rank-one updates."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        values, basis = np.zeros(d), np.eye(d)
        for rows in _blocks(batches, centre, max(_FOLD, d)):
            # As many rows as dimensions, with the same sum of outer products.
            folded = np.linalg.qr(rows, mode="r") if len(rows) > d else rows
            for vector in folded:
                values, basis = rank_one(values, basis, vector)
        yield _node(_packed(values, basis))

    return update


def _combined(held: list[bytes]) -> bytes:
    """One spectrum of several: each further one's scaled eigenvectors are updates."""
    values, basis = _unpacked(held[0])
    for raw in held[1:]:
        more, vectors = _unpacked(raw)
        for size, vector in zip(more, vectors.T, strict=True):
            if size > 0:
                values, basis = rank_one(values, basis, np.sqrt(size) * vector)
    return _packed(values, basis)


def _added(held: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(h, dtype="<f8") for h in held], axis=0).tobytes()


def _products(centre: np.ndarray, basis: np.ndarray):
    """A partition's sum of outer products within a basis."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for rows in _blocks(batches, centre, _FOLD):
            inside = rows @ basis
            total += inside.T @ inside
        yield _node(total.tobytes())

    return add


def _folded(nodes: DataFrame, join: Callable[[list[bytes]], bytes]) -> bytes:
    """Join the matrices of all nodes, a fixed number in a task, until one is left."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        held = join(table["held"].to_pylist())
        node = table["node"][0].as_py() // _GROUP
        return pa.table({"node": pa.array([node], pa.int64()), "held": pa.array([held], pa.binary())})

    kind = "node long, held binary"
    nodes = stored(nodes, "nodes")
    while nodes.count() > 1:
        group = F.floor(F.col("node") / _GROUP)
        nodes = stored(nodes.groupBy(group).applyInArrow(together, kind), "nodes")
    return bytes(nodes.first()["held"])


def _results(id_type: pa.DataType, n: int, sums: list[int], axes: np.ndarray, extra: dict):
    centre = np.array([float(Fraction(s, n)) for s in sums])
    wrapped_sums = np.array([s & ((1 << 64) - 1) for s in sums], dtype=np.uint64)
    wrapped_n = np.uint64(n & ((1 << 64) - 1))

    def deviation(y: np.ndarray, centred: np.ndarray) -> list[int | None]:
        """Exact modulo 2^64; the size in floating point tells what a long cannot hold."""
        padded = np.zeros((len(y), len(sums)), dtype=np.uint64)
        padded[:, : y.shape[1]] = y.astype(np.uint64)
        apart = wrapped_n * padded - wrapped_sums
        exact = (apart * apart).sum(axis=1, dtype=np.uint64)
        about = ((centred * float(n)) ** 2).sum(axis=1)
        out: list[int | None] = []
        for k, (value, size) in enumerate(zip(exact.tolist(), about.tolist(), strict=True)):
            if size > 0.99 * 2.0**63:
                row = [*y[k].tolist(), *[0] * (len(sums) - y.shape[1])]
                whole = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) if size < 1.01 * 2.0**63 else 1 << 64
                out.append(whole if whole <= _LONG else None)
            else:
                out.append(value)
        return out

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = axes.shape[1]
        for whole in batches:
            for low in range(0, whole.num_rows, _FOLD):
                batch = whole.slice(low, _FOLD)
                y = _matrix(batch["y"])
                centred = _centred(y, centre)
                rows = pa.array(np.repeat(np.arange(len(y)), m))
                white = (centred @ axes).ravel()
                missing = np.isnan(white)
                columns = [
                    batch["vec_id"].take(rows).cast(id_type),
                    pa.array(np.tile(np.arange(1, m + 1), len(y)), pa.int32()),
                    pa.array(np.full(len(white), n), pa.int64()),
                    pa.array(deviation(y, centred), pa.int64()).take(rows),
                    pa.array(white, mask=missing),
                    pa.array(np.tile(extra["explained"], len(y)), mask=np.tile(np.isnan(extra["explained"]), len(y))),
                    pa.array([extra["identity_error"]] * len(white), pa.float64()),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return whiten


def whitened(rows: DataFrame, components: int = 16, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out. An entry
    c becomes floor(64 c) + 1,000,000 (at most 2^62 away from the million). The fit list holds
    each distinct vector x once: n of them, S their sum. Components are unit eigenvectors of
    its covariance (divisor n), numbered from 1 by falling eigenvalue e. deviation is the
    sum over dimensions of (n x - S)^2, exact, null where a long cannot hold it; whitened is
    (x - S / n) along the component over the root of e; explained is e over the trace;
    identity_error is one value, the largest entry of whitened's covariance over the fit
    list minus the identity.

    The dimension is the longest vector's; entries that shorter ones lack count as 0. There
    are at most as many components as dimensions, so no rows, and only empty vectors,
    give no rows. A component without variance (as with one distinct vector) has whitened
    null and takes no part in identity_error, which is null if all are such; explained is 0
    there, and null if there is no variance at all. Repeated rows and ids each give
    their rows; ids, null ones too, are passed through. Other columns are not looked at.
    """
    id_type = to_arrow_type(rows.schema[id_column].dataType)
    numbers = F.col(vector).cast("array<double>")
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select(F.col(id_column).alias("vec_id"), numbers.alias("vector"), finite.alias("finite"))
    kept = kept.where("vector IS NOT NULL AND finite").select("vec_id", "vector")
    id_name = rows.schema[id_column].dataType.simpleString()
    whole = stored(kept.mapInArrow(_scaled(id_type), f"vec_id {id_name}, y array<long>"), "whole")
    # Zeros behind the last entry are the same as none, and a vector is the same either way.
    fit = stored(_trimmed(whole).distinct(), "fit")

    kind = f"vec_id {id_name}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = whole.agg(F.max(F.size("y"))).first()[0] or 0
    if width == 0:
        return rows.sparkSession.createDataFrame([], kind)
    n = fit.count()
    found = fit.mapInArrow(_dimension_sums, "dim int, total string").groupBy("dim")
    found = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row per dimension
    sums = [0] * width
    for row in found:
        sums[row["dim"]] = int(row["total"])
    centre = np.array([float(Fraction(s, n)) for s in sums])

    kind_of_node = "node long, held binary"
    _, basis = _unpacked(_folded(fit.mapInArrow(_spectrum(centre), kind_of_node), _combined))
    basis = np.linalg.qr(basis)[0]
    inside = np.frombuffer(_folded(fit.mapInArrow(_products(centre, basis), kind_of_node), _added), "<f8")
    values, turned = np.linalg.eigh(inside.reshape(width, width) / n)
    values, axes = np.maximum(values[::-1], 0), (basis @ turned)[:, ::-1]
    trace = float(values.sum())

    count = min(components, width)
    varied = values[:count] > width * _EPS * trace
    scaled = np.full((width, count), np.nan)
    scaled[:, varied] = axes[:, :count][:, varied] / np.sqrt(values[:count][varied])
    error = None
    if varied.any():
        spread = np.frombuffer(_folded(fit.mapInArrow(_products(centre, scaled[:, varied]), kind_of_node), _added), "<f8")
        held = int(varied.sum())
        error = float(np.abs(spread.reshape(held, held) / n - np.eye(held)).max())
    explained = np.where(varied, values[:count] / trace, 0.0) if trace > 0 else np.full(count, np.nan)
    extra = {"explained": explained, "identity_error": error}
    return whole.mapInArrow(_results(id_type, n, sums, scaled, extra), kind)


def _trimmed(whole: DataFrame) -> DataFrame:
    """The vectors, without zeros at their ends."""
    last = F.expr("array_max(transform(y, (v, k) -> if(v = 0, 0, k + 1)))")
    return whole.select(F.slice("y", F.lit(1), F.coalesce(last, F.lit(0))).alias("y"))
