"""Whitening of vectors: blockwise QR, Householder bidiagonal form, dqds, twisted factorisations.

Each task folds its centred rows into one triangular factor R; factors meet a few at a time until
one is left, which has the size of a vector squared. From there on the work is a small matrix:
reflections make it bidiagonal, dqds finds the squares of its singular values, each to its own
relative accuracy, and twisted factorisations of the shifted bidiagonal product give the directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import checkpointed

SCALE, SHIFT = 64.0, 1_000_000  # x = floor(SCALE * c) + SHIFT
ROWS = 1024  # rows of one block of the QR folding and of one output batch
FAN = 16  # factors that meet in one task
CLUSTER = 1e-3  # relative gap under which directions are made orthogonal to each other
_EPS = float(np.finfo(np.float64).eps)
_TINY = float(np.finfo(np.float64).tiny)
_EXACT = 1 << 62


# The small matrix


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors of the upper bidiagonal form of a square matrix."""
    a, n = np.array(r, np.float64), len(r)
    right: list[np.ndarray] = []

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        size = np.linalg.norm(v)
        if size > 0:
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
        return v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One transform of the qd arrays; None if the shift was past the least value. The last two
    results are the least and the sum of reciprocals of the values met on the way."""
    out_q, out_e, d = [0.0] * len(q), [0.0] * len(e), q[0] - shift
    least, inverse = d, 0.0
    for i, own in enumerate(e):
        if d < 0:
            return None
        inverse += 1 / d if d > _TINY else np.inf
        total = d + own
        if total == 0:
            return None
        rate = q[i + 1] / total
        out_q[i], out_e[i] = total, own * rate
        d = d * rate - shift
        least = min(least, d)
    if d < 0:
        return None
    inverse += 1 / d if d > _TINY else np.inf
    out_q[-1] = d
    return out_q, out_e, least, inverse


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    Shifts come from the trailing pair; a shift that proves too large is replaced by the reciprocal
    of the trace of the inverse, which never is. All quantities stay positive, so small values keep
    their relative accuracy.
    """
    found: list[float] = []
    blocks = [([float(x) for x in diagonal**2], [float(x) for x in upper**2], 0.0)]
    small = (10 * _EPS) ** 2
    while blocks:
        q, e, sigma = blocks.pop()
        safe = 0.0  # no value of the block is less
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (sigma + min(q[i], q[i + 1])) or e[i] <= _TINY), None)
            if cut is not None:
                if cut == len(e) - 1:
                    found.append(sigma + q.pop())
                    e.pop()
                else:
                    blocks.append((q[: cut + 1], e[:cut], sigma))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                safe = 0.0
                continue
            if len(q) == 1:
                found.append(sigma + q.pop())
                break
            if q[0] < q[-1]:  # the small end belongs at the bottom: the transpose, read backwards
                q, e = _reversed(q, e)
            trailing = _least_of_pair(q[-2], e[-1], q[-1])
            for shift in dict.fromkeys((max(trailing * (1 - 4 * _EPS), safe), safe, 0.0)):
                step = _dqds_step(q, e, shift)
                if step is not None:
                    break
            else:  # a zero on the way: it moves down and leaves as a value of its own
                q, e = [x + _TINY / _EPS for x in q], e
                continue
            q, e, _, inverse = step
            sigma += shift
            # ``inverse`` bounds the least value of what the step started from, less its shift.
            safe = max(0.0, 1 / inverse * (1 - 1e-10)) if inverse > 0 and shift == 0 else 0.0
    return np.sort(np.array(found))[::-1]


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """qd arrays of the transpose with rows and columns in reverse order; the values stay."""
    return q[::-1], e[::-1]


def _least_of_pair(q0: float, e0: float, q1: float) -> float:
    """The lesser eigenvalue of the trailing pair, without cancellation."""
    total, product = q0 + e0 + q1, q0 * q1
    root = np.sqrt(max(0.0, total * total - 4 * product))
    return 2 * product / (total + root) if total > 0 else 0.0


def twisted(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B^T B for the given eigenvalues.

    B^T B = L D L^T with D the squared diagonal. The factorisation of L D L^T - value from the top
    and the one from the bottom meet at the row where their common pivot is least; from there the
    vector follows by multiplications alone. Directions of values that nearly coincide are made
    orthogonal and, where little was left of one, solved for again.
    """
    n, vectors = len(diagonal), np.zeros((len(diagonal), len(values)))
    for k, value in enumerate(values):
        kin = [j for j in range(k) if abs(values[j] - value) <= CLUSTER * max(abs(value), _TINY)]
        start = None
        for turn in range(4):
            z = _twisted_vector(diagonal, upper, float(value), start)
            for _ in range(2):
                for j in kin:
                    z = z - vectors[:, j] * (vectors[:, j] @ z)
            size = np.linalg.norm(z)
            if size > 0.5:
                break
            start = np.cos(np.arange(n) * (turn + 1.0) + k)  # fixed, so that a repeated job gives the same
            for j in kin:
                start = start - vectors[:, j] * (vectors[:, j] @ start)
        vectors[:, k] = z / size if size > 0 else z
    return vectors


def _twisted_vector(a: np.ndarray, b: np.ndarray, value: float, start: np.ndarray | None) -> np.ndarray:
    """Solve (N diag N^T) z = gamma e_r, or = ``start`` where one is given."""
    n = len(a)
    floor = max(_EPS * max(float(np.max(a * a, initial=0)), value) * _EPS, _TINY)
    tame = lambda x: x if abs(x) > floor else np.copysign(floor, x)
    below = a[: n - 1] * b[: n - 1]  # off-diagonal of B^T B, which is D L
    down, low, s = np.zeros(n), np.zeros(max(n - 1, 0)), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = tame(a[i] * a[i] + s[i])
        low[i] = below[i] / down[i]
        s[i + 1] = low[i] * (b[i] / a[i] if a[i] else 0.0) * s[i] - value if a[i] else b[i] * b[i] - value
    down[n - 1] = tame(a[n - 1] * a[n - 1] + s[n - 1])
    up, high, p = np.zeros(n), np.zeros(max(n - 1, 0)), np.zeros(n)
    p[n - 1] = a[n - 1] * a[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = tame(b[i] * b[i] + p[i + 1])
        high[i] = below[i] / up[i + 1]
        p[i] = p[i + 1] * (a[i] * a[i] / up[i + 1]) - value
    up[0] = tame(p[0])
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    pivot = np.concatenate([down[:r], [tame(gamma[r])], up[r + 1 :]])
    if start is None:
        y = np.zeros(n)
        y[r] = 1.0
    else:  # N y' = start, outside in; then the pivots
        y = start.copy()
        for i in range(r):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 2, r - 1, -1):
            y[i] -= high[i] * y[i + 1]
        y = y / pivot
    for i in range(r - 1, -1, -1):
        y[i] -= low[i] * y[i + 1]
    for i in range(r, n - 1):
        y[i + 1] -= high[i] * y[i]
    return y / np.linalg.norm(y)


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of R^T R, falling, and its unit eigenvectors as columns.

    The largest entry of each vector is positive. The bidiagonal form is cut where its off-diagonal
    is negligible; vectors of one part have zeros elsewhere.
    """
    n = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0:
        return np.zeros(n), np.eye(n)
    a, b, right = bidiagonal(r / scale)
    b[np.abs(b) <= 4 * _EPS * np.sqrt(np.abs(a[:-1] * a[1:]))] = 0.0
    edges = [0, *(np.flatnonzero(b == 0) + 1), n]
    values, vectors = [], np.zeros((n, n))
    for lo, hi in zip(edges, edges[1:]):
        own = dqds(a[lo:hi], b[lo : hi - 1])
        vectors[lo:hi, lo:hi] = twisted(a[lo:hi], b[lo : hi - 1], own)
        values.append(own)
    for k in range(len(right) - 1, -1, -1):
        vectors[k + 1 :] -= 2 * np.outer(right[k], right[k] @ vectors[k + 1 :])
    found = np.concatenate(values)
    order = np.argsort(-found, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return found[order] * scale * scale, vectors


# Rows


def _whole(array: pa.Array, length: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and integer values of the vectors without null or non-finite entries."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    sizes = np.asarray(array.value_lengths().fill_null(0), np.int64)
    flat = array.flatten()
    ends = np.cumsum(sizes)
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan) if flat.null_count else flat.cast(pa.float64()), np.float64)
    finite = np.concatenate([[0], np.cumsum(np.isfinite(values))])
    good = (sizes > 0) & (finite[ends] - finite[ends - sizes] == sizes)
    out = {}
    for size in np.unique(sizes[good]) if length is None else [length]:
        own = np.flatnonzero(good & (sizes == size))
        x = np.floor(SCALE * values[(ends[own] - size)[:, None] + np.arange(size)])
        if len(x) and np.abs(x).max() >= float(_EXACT):
            raise ArithmeticError("an entry is too large for a 64-bit integer")
        out[int(size)] = own, x.astype(np.int64) + SHIFT
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by length and dimension of all vectors of a task."""
    total: dict[int, list] = {}
    for batch in batches:
        for size, (_, x) in _whole(batch.column(0)).items():
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            own = total.setdefault(size, [0, np.zeros(size, object)])
            own[0] += len(x)
            own[1] = own[1] + high.astype(object) * (1 << 32) + low.astype(object)
    for size, (n, sums) in total.items():
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array([size] * size, pa.int32()), "dim": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "total": pa.array([str(int(s)) for s in sums], pa.string())}
        )


@dataclass
class Centre:
    """What the rows are measured from: their number and the sum of each dimension."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where 64 bits may not do."""
        top = max(int(np.abs(x).max(initial=0)), 1)
        if self.n * top < _EXACT and max(map(abs, self.sums), default=0) < _EXACT:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, numerators: np.ndarray) -> np.ndarray:
        return (numerators / self.n).astype(np.float64)

    @staticmethod
    def deviation(numerators: np.ndarray) -> pa.Array:
        """Sum of squares of each row as decimal(38,0)."""
        top = int(np.abs(numerators).max(initial=0))
        if numerators.dtype == np.int64 and top * top * max(numerators.shape[1], 1) < _EXACT:
            return pa.array((numerators**2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        squares = (numerators.astype(object) ** 2).sum(axis=1)
        return pa.array([str(int(s)) for s in squares], pa.string()).cast(pa.decimal128(38, 0))


def _blocks(batches: Iterator[pa.RecordBatch], at: int, centre: Centre) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of at most ``ROWS`` rows: the batch, the places of its whole vectors, their numerators."""
    length = len(centre.sums)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            own, x = _whole(part.column(at), length)[length]
            if len(own):
                yield part, own, centre.numerators(x)


def _factor(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(centre.sums)))
        for _, _, numerators in _blocks(batches, 0, centre):
            r = np.linalg.qr(np.vstack([r, centre.centred(numerators)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([r.tobytes()], pa.binary())})

    return run


def _moments(centre: Centre, directions: np.ndarray):
    """Number, means and centred products of the whitened rows of a task, block merged into block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, _, numerators in _blocks(batches, 0, centre):
            w = centre.centred(numerators) @ directions
            mean = w.mean(axis=0)
            own = np.vstack([np.full(w.shape[1], float(len(w))), mean, (w - mean).T @ (w - mean)])
            held = own if held is None else _merge_moments([held, own])
        if held is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([held.tobytes()], pa.binary())})

    return run


def _merge_moments(blocks: list[np.ndarray]) -> np.ndarray:
    held = blocks[0]
    for own in blocks[1:]:
        n, m = held[0, 0], own[0, 0]
        gap = own[1] - held[1]
        held = np.vstack([np.full(held.shape[1], n + m), held[1] + gap * (m / (n + m)), held[2:] + own[2:] + np.outer(gap, gap) * (n * m / (n + m))])
    return held


def _merge_factors(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def fold_tree(rows: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], width: int) -> np.ndarray | None:
    """One matrix of ``width`` columns out of (part, block): at most ``FAN`` meet in a task, in order."""
    rows = checkpointed(rows)
    last = rows.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(b, np.float64).reshape(-1, width) for b in pdf.sort_values("at")["block"]]
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "block": [merge(held).tobytes()]})

    while last:
        rows = rows.select(F.floor(F.col("part") / FAN).alias("part"), F.col("part").alias("at"), "block")
        rows = rows.groupBy("part").applyInPandas(meet, "part long, block binary")
        last //= FAN
    return np.frombuffer(rows.first()["block"], np.float64).reshape(-1, width)


@dataclass
class Whitening:
    """A fitted transform: directions (columns over the root of their eigenvalue) and its figures."""

    centre: Centre
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def fit(rows: DataFrame, vector: Column, components: int = 32) -> Whitening | None:
    """Fit the transform to all whole vectors; None if there are none.

    The driver holds one sum and one column of R a dimension, nothing that grows with the rows.
    """
    given = rows.select(vector.alias("vector"))
    sums = checkpointed(
        given.mapInArrow(_sums, "length int, dim int, n long, total string")
        .groupBy("length", "dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total"))
    )
    most = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return None
    held = sums.where(F.col("length") == most["length"]).orderBy("dim").collect()
    centre = Centre(int(most["n"]), [int(r["total"]) for r in held])
    length = len(centre.sums)
    r = fold_tree(given.mapInArrow(_factor(centre), "part long, block binary"), _merge_factors, length)
    square = np.zeros((length, length))
    square[: min(len(r), length)] = r[:length]
    values, vectors = principal(square)
    values = values / centre.n
    k = min(components, length)
    total = float(values.sum())
    # Rounding of the factors is relative to the largest singular value; what lies under it is zero.
    real = np.sqrt(values[:k]) > 8 * length * _EPS * np.sqrt(values[0])
    directions = np.where(real, vectors[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    error = None
    if real.any():
        moments = fold_tree(given.mapInArrow(_moments(centre, directions[:, real]), "part long, block binary"), _merge_moments, int(real.sum()))
        error = float(np.abs(moments[2:] / moments[0, 0] - np.eye(int(real.sum()))).max())
    directions[:, ~real] = np.nan
    return Whitening(centre, directions, values[:k], [float(v) / total if total > 0 else None for v in values[:k]], error)


def _apply(model: Whitening, carry: list[str]):
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, numerators in _blocks(batches, len(carry), model.centre):
            w = model.centre.centred(numerators) @ np.nan_to_num(model.directions)
            w[:, np.isnan(model.directions).any(axis=0)] = np.nan
            at = pa.array(np.repeat(own, k))
            flat = w.ravel()
            columns = {c: part.column(i).take(at) for i, c in enumerate(carry)} | {
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                "n": pa.array(np.full(len(own) * k, model.centre.n, np.int64)),
                "deviation": Centre.deviation(numerators).take(pa.array(np.repeat(np.arange(len(own)), k))),
                "whitened": pa.array(flat, mask=np.isnan(flat)),
                "explained": pa.array(model.explained * len(own), pa.float64()),
                "identity_error": pa.array([model.identity_error] * (len(own) * k), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def whiten(rows: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",), components: int = 32) -> DataFrame:
    """Whiten every whole vector: a row for each vector and component.

    Entries c become floor(64 * c) + 1000000. Returns the columns of ``carry``, component, n,
    deviation (decimal(38,0)), whitened, explained and identity_error. Rows whose vector is null,
    empty or holds null or non-finite entries give no row and take no part in the fit. Vectors must
    have one length: the commonest (of equally common ones the longest) is taken, and others lack
    entries or have too many and count as not whole. Equal rows give equal results and each counts.
    A component without variance (a constant table, fewer rows than dimensions) has a null
    ``whitened``; ``explained`` is null if there is no variance at all, ``identity_error`` covers
    the components with variance and is null without any. A table without whole vectors gives no
    rows. Columns that are not carried are not read; carried ones may not have a result's name.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(
        [*(f"`{c}` {types[c]}" for c in carry), "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"]
    )
    model = fit(rows, F.col(f"`{vector}`"), components)
    given = rows.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{vector}`").alias("_vector"))
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return given.mapInArrow(_apply(model, list(carry)), schema)
