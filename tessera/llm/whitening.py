"""Embedding whitening by a bidiagonal qd solver.

Entries become integers (floor(256 * c)); the fit list is each distinct vector once, found by a shuffle that combines
equal vectors before they travel.  Its count and sums are exact.  Every task reduces its centred rows by QR to one small
triangle, and triangles are stacked and reduced again, FAN at a time, until one R is left: R'R is n times the covariance, and
it is never formed, so nothing is lost by squaring.  R is as wide as a vector, whatever the number of rows (at most MAX_WIDTH, checked).

On R: Householder reflections from both sides make it bidiagonal, dqds (differential quotient-difference with shifts)
finds all singular values to high relative accuracy, and a twisted factorisation of each wanted one gives its vector, which
the reflections carry back to a whitening direction.

Defined cases: a vector that is null, or holds a null, NaN or infinite entry, has no rows in the result; a shorter vector than the longest
counts as filled with zeros, an empty one too; components whose variance is under RANK times the total are left out (none for fewer than two distinct
vectors, or if all are empty); repeated rows and a null vec_id give rows each; a deviation beyond 64 bits is null;
entries beyond +-2**62 count as that; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import table, written

SCALE, COMPONENTS = 256, 4
#: Triangles that one task stacks and reduces to one.
FAN = 16
#: Octets of rows worked on at a time.
STEP = 4 << 20
#: Widest vectors: R has the square of that in entries, and comes to the driver.
MAX_WIDTH = 4096
#: Least share of the total variance of a component that is whitened.
RANK = 1e-13
_EPS = np.finfo(float).eps


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows are whole, their lengths, all their entries as doubles) of an array of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # a null entry is NaN here
    edges = np.concatenate([[0], np.cumsum(sizes)])
    broken = np.concatenate([[0], np.cumsum(bad)])
    whole = (broken[edges[1:]] == broken[edges[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return whole, sizes, values[np.repeat(whole, sizes)]


def _integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are whole, their integer vectors filled up to width)."""
    whole, sizes, values = _lists(column)
    own = sizes[whole]
    out = np.zeros((len(own), width), np.int64)
    row = np.repeat(np.arange(len(own)), own)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * values), -(2.0**62), 2.0**62)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(own) - own, own)] = scaled.astype(np.int64)
    return whole, out


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about STEP octets of vectors."""
    rows = max(1, STEP // (8 * max(1, width)))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, width)


def fit_list(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """x: each distinct integer vector once, packed; written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, width):
            _, x = _integers(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.unique(x, axis=0)], pa.binary())], ["x"])

    return written(vectors.select(column).mapInArrow(pack, "x binary").distinct(), "vectors")


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each of their entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in _slices(batches, width):
            x = _unpacked(batch, width)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # halves can't pass 64 bits within a slice
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], ["place", "total"])

    parts = fit.mapInArrow(add, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got = {r.place: int(r.total) for r in parts.collect()}  # one row for each dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


def _triangle(stacked: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stacked, mode="r")


def reduced(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of a QR factorisation of the centred vectors, by tasks and then by trees of FAN triangles."""
    width = len(mean)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in _slices(batches, width):
            held = _triangle(np.vstack([held, _unpacked(batch, width) - mean]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["node", "r"])

    def stack(node: pa.Table) -> pa.Table:
        held = np.zeros((0, width))
        for _, r in sorted(zip(node.column("node").to_pylist(), node.column("r").to_pylist(), strict=True)):
            held = _triangle(np.vstack([held, np.frombuffer(r).reshape(-1, width)]))
        return pa.table({"node": pa.array([node.column("node")[0].as_py() // FAN], pa.int64()), "r": pa.array([held.tobytes()], pa.binary())})

    level = written(fit.mapInArrow(block, "node long, r binary"), "triangles")
    most = level.agg(F.max("node")).first()[0] or 0
    while most > 0:
        level, most = level.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(stack, "node long, r binary"), most // FAN
    rows = level.collect()  # one triangle
    return np.frombuffer(rows[0].r).reshape(-1, width) if rows else np.zeros((0, width))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflections) of an upper bidiagonal matrix with the singular values of r (square)."""
    a, n, right = r.astype(float).copy(), r.shape[1], []

    def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max() if len(x) else 0.0
        if scale == 0 or not np.abs(x[1:]).any():
            return np.zeros_like(x), float(x[0]) if len(x) else 0.0
        v = x / scale
        size = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= size
        return v / np.linalg.norm(v), size * scale

    d, e = np.zeros(n), np.zeros(max(0, n - 1))
    for k in range(n):
        v, d[k] = reflection(a[k:, k].copy())
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k + 1 < n:
            w, e[k] = reflection(a[k, k + 1 :].copy())
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            right.append(w)
    return d, e, right


def dqds(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All singular values of the upper bidiagonal matrix with diagonal d and superdiagonal e, falling.

    Each sweep is a qd transform with a shift below the least squared value of its segment; one that fails (a quotient below zero) is made
    again with a smaller shift, and without a shift it can't fail.
    """
    q, off = (d * d).tolist(), (e * e).tolist()
    found: list[float] = []
    todo = [(0, len(q), 0.0)]
    while todo:
        a, b, shifted = todo.pop()
        shift, sweeps = 0.0, 0
        while b > a:
            split = next((i for i in range(b - 2, a - 1, -1) if off[i] <= (10 * _EPS) ** 2 * min(q[i], q[i + 1]) or off[i] + (q[i] * off[i]) ** 0.5 <= 2 * _EPS * shifted), None)
            if b - a == 1 or split == b - 2:
                found.append(max(0.0, q[b - 1] + shifted))
                b, shift = b - 1, 0.0
                continue
            if split is not None:
                todo.append((a, split + 1, shifted))
                a, shift = split + 1, 0.0
                continue
            while True:
                new_q, new_e, t, least = q[a:b], off[a : b - 1], q[a] - shift, q[a] - shift
                for i in range(b - a - 1):
                    new_q[i] = t + off[a + i]
                    ratio = q[a + i + 1] / new_q[i] if new_q[i] > 0 else 0.0
                    new_e[i] = off[a + i] * ratio
                    t = t * ratio - shift
                    least = min(least, t)
                new_q[-1] = t
                if least >= 0 or shift == 0:
                    break
                shift = shift / 4 if sweeps % 2 else 0.0
                sweeps += 1
            q[a:b], off[a : b - 1] = [max(0.0, x) for x in new_q], new_e
            shifted += shift
            shift, sweeps = 0.75 * max(0.0, least), sweeps + 1
            # near the end the last quotient is the least value but for its neighbour's quotient
            shift = max(shift, q[b - 1] - off[b - 2] if off[b - 2] < q[b - 1] / 16 else 0.0)
    return np.sqrt(np.sort(np.array(found))[::-1])


def _twists(d: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from above and from below of B'B - value, and the size of each twist's pivot."""
    n, pivots, low = len(d), d * d, e / d[:-1]
    tiny = float(pivots.max()) * 2.0**-240
    s, up, down = np.zeros(n), np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + pivots[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = pivots[i] * low[i] / pivot
        s[i + 1] = up[i] * low[i] * s[i] - value
    p = np.zeros(n)
    p[-1] = pivots[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = pivots[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        ratio = pivots[i] / pivot
        down[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    return up, down, np.abs(s + p + value)


def directions(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (as columns) of the bidiagonal matrix for some of its singular values, by twisted factorisations.

    Values too near to tell apart share a space: the twists of least pivots are taken one after another, each made orthogonal to those before it.
    """
    n, norm = len(d), max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    d = np.where(np.abs(d) < norm * 2.0**-70, norm * 2.0**-70, d)  # keeps the factors of B'B finite, far below rounding
    out: list[np.ndarray] = []
    for value in values:
        up, down, gamma = _twists(d, e, float(value) ** 2)
        near = [z for z, v in zip(out, values, strict=False) if abs(v - value) <= 1e-5 * values[0]]
        best: tuple[float, np.ndarray] = (-1.0, np.zeros(n))
        for twist in np.argsort(gamma, kind="stable")[: max(8, len(near) + 4)]:
            z = np.zeros(n)
            z[twist] = 1
            for i in range(twist - 1, -1, -1):
                z[i] = -up[i] * z[i + 1]
            for i in range(twist, n - 1):
                z[i + 1] = -down[i] * z[i]
            size = np.abs(z).max()
            z = z / size / np.linalg.norm(z / size)
            for _ in range(2):
                for known in near:
                    z = z - (known @ z) * known
            left = float(np.linalg.norm(z))
            if left > best[0]:
                best = (left, z / left if left else z)
            if left > 0.5:
                break
        out.append(best[1])
    return np.array(out).T.reshape(n, len(out))


def principal(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(variances, falling; directions as columns; total variance) of n centred rows whose QR factor is r."""
    width = r.shape[1]
    square = np.zeros((width, width))
    square[: len(r)] = r[:width]
    d, e, right = bidiagonal(square)
    values = dqds(d, e)
    total = float((values**2).sum()) / n
    keep = [v for v in values[:most].tolist() if v * v / n > RANK * total]
    z = directions(d, e, np.array(keep)) if keep else np.zeros((width, 0))
    for k in range(len(right) - 1, -1, -1):
        z[k + 1 :] -= 2 * np.outer(right[k], right[k] @ z[k + 1 :])
    return np.array(keep) ** 2 / n, z, total


def _projected(x: np.ndarray, mean: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (x - mean) @ to


def identity_error(fit: DataFrame, n: int, mean: np.ndarray, to: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity; two passes, centred first."""
    k, width = to.shape[1], len(mean)

    def total(of) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: np.ndarray | float = 0.0
            for b in _slices(batches, width):
                held = held + of(_projected(_unpacked(b, width), mean, to))
            if isinstance(held, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held, pa.float64())], ["place", "total"])

        rows = fit.mapInArrow(add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        return np.array([r.total for r in sorted(rows)])

    middle = total(lambda y: y.sum(0)) / n
    covariance = total(lambda y: ((y - middle).T @ (y - middle)).ravel()).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """For each row of vectors with a whole vector and each of the first most components: key, component, n, deviation, whitened, explained, identity_error."""
    kind = f"{vectors.schema[key].dataType.simpleString()}"
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.select(key, column)
    width = vectors.agg(F.max(F.size(column))).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries: R would not be small")
    fit = fit_list(vectors, column, width) if width > 0 else None
    n, totals = sums(fit, width) if fit is not None else (0, [])
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    mean = np.array([t / n for t in totals])
    variances, axes, total = principal(reduced(fit, mean), n, most)
    k = len(variances)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    to = axes / np.sqrt(variances)
    error, explained = identity_error(fit, n, mean, to), variances / total
    exact = np.array(totals, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, width):
            whole, x = _integers(batch.column(1), width)
            y, rows = _projected(x, mean, to), int(whole.sum())
            deviations = _deviations(x, n, totals, exact)
            ids = batch.column(0).filter(pa.array(whole))
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), deviations.take(each), pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, schema)


def _deviations(x: np.ndarray, n: int, totals: list[int], exact: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n * x - S) ** 2 of each row, exact; null where it passes 64 bits."""
    reach = max((abs(n * int(m) - t) for m, t in [*zip(x.max(0), totals, strict=True), *zip(x.min(0), totals, strict=True)]), default=0) if len(x) else 0
    if x.shape[1] * reach * reach < 2**63 and max(map(abs, totals), default=0) < 2**62 and (not len(x) or n * int(np.abs(x).max()) < 2**62):
        return pa.array(((n * x - np.array(totals, np.int64)) ** 2).sum(1), pa.int64())
    big = (((n * x.astype(object)) - exact) ** 2).sum(1).tolist()
    return pa.array([v if v < 2**63 else None for v in big], pa.int64())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
