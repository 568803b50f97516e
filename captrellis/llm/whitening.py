"""Embedding whitening by incremental eigendecomposition.

Every task keeps the spectrum of the scatter matrix of its rows and lets centred rows in as rank-one updates: the
new eigenvalues are the roots of a secular equation, directions that a row does not touch are deflated. Rows come in
blocks; a block of more rows than dimensions is first turned into the rows of its triangular factor, which have the
same scatter, so that it costs one update per dimension and one for its mean (``block_rows=1`` updates row by row).
Spectra of tasks are combined in a tree, again by rank-one updates: one per direction of the other side and one for
the distance of the means. The basis so found only has to be close: a distributed Rayleigh-Ritz pass projects all rows
on it, and the small projected matrix gives the final directions.

Vectors are arrays of longs (fixed point), so that counts, sums and deviations are exact whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches
from captrellis.session import stage

#: States that one task of the combining tree merges.
FAN = 16
#: Rows that one vectorised step of a pass works on, and that enter the spectrum as one block.
STEP_ROWS = 2048
BLOCK_ROWS = 1024
EPS = np.finfo(float).eps
#: Entries beyond this size are no fixed-point numbers: sums of 2^22 of them must fit a long.
LARGEST = 1 << 40


def fixed_point(column: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` per entry; NULL for a vector that is null, empty or holds an entry that is null,
    not finite or too large (2^40 after scaling)."""
    x = f"transform(`{column}`, c -> floor({scale}D * CAST(c AS DOUBLE)) + {offset})"
    fits = f"size(`{column}`) > 0 AND forall(`{column}`, c -> c IS NOT NULL AND abs({scale}D * CAST(c AS DOUBLE)) < {LARGEST}D)"
    return F.expr(f"IF({fits}, transform({x}, c -> CAST(c AS BIGINT)), NULL)")


@lru_cache(maxsize=256)
def _lower(k: int, diagonal: int) -> np.ndarray:
    return np.tri(k, k, diagonal)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z2 / (d - x)`` for ascending, distinct ``d`` and positive ``z2``.

    Returns the roots and the matrix ``d[j] - root[i]``. A root is searched as its distance from the nearer pole, so
    these differences keep their relative precision. Two-pole rational steps, halved intervals where one leaves its bracket.
    """
    k = len(d)
    last = d[-1] + z2.sum()
    upper = np.append(d[1:], last)
    middle = (d + upper) / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    right = (at_middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(right, upper, d)
    pole = d - origin[:, None]
    below, above = d - origin, upper - origin
    half = middle - origin
    low = np.where(at_middle < 0, half, below)
    high = np.where(at_middle < 0, above, half)
    x = (low + high) / 2
    left = _lower(k, 0)
    for _ in range(100):
        gap = pole - x[:, None]
        terms = z2 / gap
        slopes = terms / gap
        total, psi = terms.sum(axis=1), np.einsum("ij,ij->i", terms, left)
        value = 1 + total
        done = np.abs(value) <= 4 * EPS * k * (1 + total - 2 * psi)  # left terms are negative, right ones positive
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        # Left terms act like r + s / (a - x), right ones like p + q / (b - x), with equal value and slope at x.
        a, b = below - x, above - x
        dpsi = np.einsum("ij,ij->i", slopes, left)
        dphi = slopes.sum(axis=1) - dpsi
        s, q = dpsi * a * a, dphi * b * b
        c = value - dpsi * a - dphi * b
        # c + s / (a - t) + q / (b - t) = 0 for the step t.
        e = c * (a + b) + s + q
        f = c * a * b + s * b + q * a
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(e * e - 4 * c * f, 0))
            first = np.where(e > 0, 2 * f / (e + root), (e - root) / (2 * c))
            second = np.where(e > 0, (e + root) / (2 * c), 2 * f / (e - root))
        step = np.where((x + first > low) & (x + first < high), first, second)
        moved = x + step
        inside = (moved > low) & (moved < high)
        fresh = np.where(inside, moved, (low + high) / 2)
        if np.array_equal(fresh, x) or ((high - low) <= 4 * EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
        x = np.where(done, x, fresh)
    return origin + x, pole - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of ``vectors @ diag(values) @ vectors.T + v v^T``."""
    z = v @ vectors
    norm2 = float(z @ z)
    scale = max(float(values[-1]), norm2)
    if norm2 <= 0 or scale <= 0:
        return values, vectors
    tolerance = 8 * EPS * scale
    active = np.abs(z) * np.sqrt(norm2) > tolerance
    # Equal eigenvalues: a rotation within their plane leaves the row in one direction only.
    at = np.flatnonzero(active)
    if len(at) > 1:
        gaps = np.diff(values[at]) * np.abs(z[at[:-1]] * z[at[1:]]) / (z[at[:-1]] ** 2 + z[at[1:]] ** 2)
        if (gaps <= tolerance).any():
            values, vectors = values.copy(), vectors.copy()
            i = at[0]
            for j in at[1:]:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if (values[j] - values[i]) * abs(c * s) <= tolerance:
                    vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                    values[i], values[j] = values[i] * c * c + values[j] * s * s, values[i] * s * s + values[j] * c * c
                    z[i], z[j] = 0, r
                    active[i] = False
                i = j
    at = np.flatnonzero(active)
    if len(at):
        d = values[at]
        roots, gaps = secular_roots(d, z[at] ** 2)
        # The row that has exactly these roots: eigenvectors from it are orthogonal to rounding.
        k = len(at)
        ahead = np.append(d[1:], d[-1] + 1)
        denominator = np.where(_lower(k, -1) > 0, d, ahead) - d[:, None]  # the last column stands for a factor of one
        denominator[:, -1] = 1
        exact = np.sqrt(np.abs(np.prod(gaps / denominator.T, axis=0))) * np.sign(z[at])
        turned = exact[:, None] / gaps.T
        turned /= np.sqrt((turned * turned).sum(axis=0))
        if k == len(values):
            values, vectors = roots, vectors @ turned
        else:
            values, vectors = values.copy(), vectors.copy()
            vectors[:, at] = vectors[:, at] @ turned
            values[at] = roots
    if (values[1:] >= values[:-1]).all():
        return values, vectors
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and eigenvalues and directions of the scatter matrix about the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def add(self, rows: np.ndarray) -> None:
        """A block of rows, centred: as many updates as its triangular factor has rows, which has the same scatter."""
        sums = rows.sum(axis=0)
        centred = from_mean(rows, len(rows), sums)
        if len(rows) == 1:
            centred = centred[:0]
        elif len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        self._join(len(rows), sums, centred)

    def merge(self, other: Spectrum) -> None:
        """Another task's rows: one update per direction that they have."""
        directions = np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T
        self._join(other.n, other.sums, directions[other.values > 0])

    def _join(self, n: int, sums: np.ndarray, directions: np.ndarray) -> None:
        """Rank-one updates by ``directions``, and one by the distance of the two means."""
        for v in directions:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        if self.n and n:
            q, r = np.divmod(sums, n)
            away = from_mean(q[None, :], self.n, self.sums)[0] + r / n
            away *= np.sqrt(self.n / (self.n + n) * n)
            self.values, self.vectors = rank_one(self.values, self.vectors, away)
        self.n += n
        self.sums = self.sums + sums

    def packed(self) -> dict:
        return {"n": self.n, "sums": self.sums.tobytes(), "matrix": np.vstack([self.values, self.vectors]).tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Spectrum:
        sums = np.frombuffer(row["sums"], np.int64)
        matrix = np.frombuffer(row["matrix"]).reshape(len(sums) + 1, len(sums))
        return cls(row["n"], sums, matrix[0], matrix[1:])


def from_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` in doubles; only the part after the point is rounded."""
    q, r = np.divmod(sums, n)
    return (x - q).astype(float) - r / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """``sum((n * x - sums)^2)`` per row, exact; None where it is beyond a long."""
    q, r = np.divmod(sums, n)
    away = x - q
    most = int(np.abs(away).max(initial=0) + 1) * n
    if most * most * x.shape[1] < 1 << 63:
        return ((away * n - r) ** 2).sum(axis=1).tolist()
    exact = ((away.astype(object) * n - r.astype(object)) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Steps of a batch with their vectors as one integer matrix."""
    for start in range(0, batch.num_rows, STEP_ROWS):
        part = batch.slice(start, STEP_ROWS)
        vectors = part.column(column)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        yield part, flat.reshape(part.num_rows, -1)


def _task_states(vectors: DataFrame, column: str, state: Callable[[Iterator[np.ndarray]], dict | None]) -> DataFrame:
    """One packed state per task, staged: ``part, n, sums, matrix``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = state(x for batch in batches for _, x in _matrices(batch, column))
        if found:
            row = {"part": TaskContext.get().partitionId()} | found
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("matrix", pa.binary())]))

    return stage(vectors.select(column).mapInArrow(apply, "part long, n long, sums binary, matrix binary"), "whitening-states")


def _combined(states: DataFrame, merge: Callable[[list[dict]], dict]) -> dict | None:
    """The states merged in a tree of ``FAN`` at a time, in the order of their parts; only the last one leaves the tasks."""
    held = states.agg(F.max("part")).first()[0]

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([merge(rows) | {"part": key[0].as_py()}], table.schema)

    while held:
        states = states.groupBy(F.expr(f"part DIV {FAN}").alias("up")).applyInArrow(apply, states.schema)
        held //= FAN
    row = states.first()
    return row.asDict() if row else None


def _merge_spectra(rows: list[dict]) -> dict:
    out = Spectrum.unpacked(rows[0])
    for row in rows[1:]:
        out.merge(Spectrum.unpacked(row))
    return out.packed()


def _merge_sums(rows: list[dict]) -> dict:
    """Adds counts, sums and matrices."""
    sums = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
    matrix = np.sum([np.frombuffer(r["matrix"]) for r in rows], axis=0)
    return {"n": sum(r["n"] for r in rows), "sums": sums.tobytes(), "matrix": matrix.tobytes()}


@dataclass
class Whitening:
    """Exact count and sums, falling eigenvalues, directions as columns, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self, components: int) -> int:
        """Components that can be whitened: eigenvalues of zero, to rounding, cannot."""
        return int((self.values[:components] > len(self.sums) * EPS * max(self.trace, 0)).sum())

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        k = self.kept(components)
        return from_mean(x, self.n, self.sums) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def _projected_moments(vectors: DataFrame, column: str, project: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and mean square matrix of all projected rows, and their number."""

    def state(steps: Iterator[np.ndarray]) -> dict | None:
        n, sums, matrix = 0, 0.0, 0.0
        for x in steps:
            y = project(x)
            n, sums, matrix = n + len(y), sums + y.sum(axis=0), matrix + y.T @ y
        return {"n": n, "sums": sums.tobytes(), "matrix": matrix.tobytes()} if n else None

    row = _combined(_task_states(vectors, column, state), _merge_sums)
    sums = np.frombuffer(row["sums"])
    return sums / row["n"], np.frombuffer(row["matrix"]).reshape(len(sums), len(sums)) / row["n"], row["n"]


def fit_whitening(vectors: DataFrame, column: str = "x", block_rows: int = BLOCK_ROWS) -> Whitening | None:
    """The eigendecomposition of the covariance (divisor n) of all rows of ``column``, an array of longs.

    None for a table without vectors. Null vectors are left out, and so are vectors that do not have the most frequent
    number of entries (of equally frequent ones the larger). Repeated rows count as often as they occur; directions without variance get an eigenvalue of zero, and
    directions with equal eigenvalues are an arbitrary basis of their space. Two passes over the table.
    """
    bounded_batches(vectors.sparkSession)
    held = vectors.where(F.col(column).isNotNull())
    length = held.groupBy(F.size(column).alias("entries")).count().where("entries > 0").orderBy(F.desc("count"), F.desc("entries")).first()
    if length is None:
        return None
    size = length["entries"]
    held = held.where(F.size(column) == size)

    def grow(steps: Iterator[np.ndarray]) -> dict | None:
        spectrum = Spectrum.empty(size)
        for x in steps:
            for start in range(0, len(x), block_rows):
                spectrum.add(x[start : start + block_rows])
        return spectrum.packed() if spectrum.n else None

    found = Spectrum.unpacked(_combined(_task_states(held, column, grow), _merge_spectra))
    basis = np.linalg.qr(found.vectors)[0]
    n, sums = found.n, found.sums
    mean, square, _ = _projected_moments(held, column, lambda x: from_mean(x, n, sums) @ basis)
    projected = square - np.outer(mean, mean)
    values, turned = np.linalg.eigh((projected + projected.T) / 2)
    return Whitening(n, sums, np.maximum(values[::-1], 0), (basis @ turned)[:, ::-1], float(np.trace(projected)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "x", components: int = 32) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    if not model.kept(components):
        return 0.0
    bounded_batches(vectors.sparkSession)
    held = vectors.where(F.size(column) == len(model.sums))
    mean, square, _ = _projected_moments(held, column, lambda x: model.project(x, components))
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "x", components: int = 32) -> DataFrame:
    """``vectors`` plus ``whitened`` (array of doubles, up to ``components``) and ``deviation`` (exact long).

    ``deviation`` is the sum of ``(n * x - sums)^2``, NULL beyond a long. Null vectors, those of
    another length than the model's, and all of them without a model, get NULL in both. Other columns stay; ``whitened`` and ``deviation`` must not exist yet.
    """
    clash = {"whitened", "deviation"} & set(vectors.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    none = vectors.select("*", F.expr("CAST(NULL AS array<double>)").alias("whitened"), F.expr("CAST(NULL AS BIGINT)").alias("deviation"))
    if model is None:
        return none
    bounded_batches(vectors.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, column):
                white = model.project(x, components)
                borders = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
                lists = pa.ListArray.from_arrays(borders, pa.array(white.ravel()))
                named = [*part.schema.names, "whitened", "deviation"]
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(deviations(x, model.n, model.sums), pa.int64())], named)

    fits = F.coalesce(F.size(column) == len(model.sums), F.lit(False))
    return vectors.where(fits).mapInArrow(apply, none.schema).unionByName(none.where(~fits))
