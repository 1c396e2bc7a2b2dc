"""Whitening of embeddings by an exact integer scatter.

A vector c becomes the integers x = floor(64 * c) + 1,000,000, and the fit list is each distinct x once.
Its sums S and cross-products are taken of x less a fixed shift, in blocks that float64 products cannot
round, and added up as integers of any size: each partial number leaves its task as signed limbs of 32
bits, which Spark sums by place, so nothing is rounded and no number is too large. From them n * X'X - SS'
is formed exactly (the shift cancels), divided by n^2 with one rounding an entry, and decomposed by eigh.

The only things that meet in one place are the d * d entries of a vector length d. Vectors of different
lengths have fits of their own. Components are numbered by falling eigenvalue, their largest entry (the
first of those that tie) is positive, and those whose eigenvalue is zero (at most d * 2^-50 of the largest)
have no whitened value and no part in the identity error.

Vectors that are null or hold null or non-finite entries are dropped; empty ones have no components and
give no row. Entries beyond +-2^62 count as that. One distinct vector: variance, explained, whitened and
identity error are null. Repeated rows, and rows without an id, each get their own rows; equal vectors count
once in the fit. An empty table gives an empty one; other columns are not read. ``deviation`` is a
decimal(38, 0), null where that cannot hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LIMIT = float(1 << 62)
#: float64 holds integers up to this without rounding.
EXACT = 1 << 53
LIMB, BATCH_ROWS = 32, 4096


@dataclass
class Fit:
    """The whitening of one vector length."""

    n: int
    sums: list[int]  # of x less the shift
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray
    trace: float

    @property
    def sure(self) -> np.ndarray:
        """Components that have a variance."""
        least = self.eigenvalues[:1].max(initial=0) * len(self.sums) * 2.0**-50
        return self.eigenvalues > least


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the integer vectors of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), F.lit(LIMIT)), F.lit(-LIMIT)))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))).select("id", F.transform("vector", lambda c: whole(c) + F.lit(OFFSET)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], more: str | None = None) -> Iterator[tuple]:
    """The vectors of a batch by length, less the shift, with another column's values."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            column = part.column("x")
            offsets = column.offsets.to_numpy()
            flat, first, size = column.values.to_numpy(), offsets[:-1], np.diff(offsets)
            for width in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == width)
                yield flat[first[rows][:, None] + np.arange(width)] - OFFSET, part.column(more).take(pa.array(rows)) if more else None


def gram(y: np.ndarray) -> np.ndarray:
    """Y'Y of int64 rows as Python integers, without rounding."""
    most = int(max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))))
    if most * most <= EXACT // 64:
        step = max(1, EXACT // max(most * most, 1))
        total = np.zeros((y.shape[1],) * 2, object)
        for at in range(0, len(y), step):
            part = y[at : at + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    # wider entries as digits of 21 bits, whose products add up exactly over 512 rows
    digits, rest = [], y
    while rest.any() and not (rest == -1).all():
        digits.append((rest & 0x1FFFFF).astype(np.float64))
        rest = rest >> 21
        if len(digits) == 4:
            break
    digits.append(rest.astype(np.float64))  # 0 or -1: the sign
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            for at in range(0, len(y), 512):
                total += (a[at : at + 512].T @ b[at : at + 512]).astype(np.int64).astype(object) * (1 << 21 * (i + j))
    return total


def _limbs(value: int) -> list[int]:
    """Signed limbs, lowest first."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


#: Row -1 of the cross-products holds the sums, and its column -1 the count.
_PARTIAL = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for y, _ in _matrices(batches):
        own = held.setdefault(y.shape[1], [0, np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)])
        own[0] += len(y)
        own[1] = own[1] + y.astype(object).sum(axis=0)
        own[2] = own[2] + gram(y)
    for width, (n, sums, cross) in held.items():
        entries = [(-1, -1, n)] + [(-1, j, s) for j, s in enumerate(sums.tolist())] + [(i, j, cross[i, j]) for i in range(width) for j in range(i, width)]
        rows = [(width, i, j, k, limb) for i, j, value in entries for k, limb in enumerate(_limbs(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)


def scatter(x: DataFrame) -> dict[int, tuple[int, list[int], dict[tuple[int, int], int]]]:
    """By vector length: the count, the sums and the upper cross-products of x less the shift, exactly."""
    parts = x.select("x").mapInArrow(_partials, "width int, i int, j int, limb int, value long")
    found: dict[int, dict[tuple[int, int], int]] = {}
    sums = parts.groupBy("width", "i", "j", "limb").agg(F.sum("value").alias("value")).toArrow()
    for width, i, j, limb, value in zip(*(c.to_pylist() for c in sums.columns), strict=True):
        own = found.setdefault(width, {})
        own[i, j] = own.get((i, j), 0) + (value << LIMB * limb)
    return {w: (own[-1, -1], [own.get((-1, j), 0) for j in range(w)], own) for w, own in found.items()}


def decompose(n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Fit:
    """The leading eigenvectors of (n * X'X - SS') / n^2, whose entries are rounded once."""
    d = len(sums)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * cross.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    rows = vectors.T[order]
    rows = rows * np.where(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)] < 0, -1.0, 1.0)[:, None]
    return Fit(n, sums, rows, np.maximum(values[order], 0.0), float(np.trace(cov)))


def centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off as an integer, so nothing large is rounded."""
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return (y - whole).astype(np.float64) - rest


def deviations(y: np.ndarray, fit: Fit) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2: with z = y - S // n and r = S % n it is n^2 zz - 2 n zr + rr."""
    z = y - np.array([s // fit.n for s in fit.sums], np.int64)
    r = np.array([s % fit.n for s in fit.sums], np.int64)
    most = max(1, int(max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))))
    if most * max(most, fit.n) * y.shape[1] >= 1 << 62:
        z, r = z.astype(object), r.astype(object)
    zz, zr, rr = (z * z).sum(axis=1).tolist(), (z * r).sum(axis=1).tolist(), sum(int(v) * int(v) for v in r.tolist())
    return [fit.n * fit.n * int(a) - 2 * fit.n * int(b) + rr for a, b in zip(zz, zr, strict=True)]


def project(y: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened values of the components that have a variance."""
    return (centred(y, fit) @ fit.components[fit.sure].T) / np.sqrt(fit.eigenvalues[fit.sure])


def _identity_errors(x: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """The largest entry of the covariance of the fit list's whitened values less the identity, from the values themselves."""
    schema = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def moments(batches):
        held: dict[int, list] = {}
        for y, _ in _matrices(batches):
            w = project(y, fits[y.shape[1]])
            own = held.setdefault(y.shape[1], [np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2)])
            own[0] += w.sum(axis=0)
            own[1] += w.T @ w
        for width, (first, second) in held.items():
            rows = [(width, -1, j, v) for j, v in enumerate(first.tolist())] + [(width, i, j, second[i, j]) for i in range(len(first)) for j in range(len(first))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    sums: dict[int, dict] = {}
    for r in x.select("x").mapInArrow(moments, "width int, i int, j int, value double").groupBy("width", "i", "j").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(r.width, {})[r.i, r.j] = r.value
    out: dict[int, float | None] = {w: None for w in fits}
    for width, own in sums.items():
        n, k = fits[width].n, int(fits[width].sure.sum())
        mean = np.array([own[-1, j] / n for j in range(k)])
        cov = np.array([[own[i, j] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        out[width] = float(np.abs(cov - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, eigenvalue, explained, identity_error): a row for each row and component."""
    rows = quantised(vectors, id_col, vector_col)
    fit_list = written(rows.select("x").distinct(), "whitening-fit-list")
    fits = {w: decompose(*held, components) for w, held in scatter(fit_list).items()}
    errors = _identity_errors(fit_list, fits)
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("eigenvalue", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def shown(batches):
        for y, ids in _matrices(batches, "id"):
            fit = fits[y.shape[1]]
            k, rows = len(fit.eigenvalues), len(y)
            white = np.full((rows, k), np.nan)
            white[:, fit.sure] = project(y, fit)
            each = np.repeat(np.arange(rows), k)
            deviation = pa.array([str(v) if v < 10**38 else None for v in deviations(y, fit)], pa.string()).cast(pa.decimal128(38, 0))
            explained = fit.eigenvalues / fit.trace if fit.trace > 0 else np.full(k, np.nan)
            arrays = [ids.take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, fit.n), deviation.take(pa.array(each)), white.ravel(), np.tile(fit.eigenvalues, rows), np.tile(explained, rows), pa.array([errors[y.shape[1]]] * (rows * k), pa.float64())]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type, from_pandas=True) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    out = rows.mapInArrow(shown, "id long, component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
