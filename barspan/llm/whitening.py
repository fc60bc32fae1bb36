"""Embedding whitening: exact variances of dimensions and of their sums give the covariance (polarisation), eigh the components."""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import materialize

#: Entries become 64ths, moved up by a level that leaves them positive. Fixed values.
STEPS, LEVEL = 64, 1_000_000
#: From here on doubles don't tell one 64th from the next.
_LARGEST = float(1 << 46)
#: Sums of pairs below 2^41 are squared in two halves of 20 bits and more, whose products over 2^19 rows fit in 63 bits.
_HALF = 20
_BLOCK_NUMBERS = 1 << 19
_PARTIAL = "i int, j int, squares decimal(38,0)"


def lattice(vector: Column) -> Column:
    """The vector as long integers; null where it is null, empty or has an entry that is null, not finite or 2^46 or more."""
    usable = (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(F.lit(float(STEPS)) * c.cast("double")) + LEVEL))


def _blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of the batches, a few megabytes at a time, with their vectors as a matrix."""
    for batch in batches:
        d = len(batch.column(column)[0]) if batch.num_rows else 1
        step = max(1, _BLOCK_NUMBERS // d)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension over the vectors of a partition, as (dimension, rows, sum)."""
    rows, sums = 0, None
    for _, x in _blocks(batches):
        part = [int(s) for s in (x - LEVEL).sum(axis=0, dtype=object)] if np.abs(x).max() > 1 << 40 else (x - LEVEL).sum(axis=0).tolist()
        sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        rows += len(x)
    if sums is not None:
        total = [decimal.Decimal(s + LEVEL * rows) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([rows] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["i", "rows", "total"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that is enough, else in Python's integers."""
    low, high = int(x.min()), int(x.max())
    if n * max(abs(low), abs(high)) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    d = n * x.astype(object) - np.array(sums, object)
    return d.astype(np.int64) if max(abs(int(d.min())), abs(int(d.max()))) < 1 << 62 else d


def pair_squares(d: np.ndarray) -> list[list[int]]:
    """For every i <= j the exact sum over rows of d_i squared (i = j), or of d_i + d_j squared."""
    out = []
    for i in range(d.shape[1]):
        s = d[:, i : i + 1] + d[:, i:] if i + 1 < d.shape[1] else d[:, i:] * 2
        s[:, 0] = d[:, i]
        if s.dtype == object or np.abs(s).max() >= 1 << 41:
            s = s.astype(object)
            out.append([int(v) for v in (s * s).sum(axis=0)])
            continue
        high, low = s >> _HALF, s & ((1 << _HALF) - 1)
        parts = zip(*((a * b).sum(axis=0).tolist() for a, b in ((high, high), (high, low), (low, low))), strict=True)
        out.append([(hh << 2 * _HALF) + (hl << _HALF + 1) + ll for hh, hl, ll in parts])
    return out


def _squares(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            part = pair_squares(centred(x, n, sums))
            total = part if total is None else [[a + b for a, b in zip(*rows, strict=True)] for rows in zip(total, part, strict=True)]
        if total is not None:
            at = [(i, i + k) for i, row in enumerate(total) for k in range(len(row))]
            flat = pa.array([decimal.Decimal(v) for row in total for v in row], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()), flat], names=["i", "j", "squares"])

    return run


@dataclass
class Whitening:
    """n fitted vectors with sums by dimension; unit components by falling eigenvalue, the ones without variance left out."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def apply(self, d: np.ndarray) -> np.ndarray:
        """Whitened values of centred vectors n * x - S."""
        return (d / self.n).astype(np.float64) @ self.components / np.sqrt(self.eigenvalues)


def solve(n: int, sums: list[int], squares: dict[tuple[int, int], int], largest: int = 16) -> Whitening:
    """Components from the exact sums of squares: twice a covariance is the variance of a sum less both variances."""
    d = len(sums)
    v = np.empty((d, d))
    for (i, j), q in squares.items():
        # Sums of squares of n times the centred values, hence n cubed; the quotient of integers is rounded once.
        v[i, j] = v[j, i] = q / n**3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n**3)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    trace = float(np.trace(v))
    keep = np.flatnonzero(e > d * np.finfo(float).eps * max(trace, 0.0))[:largest]
    u = u[:, keep]
    signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(keep))])
    return Whitening(n, sums, e[keep], u * signs, trace)


def fit_list(rows: DataFrame, vector: str = "x") -> DataFrame:
    """Each distinct lattice vector of the most frequent length (the shorter of equally frequent ones) once."""
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size(vector) == d).select(F.col(vector).alias("x")).distinct()


def fit_whitening(vectors: DataFrame, largest: int = 16) -> Whitening | None:
    """Fit on all rows of `vectors` (x: array of longs of one length), which is read twice; None where there are none.

    A task returns one number for each dimension, then one for each pair of dimensions; Spark sums them as decimals, and the
    driver gets d + d * (d + 1) / 2 numbers whatever the rows. Squares must stay below 10^38 in sum.
    """
    sums = vectors.mapInArrow(_numbers, "i int, rows long, total decimal(38,0)").groupBy("i").agg(F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    if not sums:
        return None
    n, s = int(sums[0]["rows"]), [int(r["total"]) for r in sorted(sums, key=lambda r: r["i"])]
    pairs = vectors.mapInArrow(_squares(n, s), _PARTIAL).groupBy("i", "j").agg(F.sum("squares").cast("decimal(38,0)").alias("squares")).collect()
    return solve(n, s, {(r["i"], r["j"]): int(r["squares"]) for r in pairs}, largest)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches):
            w = model.apply(centred(x, model.n, model.sums))
            sums += w.sum(axis=0)
            products += w.T @ w
        at = np.arange(k * k + k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([products.ravel(), sums]))], names=["at", "value"])

    found = vectors.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k * k + k)
    for r in found:
        flat[r["at"]] = r["value"]
    mean = flat[k * k :] / model.n
    return float(np.abs(flat[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def _deviations(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None where one is beyond a long."""
    largest = max(abs(int(d.min())), abs(int(d.max()))) if d.size else 0
    if largest * largest * d.shape[1] < 1 << 63:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _project(model: Whitening, error: float):
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 1):
            m = len(x)
            d = centred(x, model.n, model.sums)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            columns = {
                "vec_id": ids, "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, model.n, np.int64)),
                "deviation": pa.array(_deviations(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), "whitened": pa.array(model.apply(d).ravel()),
                "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def whiten(embeddings: DataFrame, largest: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on the `largest` leading components: one row for each vector and component.

    Vectors that are null or empty, or hold null, not finite or unrepresentable entries (2^46 or more), are left out, as are
    those of another length than most: they are in no common space. Repeated vectors are fitted once and projected each, null
    ids are carried through, other columns are ignored. Components without variance (fewer distinct vectors than dimensions,
    constant dimensions) have no whitened values and are left out; an empty table, or one distinct vector, gives no rows.
    A deviation beyond the range of a long is null. Copies fall together before the exchange of the distinct vectors; what
    the driver and each task hold beyond a batch depends on the number of dimensions alone.
    Result: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(id_col).alias("vec_id"), lattice(F.col(vector_col)).alias("x")).filter("x is not null")
    distinct = materialize(fit_list(rows), "whitening-fit")
    model = fit_whitening(distinct, largest)
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], result)
    error = identity_error(distinct, model)
    usable = rows.filter(F.size("x") == len(model.sums))
    return usable.mapInArrow(_project(model, error), result)
