"""Operator 11 - embedding whitening from an exact bit-sliced scatter.

Entries become integers ``x = floor(scale * c) + shift``. Of a block of rows
every dimension's integers, shifted to start at 0 in the block, are written as
bit planes: plane ``a`` of a dimension holds bit ``a`` of all rows, 64 rows to a
word. The sum over rows of ``x_i * x_j`` is then the sum of ``2^(a+b)`` times the
bit count of ``plane a of i AND plane b of j``, in whole numbers throughout. Spark
adds the blocks' sums as decimals. The covariance is centred as integers,
``(n * sum(x_i x_j) - S_i S_j) / n^2``, and only then becomes a float for ``eigh``.

Only sums of the size of the dimension squared reach the driver. Rows are read
three times (dimension and sums, check of the whitened covariance, result) and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that share a block of bit planes.
BLOCK = 8192
#: Scaled entries at or above this have no long and count as non-finite.
LIMIT = float(1 << 62)


def integers(column: pa.Array, dims: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """``(kept rows, x)``: rows whose vector has ``dims`` finite entries, and their integers ``(rows, dims)``."""
    n = len(column)
    size = np.asarray(column.value_lengths().fill_null(-1))
    ok = size == dims
    if not ok.any() or not dims:
        return np.empty(0, np.int64), np.empty((0, dims), np.int64)
    flat = column.filter(pa.array(ok)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null entries become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * scale)
        good = (np.abs(scaled) < LIMIT).all(axis=1)
    return np.arange(n)[ok][good], scaled[good].astype(np.int64) + shift


def scatter(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact ``(sum of x, sums of x_i * x_j for i <= j)`` of a block as Python integers, by AND and bit count."""
    n, d = x.shape
    base = x.min(axis=0)
    y = (x - base).astype(np.uint64)
    bits = max(int(y.max()).bit_length(), 1)
    words = -(-n // 64)
    planes = np.zeros((d, bits, words), dtype=np.uint64)
    for a in range(bits):
        packed = np.packbits((y >> np.uint64(a) & np.uint64(1)).astype(bool), axis=0, bitorder="little")
        planes[:, a].view(np.uint8)[:, :packed.shape[0]] = packed.T
    weight = [1 << a for a in range(bits)]
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    small = 2 * bits + n.bit_length() < 63  # else weighted counts may leave 64 bits
    kind = np.int64 if small else object
    scale = np.array(weight, dtype=kind)
    sums = ones.astype(kind) @ scale
    cross = np.zeros((d, d), dtype=object)
    for i in range(d):
        row = 0
        for a in range(bits):
            count = np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64)
            row = row + (count.astype(kind) @ scale) * weight[a]
        cross[i, i:] = row
    s, b = [int(v) for v in sums], [int(v) for v in base]
    for i in range(d):  # back from y to x
        for j in range(i, d):
            cross[i, j] = int(cross[i, j]) + b[j] * s[i] + b[i] * s[j] + n * b[i] * b[j]
    return [v + n * w for v, w in zip(s, b, strict=True)], cross


def _block_sums(dims: int, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, [0] * dims, np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, x = integers(batch.column(0).slice(at, BLOCK), dims, scale, shift)
                if len(x):
                    s, c = scatter(x)
                    n, first, second = n + len(x), [p + q for p, q in zip(first, s, strict=True)], second + c
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *first, *second[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-2, *[-1] * dims, *i], pa.int32()), pa.array([-1, *range(dims), *j], pa.int32()),
                 pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])
    return run


class Whitening:
    """Fitted transform: row count, sums, and the leading components."""

    def __init__(self, n: int, sums: list[int], cross: dict[tuple[int, int], int], top: int):
        d = len(sums)
        self.n, self.sums = n, sums
        cov = np.empty((d, d))
        for (i, j), v in cross.items():
            cov[i, j] = cov[j, i] = float(Fraction(n * v - sums[i] * sums[j], n * n))
        value, vector = np.linalg.eigh(cov)
        order = np.argsort(-value, kind="stable")[:top]
        self.trace, self.values, self.vectors = float(np.trace(cov)), value[order], vector[:, order]
        #: Components with no variance beyond rounding cannot be whitened.
        self.open = self.values > max(self.trace, 0) * d * np.finfo(float).eps * 4
        self.explained = [float(e) / self.trace if self.trace > 0 else None for e in self.values]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S`` of every row, exactly: 64-bit where they fit, else Python integers; and whether they fit."""
        high = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) * 2
        kind = np.int64 if high * high * max(len(self.sums), 1) < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind), kind

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """Rows on the open components with unit variance; NaN on the others."""
        z = (centred / self.n).astype(np.float64) @ self.vectors
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.open, z / np.sqrt(self.values), np.nan)


def _products(fit, dims: int, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fit.value
        k = len(w.values)
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, x = integers(batch.column(0).slice(at, BLOCK), dims, scale, shift)
                z = w.whiten(w.centred(x)[0])
                total, first = total + z.T @ z, first + z.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*[-1] * k, *i], pa.int32()), pa.array([*range(k), *j], pa.int32()), pa.array([*first, *total[i, j]], pa.float64())],
            ["i", "j", "v"])
    return run


def _rows(fit, dims: int, scale: int, shift: int, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fit.value
        k = len(w.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                row, x = integers(b.column(0), dims, scale, shift)
                if not len(row):
                    continue
                centred, kind = w.centred(x)
                deviation = (centred * centred).sum(axis=1)
                if kind is object:
                    deviation = [Decimal(v) if v < 10 ** 38 else None for v in deviation.tolist()]
                z = w.whiten(centred)
                m = len(row)
                take = pa.array(np.repeat(row, k))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in b.columns[1:]], pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.n)), pa.array(deviation).cast(pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(z.ravel(), from_pandas=True), pa.array(w.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    [*b.schema.names[1:], "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def fit(vectors: DataFrame, dims: int, top: int, scale: int, shift: int) -> Whitening | None:
    """The transform of a one-column frame of vectors, or None without any row to fit."""
    sums = (vectors.mapInArrow(_block_sums(dims, scale, shift), "i int, j int, v decimal(38,0)")
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    if not sums:
        return None
    found = {(r.i, r.j): int(r.v) for r in sums}
    return Whitening(found[-2, -1], [found[-1, j] for j in range(dims)], {k: v for k, v in found.items() if k[0] >= 0}, top)


def whiten(rows: DataFrame, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",), top: int = 8,
           scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``keep`` columns with ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    One row for each remaining row and component up to ``top`` (or the dimension).
    Components are the unit eigenvectors of the covariance of the integers
    (divisor n), numbered by falling eigenvalue ``e``; equal eigenvalues in the
    solver's order, the same for all rows. ``deviation`` is the exact sum over
    dimensions of ``(n * x - S)^2``, as decimal (null from 10^38). ``explained`` is e
    over the trace. ``identity_error``: largest absolute entry of the covariance
    of ``whitened``, summed over all rows, minus the identity.

    Dropped: null vectors, vectors with null or non-finite entries or entries
    whose integer has no long, and vectors of another length than the most
    common one (the longer of equally common ones). Repeated rows count each
    and are returned each; null ids are ids like others. A component without
    variance (all vectors equal, fewer vectors than dimensions) has null
    ``whitened`` and does not count for ``identity_error``, which is null if no
    component has any; ``explained`` is null where the trace is 0. No remaining
    row: empty result. Kept columns named like a result column come first and
    may clash; others are not read. Texts play no part.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(f"`{vector_col}`").alias("__vector"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]], "component int, n long",
                        "deviation decimal(38,0), whitened double, explained double, identity_error double"])
    empty = spark.createDataFrame([], schema)
    vectors = slim.select("__vector")
    odd = F.exists("__vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale >= LIMIT))
    lengths = (vectors.where(F.col("__vector").isNotNull() & ~odd).groupBy(F.size("__vector").alias("size"))
               .count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect())
    if not lengths or not lengths[0]["size"]:
        return empty
    dims = lengths[0]["size"]
    found = fit(vectors, dims, top, scale, shift)
    if found is None:
        return empty
    known = spark.sparkContext.broadcast(found)
    sums = {(r.i, r.j): r.v for r in vectors.mapInArrow(_products(known, dims, scale, shift), "i int, j int, v double")
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    is_open = [k for k in range(len(found.values)) if found.open[k]]
    error = max((abs(sums[i, j] / found.n - sums[-1, i] * sums[-1, j] / found.n ** 2 - (i == j))
                 for i in is_open for j in is_open if i <= j), default=None)
    return slim.mapInArrow(_rows(known, dims, scale, shift, error), schema)
