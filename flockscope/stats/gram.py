"""Distributed weighted cross-products.

One aggregation returns X'WX (upper triangle), X'Wz, z'Wz, sum(w) and n for a
design array column: each row turns into one flat vector of products built
with higher-order array functions (JVM side) and ``Summarizer.sum`` adds
them with map-side partial aggregation. Only p x p numbers reach the driver;
with ``by`` one set per group is returned (groups must be cluster-sized).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Gram:
    xtwx: np.ndarray
    xtwz: np.ndarray
    ztwz: float
    sw: float
    n: float


def _tri_products(x: Column, w: Column, p: int) -> Column:
    """Flattened upper triangle of w * x x' (row-major)."""
    idx = F.sequence(F.lit(0), F.lit(p - 1))
    return F.flatten(F.transform(idx, lambda i: F.transform(
        F.sequence(i, F.lit(p - 1)), lambda j: x[i] * x[j] * w)))


def gram_vector(x: Column, w: Column, z: Column, p: int) -> Column:
    """[tri(w x x'), w z x, w z^2, w, 1] as one array."""
    wz = w * z
    return F.concat(_tri_products(x, w, p), F.transform(x, lambda v: v * wz),
                    F.array(wz * z, w, F.lit(1.0)))


def _unpack(vec: np.ndarray, p: int) -> Gram:
    m = p * (p + 1) // 2
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = vec[:m]
    a = a + np.triu(a, 1).T
    return Gram(a, vec[m:m + p].copy(), float(vec[m + p]), float(vec[m + p + 1]), float(vec[m + p + 2]))


def weighted_gram(df: DataFrame, x: Column, w: Column, z: Column, p: int) -> Gram:
    """Totals over all rows."""
    v = array_to_vector(gram_vector(x, w.cast("double"), z.cast("double"), p))
    row = df.select(v.alias("g")).agg(Summarizer.sum(F.col("g")).alias("s")).first()
    return _unpack(np.asarray(row["s"].toArray()), p)


def grouped_gram(df: DataFrame, by: str, x: Column, w: Column, z: Column, p: int) -> dict:
    """One :class:`Gram` per group (use only for cluster-bounded group counts)."""
    v = array_to_vector(gram_vector(x, w.cast("double"), z.cast("double"), p))
    rows = df.select(F.col(by), v.alias("g")).groupBy(by).agg(Summarizer.sum(F.col("g")).alias("s")).collect()
    return {r[by]: _unpack(np.asarray(r["s"].toArray()), p) for r in rows}


def vector_sums(df: DataFrame, by: str | list[str], vec: Column) -> DataFrame:
    """Per-group sums of an array column (kept in Spark), as ARRAY<DOUBLE> column ``s``."""
    from pyspark.ml.functions import vector_to_array
    keys = [by] if isinstance(by, str) else list(by)
    return (df.select(*keys, array_to_vector(vec).alias("v")).groupBy(*keys)
            .agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s")))


def dot(x: Column, beta: np.ndarray) -> Column:
    """x . beta with beta as literals (JVM side)."""
    b = F.array(*[F.lit(float(v)) for v in beta])
    return F.aggregate(F.zip_with(x, b, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)


def quad_form_sqrt(x: Column, v: np.ndarray) -> Column:
    """sqrt(x' V x) per row, vectorised over an Arrow batch (V is p x p, small)."""
    vm = np.asarray(v, dtype=np.float64)

    @F.pandas_udf(T.DoubleType())
    def _qf(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype="float64")
        m = np.stack([np.asarray(a, dtype=np.float64) for a in s])
        return pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, vm, m), 0.0)))

    return _qf(x)


# ---------------------------------------------------------------- per-partition partial sums
def partition_sums(df: DataFrame, fn, size: int, by: str | None = None) -> list | dict:
    """Sum ``fn(batch) -> vector[size]`` over all Arrow batches of ``df``.

    Each task reduces its own batches with numpy and emits one vector (one per
    key with ``by``); Spark adds the vectors (``Summarizer.sum``), so only
    one small vector per task crosses the shuffle. Returns the summed vector,
    or {key: vector} with ``by`` (keys must be few, e.g. replicates, clusters).
    """
    key_type = df.schema[by].dataType.simpleString() if by else None
    schema = (f"`{by}` {key_type}, s array<double>" if by else "s array<double>")

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if by:
                for key, part in pdf.groupby(by, sort=False):
                    v = fn(part)
                    acc[key] = v if key not in acc else acc[key] + v
            else:
                v = fn(pdf)
                acc[None] = v if None not in acc else acc[None] + v
        if not acc:
            return
        if by:
            yield pd.DataFrame({by: list(acc.keys()), "s": [a.tolist() for a in acc.values()]})
        else:
            yield pd.DataFrame({"s": [acc[None].tolist()]})

    parts = df.mapInPandas(run, schema)
    vec = array_to_vector(F.col("s"))
    if by:
        rows = parts.groupBy(by).agg(Summarizer.sum(vec).alias("s")).collect()
        return {r[by]: np.asarray(r["s"].toArray()) for r in rows}
    row = parts.agg(Summarizer.sum(vec).alias("s")).first()
    if row["s"] is None:
        return np.zeros(size)
    return np.asarray(row["s"].toArray())


def stack(col: pd.Series) -> np.ndarray:
    """Arrow array column -> 2-D float matrix."""
    return np.stack([np.asarray(a, dtype=np.float64) for a in col])


def tri_upper(a: np.ndarray) -> np.ndarray:
    return a[np.triu_indices(a.shape[0])]
