"""Weighted logistic regression by IRLS on Spark.

Every IRLS step is one aggregation over the model frame (``gram``); the
deviance at the current coefficients rides along in the same pass. Only the
p x p system is solved on the driver. Aliased design columns (all-zero cells
of an interaction, exact collinearity) are found in column order on the
first cross-product and dropped, as R reports them as NA.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.agreement import log_factorial
from .design import Design
from .gram import _unpack, dot, partition_sums, quad_form_sqrt, stack, tri_upper, vector_sums

ALIAS_TOL = 1e-9


@dataclass
class GLMFit:
    design: Design
    names: list[str]
    keep: list[int]
    beta: np.ndarray
    cov_unscaled: np.ndarray
    deviance: float
    loglik: float
    n_obs: float
    iterations: int
    converged: bool
    y: str = ""
    weight: str | None = None
    fe: Sequence[str] = ()
    rmse: float = float("nan")
    extra: dict = field(default_factory=dict)

    @property
    def kept_names(self) -> list[str]:
        return [self.names[i] for i in self.keep]

    @property
    def n_params(self) -> int:
        return len(self.keep)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_params

    @property
    def bic(self) -> float:
        return -2 * self.loglik + math.log(self.n_obs) * self.n_params

    def x(self, overrides: Mapping[str, Column] | None = None) -> Column:
        return self.design.array(overrides, self.keep)

    def eta(self, overrides: Mapping[str, Column] | None = None) -> Column:
        return dot(self.x(overrides), self.beta)

    def mu(self, overrides: Mapping[str, Column] | None = None) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.eta(overrides)))

    def coef(self) -> dict[str, float]:
        return dict(zip(self.kept_names, self.beta.tolist()))


def find_aliased(a: np.ndarray, tol: float = ALIAS_TOL) -> list[int]:
    """Indices kept after sequential (column-order) collinearity screening of X'WX."""
    if not np.isfinite(a).all():
        raise np.linalg.LinAlgError("cross-product is not finite")
    keep: list[int] = []
    for j in range(a.shape[0]):
        ajj = a[j, j]
        if ajj <= 0:
            continue
        if keep:
            ak = a[np.ix_(keep, keep)]
            aj = a[keep, j]
            resid = ajj - aj @ np.linalg.solve(ak, aj)
        else:
            resid = ajj
        if resid > tol * ajj:
            keep.append(j)
    return keep


def clamp(mu: np.ndarray) -> np.ndarray:
    """Keep fitted proportions off 0 and 1 (as R does), so weights stay positive under separation."""
    return np.clip(mu, np.finfo(float).eps, 1.0 - np.finfo(float).eps)


def complete(x: str) -> Column:
    """Rows whose design array has no NULL or NaN: the NA rule of fits, errors and predictions alike."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))


def _irls_size(p: int) -> int:
    return p * (p + 1) // 2 + p + 3


def _irls_partial(beta: np.ndarray | None, offset: float):
    """Per-batch IRLS pieces: [tri(X'WX), X'Wz, deviance, sum w, n] (numpy inside the task)."""
    def fn(pdf: pd.DataFrame) -> np.ndarray:
        x = stack(pdf["__x"])
        y = pdf["__y"].to_numpy(np.float64)
        w = pdf["__w"].to_numpy(np.float64)
        if beta is None:  # R's start: mu = (w y + 0.5) / (w + 1)
            mu = (w * y + 0.5) / (w + 1.0)
            eta = np.log(mu / (1.0 - mu))
        else:
            eta = x @ beta + offset
            mu = clamp(1.0 / (1.0 + np.exp(-eta)))
        var = mu * (1.0 - mu)
        wt = w * var
        z = eta - offset + (y - mu) / var
        with np.errstate(divide="ignore", invalid="ignore"):
            t1 = np.where(y > 0, y * np.log(y / mu), 0.0)
            t2 = np.where(y < 1, (1.0 - y) * np.log((1.0 - y) / (1.0 - mu)), 0.0)
        dev = float(np.sum(2.0 * w * (t1 + t2)))
        xw = x * wt[:, None]
        return np.concatenate([tri_upper(x.T @ xw), xw.T @ z, [dev, w.sum(), float(len(w))]])
    return fn


def binomial_fit(df: DataFrame, design: Design, y: str, weight: str | None = None,
                 max_iter: int = 25, tol: float = 1e-8, offset: float | None = None) -> GLMFit:
    """Logistic GLM with a fractional response and prior weights (R ``glm`` binomial).

    ``y`` is the proportion; ``weight`` the number of trials (e.g. tweets).
    Rows with a NULL response, weight or design value are dropped (NA action).
    """
    names, cols = design.build()
    p = len(cols)
    w_all = F.col(weight).cast("double") if weight else F.lit(1.0)
    projected = df.select(F.array(*cols).alias("__x"), F.col(y).cast("double").alias("__y"),
                          w_all.alias("__w")).persist()
    # filter on the cached array (no re-derivation of the design per element)
    frame = projected.where(F.col("__y").isNotNull() & F.col("__w").isNotNull() & (F.col("__w") > 0)
                            & complete("__x"))
    x, yy, w = F.col("__x"), F.col("__y"), F.col("__w")
    off = F.lit(float(offset)) if offset is not None else F.lit(0.0)
    off_value = float(offset) if offset is not None else 0.0
    keep: list[int] | None = None
    beta = None
    dev_old = math.inf
    converged = False
    it = 0
    cov = np.zeros((0, 0))
    for it in range(1, max_iter + 1):
        pk = p if keep is None else len(keep)
        vec = partition_sums(frame, _irls_partial(None if beta is None else beta, off_value), _irls_size(pk))
        g = _unpack(vec, pk)
        dev = g.ztwz  # deviance slot
        if keep is None:
            keep = find_aliased(g.xtwx)
            a = g.xtwx[np.ix_(keep, keep)]
            b = g.xtwz[keep]
            if len(keep) < p:  # re-materialise the frame with the kept columns only
                frame = frame.select(F.array(*[x[i] for i in keep]).alias("__x"), yy, w).persist()
        else:
            a, b = g.xtwx, g.xtwz
            if abs(dev - dev_old) / (abs(dev) + 0.1) < tol:
                converged = True
                cov = np.linalg.inv(a)
                break
        dev_old = dev
        beta = np.linalg.solve(a, b)
        cov = np.linalg.inv(a)
    if not converged:
        warnings.warn(f"binomial fit of {y!r} did not converge in {max_iter} iterations", RuntimeWarning, stacklevel=2)
    n_obs = g.n
    fit = GLMFit(design, names, keep, beta, cov, dev_old if not converged else dev, 0.0, n_obs, it, converged,
                 y, weight)
    fit.loglik, fit.rmse = _binomial_loglik(frame, fit.beta, off_value)
    frame.unpersist()
    projected.unpersist()
    return fit


def _binomial_loglik(frame: DataFrame, beta: np.ndarray, off: float) -> tuple[float, float]:
    """R's binomial log-likelihood, sum dbinom(round(w y), round(w), mu, log = TRUE), and the RMSE of the response, in one pass."""
    def fn(pdf: pd.DataFrame) -> np.ndarray:
        x = stack(pdf["__x"])
        w = pdf["__w"].to_numpy(np.float64)
        y = pdf["__y"].to_numpy(np.float64)
        mu = clamp(1.0 / (1.0 + np.exp(-(x @ beta + off))))
        m = np.round(w)
        k = np.round(w * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = (log_factorial(m) - log_factorial(k) - log_factorial(m - k)
                  + np.where(k > 0, k * np.log(mu), 0.0) + np.where(m - k > 0, (m - k) * np.log(1.0 - mu), 0.0))
        return np.array([ll.sum(), ((y - mu) ** 2).sum(), float(len(y))])

    ll, squares, n = partition_sums(frame, fn, 3)
    return float(ll), math.sqrt(squares / n) if n else float("nan")


# ---------------------------------------------------------------- vcov / tables
def cluster_vcov(fit: GLMFit, df: DataFrame, cluster: str, adjust: str = "G") -> np.ndarray:
    """Sandwich covariance clustered by ``cluster``.

    Row scores w (y - mu) x are summed per cluster in Spark; the meat
    sum_g u_g u_g' is one more cross-product aggregation over those sums.
    ``adjust``: "G" multiplies by G/(G-1); "HC1" also by (n-1)/(n-k); "none".
    """
    w = F.col(fit.weight).cast("double") if fit.weight else F.lit(1.0)
    ok = df.where(F.col(fit.y).isNotNull() & w.isNotNull() & (w > 0))
    rows = ok.select(F.col(cluster), fit.x().alias("__x"), w.alias("__w"), F.col(fit.y).cast("double").alias("__y")).where(complete("__x"))
    rows = rows.select(cluster, "__x", (F.col("__w") * (F.col("__y") - F.lit(1.0) / (F.lit(1.0) + F.exp(
        -dot(F.col("__x"), fit.beta))))).alias("__r"))
    score = F.transform("__x", lambda v: v * F.col("__r"))
    sums = vector_sums(rows, cluster, score)
    k = len(fit.keep)

    def outer(pdf: pd.DataFrame) -> np.ndarray:
        u = stack(pdf["s"])
        return np.concatenate([tri_upper(u.T @ u), [float(len(u))]])

    vec = partition_sums(sums.select("s"), outer, k * (k + 1) // 2 + 1)
    meat = np.zeros((k, k))
    meat[np.triu_indices(k)] = vec[:-1]
    meat = meat + np.triu(meat, 1).T
    meat_vec = {"G": vec[-1]}
    n_g = float(meat_vec["G"])
    bread = fit.cov_unscaled
    v = bread @ meat @ bread
    if adjust in ("G", "HC1"):
        v = v * n_g / (n_g - 1)
    if adjust == "HC1":
        v = v * (fit.n_obs - 1) / (fit.n_obs - k)
    return v


def _norm_sf(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def coef_table(spark: SparkSession, fit: GLMFit, vcov: np.ndarray | None = None, level: float = 0.95,
               stars: Sequence[tuple[str, float]] = (("**", 0.001), ("*", 0.05))) -> DataFrame:
    """Term, estimate, std_error, statistic, p_value, conf_low, conf_high, stars."""
    v = fit.cov_unscaled if vcov is None else vcov
    zq = _norm_quantile(0.5 + level / 2)
    rows = []
    for name, b, s2 in zip(fit.kept_names, fit.beta, np.diag(v)):
        se = math.sqrt(max(float(s2), 0.0))
        z = float(b) / se if se > 0 else float("nan")
        pv = _norm_sf(z) if se > 0 else float("nan")
        star = next((lab for lab, cut in stars if pv < cut), "")
        rows.append((name, float(b), se, z, pv, float(b) - zq * se, float(b) + zq * se, star))
    schema = ("term string, estimate double, std_error double, statistic double, p_value double, "
              "conf_low double, conf_high double, stars string")
    return spark.createDataFrame(rows, schema)


def _norm_quantile(p: float) -> float:
    """Inverse standard normal CDF."""
    return NormalDist().inv_cdf(p)


# ---------------------------------------------------------------- predictions
def avg_predictions(fit: GLMFit, df: DataFrame, var: str, values: Sequence[float] | Column,
                    by: Sequence[str] = (), vcov: np.ndarray | None = None, weight: str | None = None,
                    level: float = 0.95) -> DataFrame:
    """Counterfactual average predictions.

    Every row is evaluated at every grid value of ``var`` (the grid is a small
    literal array exploded per row), predictions are averaged per (value, by)
    and a delta-method interval uses the mean gradient mu (1 - mu) x per cell.
    ``values`` may also be an array column computed per row (e.g. a broadcast grid).
    """
    grid = values if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])
    rows = df.select("*", F.explode(grid).alias("__value"))
    over = {var: F.col("__value")}
    wcol = F.col(weight).cast("double") if weight else F.lit(1.0)
    keys = ["__value", *by]
    rows = rows.select(*keys, fit.x(over).alias("__x"), wcol.alias("__w")).where(complete("__x") & F.col("__w").isNotNull())
    rows = rows.select(*keys, "__x", "__w", (F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(F.col("__x"), fit.beta))))
                       .alias("__mu"))
    mu = F.col("__mu")
    grad = F.transform("__x", lambda v: v * mu * (F.lit(1.0) - mu) * F.col("__w"))
    cells = (rows.select(*keys, (mu * F.col("__w")).alias("__mu"), "__w", array_to_vector(grad).alias("__g"))
             .groupBy(*keys)
             .agg(F.sum("__mu").alias("__smu"), F.sum("__w").alias("__sw"),
                  vector_to_array(Summarizer.sum(F.col("__g"))).alias("__sg")))
    cells = cells.select(F.col("__value").alias("value"), *by, (F.col("__smu") / F.col("__sw")).alias("estimate"),
                         F.transform("__sg", lambda v: v / F.col("__sw")).alias("__grad"))
    v = fit.cov_unscaled if vcov is None else vcov
    zq = _norm_quantile(0.5 + level / 2)
    return (cells.withColumn("std_error", quad_form_sqrt(F.col("__grad"), v))
            .withColumn("conf_low", F.col("estimate") - F.lit(zq) * F.col("std_error"))
            .withColumn("conf_high", F.col("estimate") + F.lit(zq) * F.col("std_error"))
            .drop("__grad"))
