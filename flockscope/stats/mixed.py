"""Gaussian random-intercept model, REML or ML.

With theta = sigma_b^2 / sigma^2, V_g^{-1} = I - c_g 1 1' with
c_g = theta / (1 + n_g theta). So one pass for X'X, X'y, y'y plus one grouped
pass for (n_g, sum_g x, sum_g y) is all the data the likelihood needs. The group
sums stay in Spark: theta is profiled on a grid that is refined around its best
point, and one pass over the group sums gives the criterion of a whole grid.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .design import Design
from .glm import _norm_quantile, find_aliased
from .gram import Gram, _unpack, dot, partition_sums, quad_form_sqrt, stack, tri_upper, vector_sums

#: Range of log(theta), grid points of a pass, and the step at which the search ends.
LOG_THETA = (-18.0, 8.0)
GRID, FINE = 33, 1e-6


@dataclass
class MixedFit:
    design: Design
    names: list[str]
    keep: list[int]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    theta: float
    loglik: float
    reml: bool
    n_obs: float
    n_groups: int
    group: str
    y: Column | None = None
    #: One row per group: the group, its predicted intercept ``blup`` and its rows ``n``.
    blup: DataFrame | None = None

    @property
    def kept_names(self) -> list[str]:
        return [self.names[i] for i in self.keep]

    @property
    def sigma_b2(self) -> float:
        return self.theta * self.sigma2

    @property
    def n_params(self) -> int:
        return len(self.keep) + 2

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_params

    @property
    def bic(self) -> float:
        return -2 * self.loglik + math.log(self.n_obs) * self.n_params

    def x(self, overrides: Mapping[str, Column] | None = None) -> Column:
        return self.design.array(overrides, self.keep)


def _group_terms(thetas: Sequence[float], n: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What groups of ``n`` rows with sums ``s`` of x and ``t`` of y take from the totals, one row per theta.

    Columns: triangle of sum c s s', sum c t s, sum c t^2, sum log(1 + n theta).
    """
    out = []
    for theta in thetas:
        c = theta / (1.0 + n * theta)
        cs = s * c[:, None]
        out.append(np.concatenate([tri_upper(cs.T @ s), cs.T @ t, [float(c @ (t * t)), float(np.log1p(n * theta).sum())]]))
    return np.array(out)


def _criterion(terms: np.ndarray, gram: Gram, reml: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """-2 log-likelihood, coefficients, X'V^-1 X and residual variance for the group terms of one theta."""
    n, p = gram.n, gram.xtwx.shape[0]
    m = p * (p + 1) // 2
    taken = np.zeros((p, p))
    taken[np.triu_indices(p)] = terms[:m]
    a = gram.xtwx - (taken + np.triu(taken, 1).T)
    b = gram.xtwz - terms[m:m + p]
    beta = np.linalg.solve(a, b)
    denom = n - p if reml else n
    sigma2 = (gram.ztwz - terms[m + p] - b @ beta) / denom
    m2 = denom * math.log(2 * math.pi * sigma2) + terms[m + p + 1] + denom
    if reml:
        m2 += np.linalg.slogdet(a)[1]
    return m2, beta, a, sigma2


def _profile(theta: float, gram: Gram, groups: Sequence[tuple], reml: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The criterion for group sums ``(n, s, t)`` at hand."""
    n, s, t = (np.array(v, dtype=np.float64) for v in zip(*groups, strict=True))
    return _criterion(_group_terms([theta], n, s, t)[0], gram, reml)


def mixed_fit(df: DataFrame, design: Design, y: Column | str, group: str, reml: bool = True) -> MixedFit:
    """Random-intercept linear mixed model (lme4 ``(1 | group)``)."""
    names, cols = design.build()
    p_all = len(cols)
    ycol = F.col(y) if isinstance(y, str) else y
    # the design is projected and cached before the NA filter, so the filter
    # reads the materialised array instead of re-deriving every column
    projected = df.select(F.array(*cols).alias("__x"), ycol.cast("double").alias("__y"),
                          F.col(group).alias("__g")).persist()
    frame = projected.where(F.col("__y").isNotNull() & ~F.isnan("__y")
                            & F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v)))
    def totals(pdf: pd.DataFrame) -> np.ndarray:
        xm = stack(pdf["__x"])
        yv = pdf["__y"].to_numpy(np.float64)
        return np.concatenate([tri_upper(xm.T @ xm), xm.T @ yv, [yv @ yv, float(len(yv)), float(len(yv))]])

    full = _unpack(partition_sums(frame.select("__x", "__y"), totals, p_all * (p_all + 1) // 2 + p_all + 3), p_all)
    keep = find_aliased(full.xtwx)
    full.xtwx = full.xtwx[np.ix_(keep, keep)]
    full.xtwz = full.xtwz[keep]
    k = len(keep)

    kept = F.concat(F.array(*[F.col("__x")[i] for i in keep]), F.array(F.col("__y"), F.lit(1.0)))
    groups = cut_lineage(vector_sums(frame, "__g", kept))
    projected.unpersist()
    n_groups = groups.count()

    def criteria(thetas: Sequence[float]) -> list[tuple]:
        def fn(pdf: pd.DataFrame) -> np.ndarray:
            v = stack(pdf["s"])
            return _group_terms(thetas, v[:, k + 1], v[:, :k], v[:, k]).ravel()
        size = k * (k + 1) // 2 + k + 2
        found = partition_sums(groups.select("s"), fn, size * len(thetas)).reshape(len(thetas), size)
        return [_criterion(row, full, reml) for row in found]

    (lo, hi), best = LOG_THETA, None
    while True:
        grid = np.linspace(lo, hi, GRID)
        thetas = [0.0, *np.exp(grid)] if best is None else list(np.exp(grid))
        found = criteria(thetas)
        if best is None:
            zero, found = found[0], found[1:]
        at = min(range(GRID), key=lambda i: found[i][0])
        best, theta = found[at], math.exp(grid[at])
        if grid[1] - grid[0] < FINE:
            break
        lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, GRID - 1)]
    if zero[0] <= best[0]:  # the boundary theta = 0
        theta, best = 0.0, zero
    m2, beta, a, sigma2 = best
    s, n_g = F.col("s"), F.col("s")[k + 1]
    blup = groups.select(F.col("__g").alias(group), (F.lit(theta) / (1.0 + n_g * F.lit(theta)) * (
        s[k] - dot(F.slice("s", 1, k), beta))).alias("blup"), n_g.cast("long").alias("n"))
    return MixedFit(design, names, keep, beta, sigma2 * np.linalg.inv(a), sigma2, theta, -m2 / 2, reml,
                    full.n, n_groups, group, ycol, blup)


def mixed_predict(spark: SparkSession, fit: MixedFit, df: DataFrame, population: bool = True,
                  level: float = 0.95) -> DataFrame:
    """Predictions with the fixed part only (``re.form = NA``) plus SE / CI, or BLUP-fitted values."""
    base = df.select("*", fit.x().alias("__x"))
    est = dot(F.col("__x"), fit.beta)
    if not population:
        own = fit.blup.select(F.col(fit.group).alias("__group"), F.col("blup").alias("__b"))
        return (base.join(own, F.col(fit.group).eqNullSafe(F.col("__group")), "left")
                .withColumn("estimate", est + F.coalesce(F.col("__b"), F.lit(0.0))).drop("__b", "__x", "__group"))
    zq = _norm_quantile(0.5 + level / 2)
    return (base.withColumn("estimate", est).withColumn("std_error", quad_form_sqrt(F.col("__x"), fit.cov))
            .withColumn("conf_low", F.col("estimate") - F.lit(zq) * F.col("std_error"))
            .withColumn("conf_high", F.col("estimate") + F.lit(zq) * F.col("std_error")).drop("__x"))


def prediction_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every combination of the observed levels of ``cols``.

    The level sets are gathered in one aggregate row and expanded by chained
    ``explode`` (factor levels are few), so no join is involved.
    """
    sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])
    for c in cols:
        sets = sets.withColumn(c, F.explode(c))
    return sets
