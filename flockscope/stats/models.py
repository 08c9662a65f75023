"""Model families built on the IRLS fit: fixed-effect GLMs, subsets, comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .absorb import drop_separated_levels
from .design import Design, factor_levels
from .glm import GLMFit, binomial_fit, complete


def fe_binomial_fit(df: DataFrame, design: Design, y: str, weight: str | None, fe: Sequence[str],
                    fe_levels: dict | None = None) -> GLMFit:
    """Logistic GLM with fixed effects of few levels (one-hot, first level of each FE as base).

    FE coefficients are reported with treatment coding; for effects of many
    levels ``absorb.absorbed_binomial_fit`` gives the same slopes. Levels with an all-0 / all-1 outcome are
    dropped first, as the FE estimator does.
    """
    data = drop_separated_levels(df.where(F.col(y).isNotNull()), fe, y, weight)
    fe_levels = dict(fe_levels or {})
    factors = dict(design.factors)
    for f in fe:
        factors[f] = factor_levels(data, f, fe_levels.get(f))
    full = Design(factors, design.numeric, design.polys, [*[(f,) for f in fe], *design.terms], True)
    fit = binomial_fit(data, full, y, weight)
    fit.fe = tuple(fe)
    return fit


def common_rows(df: DataFrame, design: Design) -> DataFrame:
    """Rows that are complete for a design: models compared with each other need the same rows."""
    return df.withColumn("__x", design.array()).where(complete("__x")).drop("__x")


def subset_models(df: DataFrame, design: Design, optional_terms: Sequence[tuple[str, ...]], y: str,
                  weight: str | None, fe: Sequence[str] = ()) -> dict[tuple, GLMFit]:
    """One fit per subset of ``optional_terms`` (including the empty set).

    All fits use the rows that are complete for every optional term.
    """
    fits = {}
    df = common_rows(df, Design(design.factors, design.numeric, design.polys, [*design.terms, *optional_terms], design.intercept))
    for r in range(len(optional_terms) + 1):
        for subset in combinations(optional_terms, r):
            d = Design(design.factors, design.numeric, design.polys, [*design.terms, *subset], design.intercept)
            fits[subset] = fe_binomial_fit(df, d, y, weight, fe) if fe else binomial_fit(df, d, y, weight)
    return fits


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution via the regularized incomplete gamma Q(k/2, x/2)."""
    if x <= 0:
        return 1.0
    a, z = k / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1:  # series for P, then Q = 1 - P
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1
            d *= z / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - gln))
    # continued fraction for Q (modified Lentz)
    b = z + 1 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - gln) * h


def compare_models(spark: SparkSession, fits: dict[str, object], against: dict[str, str] | None = None) -> DataFrame:
    """logLik, AIC, BIC, parameters, deviance, RMSE, whether the fit converged, and a likelihood-ratio test where one is asked for.

    ``against`` names the smaller model each tested one extends. A pair that is
    not nested (a parameter of the smaller is missing from the larger, or there
    is none more) is an error; a statistic is 0 at least, up to rounding.
    """
    against = against or {}
    rows = []
    for name, f in fits.items():
        ll, k = float(f.loglik), int(f.n_params)
        lr = p = None
        if name in against:
            small = fits[against[name]]
            more = k - int(small.n_params)
            if more <= 0 or not set(small.kept_names) <= set(f.kept_names):
                raise ValueError(f"{against[name]!r} is not nested in {name!r}")
            lr = max(2 * (ll - float(small.loglik)), 0.0)
            p = chi2_sf(lr, more)
        dev = float(getattr(f, "deviance", float("nan")))
        rmse, converged = getattr(f, "rmse", None), getattr(f, "converged", None)
        rows.append((name, ll, float(f.aic), float(f.bic), k, dev, rmse, converged, against.get(name), lr, p))
    return spark.createDataFrame(rows, "model string, loglik double, aic double, bic double, n_params int, "
                                       "deviance double, rmse double, converged boolean, against string, lr_stat double, p_value double")


def fit_diagnostics(df: DataFrame, fits: dict[str, GLMFit], y: str, weight: str | None) -> DataFrame:
    """Observed proportion and each model's fitted value per row."""
    return df.select("*", *[f.mu().alias(f"pred_{n}") for n, f in fits.items()]).withColumn(
        "observed", F.col(y).cast("double"))
