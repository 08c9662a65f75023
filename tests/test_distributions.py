"""Tail probabilities against numerical integrals; trend p-values and RMSE in their operators."""

import math

import numpy as np
import pytest

from flockscope.operators import frames
from flockscope.stats import distributions, glm, models
from flockscope.stats.design import make_design


def _beta_integral(x, a, b):
    """Integral of t^(a-1) (1-t)^(b-1) over the share below x, by t = sin^2 u (no singular ends for a, b >= 1/2)."""
    node, weight = np.polynomial.legendre.leggauss(400)

    def area(to):
        u = (node + 1) / 2 * to
        return (weight * 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)).sum() * to / 2
    return area(math.asin(math.sqrt(x))) / area(math.pi / 2)


@pytest.mark.parametrize("a,b", [(0.5, 0.5), (1, 0.5), (2.5, 0.5), (11.5, 0.5), (60, 0.5), (3, 7), (400, 0.5), (25, 30)])
def test_incomplete_beta(a, b):
    for x in (1e-6, 0.01, 0.2, 0.5, 0.77, 0.95, 0.9999):
        assert float(distributions.incomplete_beta(x, a, b)) == pytest.approx(_beta_integral(x, a, b), rel=1e-9, abs=1e-13)
    assert distributions.incomplete_beta(np.array([0.0, 1.0]), a, b).tolist() == [0.0, 1.0]


def test_log_gamma():
    for x in (0.5, 1, 2, 3.7, 9.99, 10, 171.3, 1e6):
        assert float(distributions.log_gamma(x)) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)


def test_trend_p_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=23)
    y = 0.3 * x + rng.normal(size=23)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y, strict=True)]
    rows += [("exact", float(p), 2.0 * p) for p in range(5)] + [("two", 1.0, 1.0), ("two", 2.0, 5.0), ("null", None, 1.0)]
    got = {r.g: r for r in frames.linear_trend(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", ["g"]).collect()}
    r, n = np.corrcoef(x, y)[0, 1], len(x)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    # two-sided tail of Student's t from its own density
    node, weight = np.polynomial.legendre.leggauss(400)
    u = (node + 1) / 2 * math.atan(abs(t) / math.sqrt(n - 2))
    inside = (weight * np.cos(u) ** (n - 3)).sum() * math.atan(abs(t) / math.sqrt(n - 2)) / 2
    v = (node + 1) / 2 * math.pi / 2
    assert got["a"].p_value == pytest.approx(1 - inside / ((weight * np.cos(v) ** (n - 3)).sum() * math.pi / 4), rel=1e-9)
    assert got["exact"].p_value is None or got["exact"].p_value < 1e-6
    assert got["two"].p_value is None and got["null"].p_value is None


def test_compared_models_show_rmse_and_convergence(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    w = rng.integers(5, 40, 80)
    y = rng.binomial(w, 1 / (1 + np.exp(-0.5 * x))) / w
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w, strict=True)], "x double, y double, w int")
    fit = glm.binomial_fit(df, make_design(df, [("x",)]), "y", "w")
    row = models.compare_models(spark, {"m": fit}).first()
    mu = 1 / (1 + np.exp(-(fit.beta[0] + fit.beta[1] * x)))
    assert row.converged and row.rmse == pytest.approx(math.sqrt(((y - mu) ** 2).mean()), rel=1e-9)
