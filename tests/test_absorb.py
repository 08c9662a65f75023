"""Absorbed fixed effects against dense dummy-coded numpy fits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope.stats import models
from flockscope.stats.absorb import absorbed_binomial_fit
from flockscope.stats.design import make_design
from flockscope.stats.glm import coef_table


def crossed(spark, n=600, la=25, lb=12, seed=5):
    """Two crossed effects, one hot level in each, and rows that must go."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.3, 0, rng.integers(0, la, n))
    b = np.where(rng.random(n) < 0.3, 0, rng.integers(0, lb, n))
    x, u, w = rng.normal(size=n) + a / la, rng.normal(size=n), rng.integers(5, 40, n)
    eta = -0.5 + 0.4 * x - 0.2 * u + rng.normal(size=la)[a] * 0.5 + rng.normal(size=lb)[b] * 0.5
    y = rng.binomial(w, 1 / (1 + np.exp(-eta))) / w
    rows = [(f"a{i}", int(j), float(p), float(q), float(v), int(m))
            for i, j, p, q, v, m in zip(a, b, x, u, y, w, strict=True)]
    rows += [("zero", 1, 0.1, 0.2, 0.0, 9), ("zero", 2, 0.3, 0.1, 0.0, 9), ("a1", 999, 0.2, 0.2, 1.0, 4)]  # no variation
    rows += [(None, 1, 0.1, 0.2, 0.5, 9), ("a1", None, 0.1, 0.2, 0.5, 9), ("a1", 1, None, 0.2, 0.5, 9),
             ("a1", 1, 0.1, 0.2, None, 9), ("a1", 1, 0.1, 0.2, 0.5, None), ("a1", 1, 0.1, 0.2, 0.5, 0)]
    return spark.createDataFrame(rows, "a string, b long, x double, u double, y double, w long")


def dense(pdf):
    pdf = pdf.dropna()
    pdf = pdf[(pdf.w > 0) & (pdf.a != "zero") & (pdf.b != 999)]
    dummies = [(pdf.a.to_numpy()[:, None] == np.unique(pdf.a)[None, :]), (pdf.b.to_numpy()[:, None] == np.unique(pdf.b)[None, 1:])]
    m = np.column_stack([pdf.x, pdf.u, *dummies]).astype(float)
    y, w = pdf.y.to_numpy(float), pdf.w.to_numpy(float)
    beta = np.zeros(m.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-m @ beta))
        h = (m * (w * mu * (1 - mu))[:, None]).T @ m
        beta = beta + np.linalg.solve(h, m.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-m @ beta))
    return pdf.assign(mu=mu), beta, np.linalg.inv(h), m.shape[1]


def test_two_crossed_effects_equal_the_dummy_fit(spark):
    df = crossed(spark)
    fit = absorbed_binomial_fit(df, make_design(df, [("x",), ("u",)]), "y", "w", ["a", "b"])
    pdf, beta, cov, k = dense(df.toPandas())
    assert fit.converged and fit.n_obs == len(pdf)
    assert np.allclose(fit.beta, beta[:2], atol=1e-8) and np.allclose(fit.cov_unscaled, cov[:2, :2], rtol=1e-6)
    assert fit.n_params == k
    got = fit.fitted(df.dropna().where("w > 0")).toPandas().sort_values(["a", "b", "x"])
    want = pdf.sort_values(["a", "b", "x"])
    assert len(got) == len(want) and np.allclose(got.fitted.to_numpy(), want.mu.to_numpy(), atol=1e-7)
    assert fit.rmse == pytest.approx(float(np.sqrt(((want.y - want.mu) ** 2).mean())), rel=1e-7)
    assert coef_table(spark, fit).count() == 2


def test_absorbed_equals_the_coded_fit_and_leaves_out_what_levels_explain(spark):
    df = crossed(spark, n=200, la=4, lb=3).withColumn("same", F.length("a") + F.col("b")).withColumn("x2", F.col("x") * 2)
    df = df.dropna().withColumn("b", F.col("b").cast("string"))
    coded = models.fe_binomial_fit(df, make_design(df, [("x",), ("u",)]), "y", "w", ["a", "b"])
    fit = absorbed_binomial_fit(df, make_design(df, [("same",), ("x",), ("x2",), ("u",)]), "y", "w", ["a", "b"])
    assert fit.kept_names == ["x", "u"]
    assert fit.coef()["x"] == pytest.approx(coded.coef()["x"], rel=1e-6) and fit.coef()["u"] == pytest.approx(coded.coef()["u"], rel=1e-6)
    assert fit.deviance == pytest.approx(coded.deviance, rel=1e-8) and fit.loglik == pytest.approx(coded.loglik, rel=1e-8)
    assert fit.n_params == coded.n_params


def test_effects_alone_and_one_effect(spark):
    df = crossed(spark, n=300, la=5, lb=3)
    fit = absorbed_binomial_fit(df, make_design(df, []), "y", "w", ["a"])
    sums = (fit.fitted(df.where("y IS NOT NULL AND w > 0")).groupBy("a")
            .agg(F.sum(F.col("w") * F.col("y")).alias("seen"), F.sum(F.col("w") * F.col("fitted")).alias("fit")).collect())
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d in os.listdir(folder) if d.startswith("absorb-")]  # intermediate tables are removed
    assert len(sums) == 5 and all(r.seen == pytest.approx(r.fit, rel=1e-9) for r in sums)


def test_empty_tables_and_missing_effects_are_errors(spark):
    df = crossed(spark, n=20, la=3, lb=2)
    with pytest.raises(ValueError, match="no rows"):
        absorbed_binomial_fit(df.where("false"), make_design(df, [("x",)]), "y", "w", ["a"])
    with pytest.raises(ValueError, match="no fixed effects"):
        absorbed_binomial_fit(df, make_design(df, [("x",)]), "y", "w", [])
