"""Numeric identities for the model operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope.stats import glm, mixed, models
from flockscope.stats.design import make_design, poly2, star


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        b = rng.normal(0, 0.3)
        for i in range(20):
            a = ["x", "y", "z"][i % 3]
            pub = ["blm", "pol"][i % 2]
            age = float(rng.normal(40, 8))
            tot = int(rng.integers(5, 60))
            eta = -1 + 0.02 * (age - 40) + (0.4 if pub == "pol" else 0) + b
            p = 1 / (1 + np.exp(-eta))
            rows.append((g, a, pub, age, tot, float(rng.binomial(tot, p)) / tot))
    return spark.createDataFrame(rows, "grp int, meta string, pub string, age double, total long, v double").cache()


def test_glm_matches_numpy_irls(spark, frame):
    des = make_design(frame, star("pub", "meta") + [("age",)], factors=["pub", "meta"])
    fit = glm.binomial_fit(frame, des, "v", "total")
    pdf = frame.select(des.array().alias("x"), "v", "total").toPandas()
    X, y, w = np.array(pdf.x.tolist()), pdf.v.to_numpy(), pdf.total.to_numpy(float)
    b = np.zeros(X.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b))
        W = w * mu * (1 - mu)
        b = np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (W * (X @ b + (y - mu) / (mu * (1 - mu)))))
    assert np.max(np.abs(b - fit.beta)) < 1e-8
    assert fit.converged
    v = glm.cluster_vcov(fit, frame, "grp")
    assert v.shape == (len(b), len(b)) and np.all(np.diag(v) > 0)


def test_aliased_column_dropped(spark, frame):
    df = frame.withColumn("age2", F.col("age") * 2)
    des = make_design(df, [("age",), ("age2",)])
    fit = glm.binomial_fit(df, des, "v", "total")
    assert fit.kept_names == ["(Intercept)", "age"]


def test_poly2_orthonormal(spark, frame):
    p = poly2(frame, "age")
    cols = p.columns(F.col("age"))
    pdf = frame.select(cols[0].alias("a"), cols[1].alias("b")).toPandas()
    assert pdf.a.sum() == pytest.approx(0, abs=1e-9) and pdf.b.sum() == pytest.approx(0, abs=1e-9)
    assert (pdf.a ** 2).sum() == pytest.approx(1) and (pdf.b ** 2).sum() == pytest.approx(1)
    assert (pdf.a * pdf.b).sum() == pytest.approx(0, abs=1e-9)


def test_lmm_theta_zero_is_ols(spark, frame):
    des = make_design(frame, [("pub",), ("age",)], factors=["pub"])
    fit = mixed.mixed_fit(frame, des, "v", "grp", reml=False)
    pdf = frame.select(des.array().alias("x"), "v", "grp").toPandas()
    X, y = np.array(pdf.x.tolist()), pdf.v.to_numpy()
    # profile likelihood at the optimum beats or equals the OLS (theta = 0) value
    m0 = mixed._profile(0.0, *_parts(X, y, pdf.grp.to_numpy()), reml=False)[0]
    assert -2 * fit.loglik <= m0 + 1e-9
    # dense check of the profiled ML criterion at the fitted theta
    n = len(y)
    Z = (pdf.grp.to_numpy()[:, None] == np.unique(pdf.grp)[None, :]).astype(float)
    V = np.eye(n) + fit.theta * Z @ Z.T
    Vi = np.linalg.inv(V)
    beta = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
    r = y - X @ beta
    s2 = r @ Vi @ r / n
    m2 = n * np.log(2 * np.pi * s2) + np.linalg.slogdet(V)[1] + n
    assert -2 * fit.loglik == pytest.approx(m2, rel=1e-9)
    assert np.allclose(beta, fit.beta, atol=1e-8)


def test_reml_criterion_estimates_and_errors_against_dense_numpy(frame):
    des = make_design(frame, [("pub",), ("age",)], factors=["pub"])
    fit = mixed.mixed_fit(frame, des, "v", "grp", reml=True)
    pdf = frame.select(des.array().alias("x"), "v", "grp").toPandas()
    X, y = np.array(pdf.x.tolist()), pdf.v.to_numpy()
    n, p = X.shape
    Z = (pdf.grp.to_numpy()[:, None] == np.unique(pdf.grp)[None, :]).astype(float)

    def dense(theta):
        V = np.eye(n) + theta * Z @ Z.T
        Vi = np.linalg.inv(V)
        xvx = X.T @ Vi @ X
        beta = np.linalg.solve(xvx, X.T @ Vi @ y)
        r = y - X @ beta
        s2 = r @ Vi @ r / (n - p)
        m2 = (n - p) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(xvx)[1]
        return m2, beta, s2, np.linalg.inv(xvx) * s2

    m2, beta, s2, cov = dense(fit.theta)
    assert -2 * fit.loglik == pytest.approx(m2, rel=1e-8)
    assert np.allclose(beta, fit.beta, atol=1e-8) and fit.sigma2 == pytest.approx(s2, rel=1e-8)
    assert fit.sigma_b2 == pytest.approx(fit.theta * s2, rel=1e-8) and np.allclose(cov, fit.cov, rtol=1e-6)
    assert all(dense(fit.theta * f)[0] >= m2 - 1e-9 for f in (0.9, 0.99, 1.01, 1.1))


def test_fixed_effect_slopes_equal_a_dummy_fit(frame):
    df = frame.withColumn("grp_f", frame["grp"].cast("string"))
    full = glm.binomial_fit(df, make_design(df, [("grp_f",), ("pub",), ("age",)], factors=["grp_f", "pub"]), "v", "total")
    fe = models.fe_binomial_fit(df, make_design(df, [("pub",), ("age",)], factors=["pub"]), "v", "total", ["grp_f"])
    assert fe.coef()["age"] == pytest.approx(full.coef()["age"], rel=1e-7)
    assert fe.coef()["pubpol"] == pytest.approx(full.coef()["pubpol"], rel=1e-7) and fe.deviance == pytest.approx(full.deviance, rel=1e-9)


def _parts(X, y, g):
    from flockscope.stats.gram import Gram
    gram = Gram(X.T @ X, X.T @ y, float(y @ y), float(len(y)), float(len(y)))
    groups = [(float((g == k).sum()), X[g == k].sum(0), float(y[g == k].sum())) for k in np.unique(g)]
    return gram, groups


def test_chi2_sf():
    assert models.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    assert models.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-6)


def test_bootstrap_weight_trick(spark, frame):
    """A replicate's weighted refit equals the fit on literally duplicated clusters."""
    from flockscope.stats import bootstrap
    des = make_design(frame, [("pub",), ("age",)], factors=["pub"])
    fit = glm.binomial_fit(frame, des, "v", "total")
    betas, mult = bootstrap.bootstrap_fits(fit, frame, "grp", reps=3, seed=7, batch=3)
    m = {(r.rep, r.grp): r.m for r in mult.collect()}
    dup = None
    for (rep, g), k in m.items():
        if rep != 0:
            continue
        part = frame.where(F.col("grp") == g)
        for _ in range(int(k)):
            dup = part if dup is None else dup.unionByName(part)
    ref = glm.binomial_fit(dup, des, "v", "total")
    assert np.allclose(ref.beta, betas[0], atol=1e-6)


def test_bootstrap_curves_point_equals_avg_predictions(spark, frame):
    from flockscope.stats import bootstrap
    des = make_design(frame, [("pub",), ("age",), ("meta",)], factors=["pub", "meta"])
    fit = glm.binomial_fit(frame, des, "v", "total")
    cur = bootstrap.bootstrap_curves(spark, fit, frame, ["age"], ["meta"], "grp", reps=20, grid_n=5, seed=1)
    rows = cur.collect()
    grid = sorted({r.value for r in rows})
    ap = {(round(r.value, 9), r.meta): r.estimate
          for r in glm.avg_predictions(fit, frame, "age", grid, ["meta"]).collect()}
    for r in rows:
        assert r.estimate == pytest.approx(ap[(round(r.value, 9), r.meta)], rel=1e-9)
        assert r.conf_low <= r.conf_high
