"""Missing values, separation and nesting in the model layer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope.operators import agreement, network
from flockscope.sources import readers
from flockscope.sources.keywords import java_compiles, validate_fragments
from flockscope.stats import bootstrap, glm, models
from flockscope.stats.design import Design, make_design, poly2


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x, g, c = rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 20, n)
    w = rng.integers(5, 40, n)
    p = 1 / (1 + np.exp(-(0.3 + 0.5 * x + 0.2 * g)))
    y = rng.binomial(w, p) / w
    rows = [(int(i), float(a), f"g{b}", int(d), float(k), int(m)) for i, (a, b, d, k, m) in enumerate(zip(x, g, c, y, w, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, g string, c long, y double, w long")


def dense(df, levels=("g0", "g1", "g2")):
    pdf = df.toPandas()
    pdf = pdf[pdf.x.notna() & pdf.g.notna() & pdf.y.notna()]
    x = np.column_stack([np.ones(len(pdf)), pdf.x, *[(pdf.g == v).astype(float) for v in levels[1:]]]).astype(float)
    y, w, c = pdf.y.to_numpy(float), pdf.w.to_numpy(float), pdf.c.to_numpy()
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * mu * (1 - mu))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-x @ beta))
    h = (x * (w * mu * (1 - mu))[:, None]).T @ x
    u = {}
    for i, k in enumerate(c):
        u[k] = u.get(k, 0) + x[i] * w[i] * (y[i] - mu[i])
    u = np.array(list(u.values()))
    inv = np.linalg.inv(h)
    return beta, inv @ u.T @ u @ inv * len(u) / (len(u) - 1), mu


def test_missing_predictors_follow_one_rule(spark):
    df = frame(spark).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("x"))).withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g")))
    design = make_design(df, [("x",), ("g",)], factors=["g"])
    fit = glm.binomial_fit(df, design, "y", "w")
    beta, vcov, mu = dense(df)
    assert np.allclose(fit.beta, beta, atol=1e-7) and fit.n_obs == len(mu)
    assert np.allclose(glm.cluster_vcov(fit, df, "c"), vcov, rtol=1e-6)
    got = glm.avg_predictions(fit, df, "x", [0.0], vcov=vcov).first()
    groups = [r.g for r in df.select("g").collect() if r.g is not None]
    want = np.mean([1 / (1 + np.exp(-(beta[0] + (beta[2] if g == "g1" else beta[3] if g == "g2" else 0)))) for g in groups])
    assert math.isclose(got.estimate, want, rel_tol=1e-9)


def test_null_factor_is_not_the_base_level(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    cols = make_design(df, [("g",)], factors=["g"]).array()
    assert [r[0] for r in df.select(cols).collect()] == [[1.0, 0.0], [1.0, 1.0], [1.0, None]]


def test_poly2_moments_without_nulls(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0, None, float("nan"), None)], "x double")
    p = poly2(df, "x")
    x = np.array([1.0, 2.0, 4.0, 8.0])
    assert p.n == 4 and p.alpha0 == 3.75
    basis = np.array([[r[0], r[1]] for r in df.where("x IS NOT NULL AND NOT isnan(x)").select(*p.columns(F.col("x"))).collect()])
    assert np.allclose(basis.T @ basis, np.eye(2), atol=1e-12) and np.allclose(basis.sum(0), 0, atol=1e-12)
    assert np.allclose(basis[:, 0], (x - 3.75) / np.sqrt(((x - 3.75) ** 2).sum()))


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_separation_neither_crashes_nor_hides(spark):
    rows = [(float(i), 1.0 if i >= 10 else 0.0, i % 4) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, c int")
    fit = glm.binomial_fit(df, Design(terms=[("x",)]), "y")
    assert np.isfinite(fit.beta).all() and fit.loglik < 1e-6 and fit.beta[1] > 1
    with pytest.raises(np.linalg.LinAlgError):
        glm.find_aliased(np.array([[np.nan, 0.0], [0.0, 1.0]]))


def test_bootstrap_skips_replicates_that_fail_and_is_the_same_for_any_partitioning(spark):
    rows = [(float(i % 5), float(i % 2 if c < 5 else i % 5 > 2), c) for c in range(6) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, y double, c int")
    fit = glm.binomial_fit(df, Design(terms=[("x",)]), "y")
    one, _ = bootstrap.bootstrap_fits(fit, df.repartition(1), "c", reps=30, seed=3, batch=30)
    many, _ = bootstrap.bootstrap_fits(fit, df.repartition(7), "c", reps=30, seed=3, batch=30)
    assert one.keys() == many.keys() and all(np.allclose(one[r], many[r], atol=1e-8) for r in one)
    assert all(np.isfinite(b).all() for b in one.values())


def test_bootstrap_equals_dense_refits_with_null_clusters_and_counts_failures(spark):
    df = frame(spark, 300).selectExpr("x", "g", "nullif(c, 4) AS c", "y", "w")
    fit = glm.binomial_fit(df, make_design(df, [("x",), ("g",)], factors=["g"]), "y", "w")
    betas, mult = bootstrap.bootstrap_fits(fit, df, "c", reps=60, seed=5, batch=25)
    drawn = {(r.rep, r.c): r.m for r in mult.collect()}
    assert {sum(m for (rep, _), m in drawn.items() if rep == k) for k in range(60)} == {20} and len(betas) == 60
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.g == "g1", pdf.g == "g2"]).astype(float)
    for rep in (0, 24, 25, 59):
        w = pdf.w.to_numpy(float) * [drawn.get((rep, None if np.isnan(c) else int(c)), 0) for c in pdf.c]
        b = np.zeros(4)
        for _ in range(40):
            mu = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (pdf.y.to_numpy(float) - mu)))
        assert np.allclose(betas[rep], b, atol=1e-7)
    rows = bootstrap.bootstrap_curves(spark, fit, df, ["x"], ["g"], "c", reps=60, grid_n=3, seed=5, batch=60).collect()
    assert len(rows) == 9 and {(r.n_replicates, r.n_failed) for r in rows} == {(60, 0)}
    r = max(rows, key=lambda r: (r.value, r.g))  # the interval from dense predictions of all replicates
    part = pdf[pdf.g == r.g]
    at = np.column_stack([np.ones(len(part)), np.full(len(part), r.value), part.g == "g1", part.g == "g2"]).astype(float)
    means = []
    for rep in range(60):
        m = np.array([drawn.get((rep, None if np.isnan(c) else int(c)), 0) for c in part.c], float)
        means.append((m / (1 + np.exp(-at @ betas[rep]))).sum() / m.sum())
    assert np.allclose([r.conf_low, r.conf_high], np.quantile(means, [0.025, 0.975]), atol=1e-9)
    # a cluster of its own level: replicates without it cannot be told from aliased ones, and none is hidden
    odd = spark.createDataFrame([(float(i % 5), float(i % 5 > 2), i % 3) for i in range(30)], "x double, y double, c int")
    base = glm.binomial_fit(df, make_design(df, [("x",)]), "y", "w")
    base.weight, base.y = None, "y"
    with pytest.raises(RuntimeError, match="no replicate"):
        bootstrap.bootstrap_fits(base, odd.withColumn("y", F.lit(float("nan"))), "c", reps=3, seed=1)


def test_comparisons_need_nested_models(spark):
    df = frame(spark)
    fit = lambda *terms: glm.binomial_fit(df, make_design(df, list(terms), factors=["g"]), "y", "w")
    fits = {"base": fit(("x",)), "full": fit(("x",), ("g",)), "other": fit(("g",))}
    rows = {r.model: r for r in models.compare_models(spark, fits, {"full": "base"}).collect()}
    assert math.isclose(rows["full"].lr_stat, 2 * (fits["full"].loglik - fits["base"].loglik)) and rows["other"].lr_stat is None
    with pytest.raises(ValueError):
        models.compare_models(spark, fits, {"other": "base"})


def test_top_per_cluster_equals_a_plain_sort(spark):
    rows = [(i, 0 if i % 3 else i % 5, float(i * 37 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, grp int, grp_val double")
    got = {(r.grp, r.id) for r in network.top_per_cluster(df, 7).collect()}
    want = {(g, i) for g in {r[1] for r in rows} for i, *_ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:7]}
    assert got == want


def test_agreement_interval_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, float(k * 7 % 5) + j / 10) for k in range(4) for j in range(6)], "k1 int, ami double")
    run = lambda n: sorted(map(tuple, agreement.bootstrap_mean_ci(df.repartition(n), "k1", "ami", reps=50, seed=5).collect()))
    a, b = run(1), run(5)
    assert np.allclose(a, b, rtol=0, atol=1e-12)


def test_fragments_and_short_lines(spark, tmp_path):
    assert validate_fragments([r"\p{L}+blm", "(?P<n>vote)", "ok"], java_compiles(spark)) == ([r"\p{L}+blm", "ok"], ["(?P<n>vote)"])
    path = tmp_path / "profiles.tsv"
    path.write_text("1\tname\n")
    assert readers.read_profiles(spark, str(path)).first()[:3] == ("1", "name", None)
    edges = tmp_path / "edges.csv"
    edges.write_text("source,target,attr\n1,2,3\nx,2,3\n4,,1\n")
    assert readers.read_edges(spark, str(edges)).count() == 1 and readers.malformed_edges(spark, str(edges)).count() == 2
