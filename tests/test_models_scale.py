"""What models read is derived once, and curves need a row only once for all grid values."""

import numpy as np

from flockscope.plans import catalog, proxies
from flockscope.session import spread
from flockscope.stats import bootstrap


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_rows_are_written_once(spark, monkeypatch):
    made = spark.range(8).selectExpr("id % 2 AS grp", "id + 1L AS polcnt", "10L AS total", "id / 8 AS v", "'true' AS verified", "id AS value",
                                     "'d' AS description", "'u' AS username", "'l' AS Label", "1L AS followers_count", "1L AS following_count",
                                     "1L AS source_id_count")
    monkeypatch.setattr(catalog, "_x11", lambda *a: made)
    monkeypatch.setattr(catalog, "_panel", lambda *a: made)
    monkeypatch.setattr(catalog.frames, "account_model_frame", lambda *a: made)
    for name in ("infl_w_tweet_count", "infl_audience", "centrality"):
        monkeypatch.setattr(catalog.P, name, lambda *a: None)
    for rows in (catalog._x11_rows, catalog._lmm_frame, catalog._x12):
        out = rows(spark, "")
        assert "Range" not in _plan(out)  # read from storage, not derived again
        assert out.count() == 8
        assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_daily_counts_are_dealt_before_they_are_counted(spark, tmp_path):
    line = spark.createDataFrame([(1, "1998-06-01 10:00:00.25", "R", "O"), (1, "1998-06-01 10:00:00.75", "A", "O"), (2, "1998-06-02 00:00:00", "N", "F"),
                                  (None, "1998-06-02 00:00:00", "R", "F"), (2, None, "R", None)],
                                 "l_partkey long, d string, l_returnflag string, l_linestatus string")
    line.selectExpr("l_partkey", "CAST(d AS TIMESTAMP) AS l_shipdate", "l_returnflag", "l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 30), (2, 3)], "p_partkey long, p_size int").selectExpr(
        "p_partkey", "p_size", "1.0D AS p_retailprice", "'n' AS p_name", "'t' AS p_type", "'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    out = proxies.tweet_counts(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([
        ("1998-06-01 10:00:00", 5, 1, True, "total", 2), ("1998-06-01 10:00:00", 5, 1, True, "pol", 1), ("1998-06-01 10:00:00", 5, 1, True, "blm", 1),
        ("1998-06-02 00:00:00", 3, 2, False, "total", 1), (None, 3, 2, None, "total", 1), (None, 3, 2, None, "pol", 1)], key=str)
    assert "REPARTITION_BY_NUM" in _plan(out)  # not one partition per core


def test_spread_keeps_its_partitions(spark):
    few = spread(spark.range(100), "id")
    few.collect()
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_curve_sums_against_every_row_and_value():
    rng = np.random.default_rng(4)
    kinds = rng.normal(size=(3, 2))
    for scale in (1.0, 400.0):  # the second would overflow as a product
        base, rest = scale * rng.normal(size=(200, 5)), kinds[rng.integers(0, 3, 200)]
        pieces, beta = rng.normal(size=(4, 2)), rng.normal(size=(2, 5))
        with np.errstate(over="ignore"):
            want = [(1 / (1 + np.exp(-(base + (rest * p) @ beta)))).sum(0) for p in pieces]
        assert np.allclose(bootstrap._curve_sums(base, rest, pieces, beta), want, rtol=1e-12)


def test_curves_of_repeated_grid_values_and_missing_predictors(spark):
    """A row without the focal value counts in its curve, as the value is replaced, and in no other."""
    from flockscope.stats import design, glm
    rng = np.random.default_rng(8)
    rows = [(int(i % 6), "a" if i % 3 else "b", float(rng.normal()) if i % 7 else None, float(i % 2), 20.0,
             float(rng.integers(4, 16)) / 20) for i in range(120)]
    df = spark.createDataFrame(rows, "c int, g string, x double, u double, w double, v double")
    fit = glm.binomial_fit(df, design.make_design(df, [("g",), ("x",), ("u",), ("x", "g")], factors=["g"]), "v", "w")
    out = bootstrap.bootstrap_curves(spark, fit, df, ["x", "u"], ["g"], "c", reps=10, grid_n=9, seed=2, batch=10).collect()
    at = {(r.focal, r.value, r.g): r.estimate for r in out}
    assert len(at) == len(out)
    for (focal, value, g), est in at.items():
        coef = fit.coef()
        mus = []
        for _, gg, x, u, _, _ in rows:
            x, u = (value, u) if focal == "x" else (x, value)
            if gg == g and x is not None:
                b = float(gg == "b")
                eta = coef["(Intercept)"] + coef["gb"] * b + coef["x"] * x + coef["u"] * u + coef["x:gb"] * x * b
                mus.append(1 / (1 + np.exp(-eta)))
        assert np.isclose(est, np.mean(mus), rtol=1e-9)


def test_replicate_sums_over_distinct_columns(spark):
    """Sums over a block's distinct columns and the replicates that drew its cluster equal the plain ones."""
    rng = np.random.default_rng(8)
    blocks, plain, p, reps = [], 0.0, 7, 6
    for _ in range(3):
        z, n = rng.normal(size=(40, 2)), 40
        x = np.column_stack([np.ones(n), np.zeros(n), z[:, 0], z[:, 0], z[:, 1], np.ones(n) * 2, z[:, 1]])
        y, w, m = rng.random((n, 1)), rng.integers(1, 9, (n, 1)).astype(float), np.array([0, 1, 2, 0, 1, 3])
        y[:3], y[3:6] = 0.0, 1.0
        blocks.append((x.ravel().tolist(), y.ravel().tolist(), w.ravel().tolist(), m.tolist()))
    frame = spark.createDataFrame(blocks, "xs array<double>, ys array<double>, ws array<double>, m array<int>")
    for betas in (rng.normal(size=(p, reps)), np.repeat(rng.normal(size=(p, 1)), reps, axis=1)):
        plain = np.zeros((reps, p * (p + 1) // 2 + p + 1))
        for xs, ys, ws, m in blocks:
            x, y, w = np.reshape(xs, (-1, p)), np.array(ys)[:, None], np.array(ws)[:, None]
            eta = x @ betas
            mu = 1 / (1 + np.exp(-eta))
            with np.errstate(divide="ignore", invalid="ignore"):
                lost = np.where(y > 0, y * np.log(y / mu), 0) + np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0)
            weight = w * mu * (1 - mu) * np.array(m)
            for r in range(reps):
                plain[r] += np.concatenate([(x.T @ (x * weight[:, [r]]))[np.triu_indices(p)], x.T @ (weight[:, r] * eta[:, r] + (w * m[r] * (y - mu))[:, r]),
                                            [2 * m[r] * (w * lost)[:, r].sum()]])
        assert np.allclose(bootstrap._replicate_sums(frame, betas, np.arange(reps), p), plain, rtol=1e-10, atol=1e-10)
    first, at = bootstrap._distinct_columns(np.reshape(blocks[0][0], (-1, p)))
    assert first.tolist() == [0, 2, 4, 5] and at.tolist() == [0, -1, 1, 1, 2, 3, 2]
