"""Operator semantics on small frames and on the sf0.001 driver tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from flockscope.operators import agreement, counts, events, frames, network
from tests.conftest import SF0001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"date", "grp", "userid", "is_rt", "regex_type", "count"}
    assert df.count() > 0


@pytest.mark.parametrize("name", ["daily_keyword_counts", "event_window", "cluster_audience_stats",
                                  "prune_follows", "top_per_cluster", "cluster_agreement", "account_model_frame"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF0001)
    cols = sorted(sdf.columns)

    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = sorted((tuple(norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_event_window_total_missing(spark):
    daily = spark.createDataFrame(
        [("pol", 1, "2020-05-26", 3), ("total", 1, "2020-05-26", 10), ("pol", 2, "2020-05-26", 4)],
        "regex_type string, grp int, date string, count long")
    out = events.event_window(daily, [("2020-05-26", "e")]).collect()
    assert [(r.grp, r.polcnt, r.total, r.t) for r in out] == [(1, 3, 10, "0")]


def test_prune_one_pass(spark):
    # account a has 2 followers, b has 1; panelists need >= 1 kept follow
    e = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "source long, target long")
    got = sorted((r.source, r.target) for r in network.prune_follows(e, 2, 1).collect())
    assert got == [(1, 10), (2, 10)]


def test_center_scale2(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (3, 4.0), (3, 4.0)], "grp int, x double")
    got = sorted((r.grp, r.x, r.c) for r in frames.center_scale2(df, {"c": "x"}, "grp").collect())
    assert got[0][2] == pytest.approx(-0.5) and got[2][2] == pytest.approx(0.5)
    assert [g[2] for g in got if g[0] == 2] == [None]
    assert [g[2] for g in got if g[0] == 3] == [None, None]


def test_log_odds(spark):
    df = spark.createDataFrame([(1, 2), (3, 2)], "c1 long, c2 long")
    r = frames.log_odds(df, "c1", "c2").orderBy("c1").first()
    assert r.delta == pytest.approx(math.log(2 / 4) - math.log(3 / 3))
    assert r.sigma == pytest.approx(1 / 2 + 1 / 3)


def test_quantile_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    r = frames.quantiles(df, "x", [0.025, 0.975]).first()
    assert (r[0], r[1]) == (pytest.approx(1.075), pytest.approx(7.7))


def test_agreement_identity_and_swap(spark):
    rows = [(i, 1, i % 3) for i in range(30)] + [(i, 2, (i % 3 + 1) % 3) for i in range(30)]
    a = spark.createDataFrame(rows, "id long, k int, grp int")
    out = agreement.cluster_agreement(a).collect()
    for r in out:
        assert r.ami == pytest.approx(1.0) and r.ari == pytest.approx(1.0) and r.nmi == pytest.approx(1.0)


def test_partition_invariance(spark):
    q = E.queries()["user_group_counts"]
    a = sorted(q(spark, SF0001).repartition(1).collect())
    b = sorted(q(spark, SF0001).repartition(8).collect())
    assert a == b


def test_excluded_summary(spark):
    df = spark.createDataFrame([(1, "Non-US A", "x"), (2, "B", "No Clear Pattern"), (3, None, "y")],
                               "grp int, Label string, narrow_label string")
    r = counts.excluded_summary(df).first()
    assert (r.n_grp_label, r.n_grp_no_pattern, r.excluded_labels) == (1, 1, "B, Non-US A")


def test_emi_matches_bruteforce():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 4, 120), rng.integers(0, 5, 120)
    n = len(u)
    a, b = np.bincount(u), np.bincount(v)
    brute = 0.0
    for ai in a:
        for bj in b:
            for x in range(max(1, ai + bj - n), min(ai, bj) + 1):
                lp = (math.lgamma(ai + 1) + math.lgamma(bj + 1) + math.lgamma(n - ai + 1) + math.lgamma(n - bj + 1)
                      - math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(ai - x + 1) - math.lgamma(bj - x + 1)
                      - math.lgamma(n - ai - bj + x + 1))
                brute += x / n * math.log(n * x / (ai * bj)) * math.exp(lp)
    ours = sum(agreement._emi_cell(int(x), int(y), n) for x in a for y in b)
    assert ours == pytest.approx(brute, rel=1e-10)
