"""What the factorisation and its input write: no edges or factors shuffled per product, nothing kept afterwards."""

import os

import numpy as np

from flockscope.operators import factor, network
from flockscope.session import ensure_checkpoint_dir


def _edges(seed=4, blocks=4, rows=25, cols=15):
    rng = np.random.default_rng(seed)
    return sorted({(s, 1000 + t) for s in range(blocks * rows) for t in range(blocks * cols)
                   if rng.random() < (0.5 if s // rows == t // cols else 0.06)})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_shuffle_nothing(spark):
    """Tiles and factors meet where they are kept; a state of several tables is joined in its buckets."""
    graph = factor.Graph(spark.createDataFrame(_edges(), "source long, target long"), 8, block=7)
    start = factor.Stored(factor._start(graph.rows, 3, 1))
    try:
        tiles = _plan(graph.tiles["cb"])
        plan = _plan(graph.sums(start.df, False, 2)).replace(tiles, "")
        assert "CartesianProduct" in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
        assert {r.blk for r in graph.sums(start.df, False, 2).select("blk").collect()} == {r.blk for r in graph.cols.select("blk").collect()}
    finally:
        start.drop()
        graph.close()


def test_edges_without_an_id_count_in_degrees_only(spark):
    edges = [*_edges(), (None, 1000), (None, 1003), (5, None), (7, None), (None, None)]
    graph = factor.Graph(spark.createDataFrame(edges, "source long, target long"), 8, block=7)
    x = {r.id: np.array(r.vec) for r in factor._by_id(graph.rows, factor._start(graph.rows, 3, 1)).collect()}
    got = {r.id: np.array(r.vec) for r in factor._by_id(graph.cols, graph.product(factor._start(graph.rows, 3, 1), False, 3)).collect()}
    graph.close()
    dr, dc = ({v: sum(1 for e in edges if e[side] == v) for v in {e[side] for e in edges}} for side in (0, 1))
    tr, tc = (len(edges) / (len(d) - 1) for d in (dr, dc))
    want = {t: np.zeros(3) for t in dc}
    for s, t in edges:
        if s is not None and t is not None:
            want[t] += x[s] / np.sqrt((dr[s] + tr) * (dc[t] + tc))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[t], want[t], atol=1e-12) for t in want)


def test_nothing_is_kept(spark):
    """The tables of the iteration are dropped, also when it fails."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    stored = lambda: ({x for _, names, _ in os.walk(folder) for x in names if x.startswith("stored_")},
                      {t.name for t in spark.catalog.listTables() if t.name.startswith("stored_")})
    before = stored()
    df = spark.createDataFrame(_edges(), "source long, target long")
    factor.spectral_factors(df, 3, block=16)
    try:
        factor.spectral_factors(df, 9, max_sweeps=1, oversample=0, tol=1e-12)
    except RuntimeError:
        pass
    assert stored() == before


def test_pruning_derives_the_edges_once(spark):
    edges = [(s, t) for s in range(30) for t in range(s % 7 + 1)] + [(None, 0), (3, None), (1, 0)]
    out = network.prune_follows(spark.createDataFrame(edges, "source long, target long"), 15, 3)
    assert _plan(out).count("Scan ExistingRDD") == 1
    kept = [(s, t) for s, t in edges if t is not None and sum(u == t for _, u in edges) >= 15]
    want = [(s, t) for s, t in kept if s is not None and sum(u == s for u, _ in kept) >= 3]
    assert want and sorted(map(tuple, out.collect())) == sorted(want)
