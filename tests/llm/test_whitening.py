"""Operator 11 against whole-number Python and numpy."""

import math
from fractions import Fraction

import numpy as np

from flockscope.llm import whitening
from flockscope.llm.queries import QUERIES, read_table

from ..conftest import SF0001

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows, top=8):
    """(n, trace, eigenvalues, {row: (x, deviation)}) in whole numbers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    value, vector = np.linalg.eigh(cov)
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    order = np.argsort(-value)[:top]
    return n, np.trace(cov), value[order], centred @ vector[:, order] / np.sqrt(np.maximum(value[order], 1e-300)), dev


def agrees(found, rows, top=8):
    n, trace, values, white, dev = model(rows, top)
    at = {v: k for k, (v, _) in enumerate(rows)}
    assert len(found) == len(rows) * min(top, len(rows[0][1]))
    sign = {}
    for r in found:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, int(r.deviation)) == (n, dev[k])
        assert abs(r.explained - values[c] / trace) <= 1e-9 * abs(values[c] / trace) + 1e-15
        assert r.identity_error <= 1e-4
        if abs(white[k, c]) > 1e-6:
            sign.setdefault(c, np.sign(r.whitened * white[k, c]))
            assert abs(sign[c] * r.whitened - white[k, c]) < 1e-6 * max(1, abs(white[k, c]))


def test_query_against_whole_numbers(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF0001, "embeddings").collect()]
    found = QUERIES["op11_embedding_whitening"](spark, SF0001)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes)["deviation"] == "bigint"
    agrees(found.collect(), rows)


def test_dropped_rows_large_and_negative_entries(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(v) for v in (rng.normal(size=5) * [1, 300, 1e3, 0.05, 50]).astype(np.float32)]) for k in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, nan, 1.0, 1.0, 1.0]), (103, [inf] * 5), (104, [1.0]), (105, []),
           (106, [1e30] * 5)]
    rows = [(*r, 1) for r in good + bad]
    agrees(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), good)


def test_scatter_is_exact_for_any_bits():
    rng = np.random.default_rng(5)
    for high in (1, 2, 1000, 1 << 31, 1 << 61):
        x = rng.integers(-high, high, size=(333, 4))
        s, c = whitening.scatter(x)
        big = [[int(v) for v in r] for r in x]
        assert s == [sum(r[i] for r in big) for i in range(4)]
        assert all(c[i, j] == sum(r[i] * r[j] for r in big) for i in range(4) for j in range(i, 4))


def test_no_variance_repeats_clashes_and_empty(spark):
    same = spark.createDataFrame([(k, [0.5, 0.25], 1) for k in range(5)], SCHEMA)
    found = whitening.whiten(same).collect()
    assert len(found) == 10 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in found} == {(5, 0, None, None, None)}
    flat = spark.createDataFrame([(k % 3, [float(k % 3), 1.0], 1) for k in range(6)], SCHEMA)  # repeated rows, a constant dimension
    found = whitening.whiten(flat).collect()
    assert len(found) == 12 and all((r.whitened is None) == (r.component == 2) for r in found)
    assert {round(r.explained, 12) for r in found if r.component == 1} == {1.0} and all(r.identity_error < 1e-9 for r in found)
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = flat.selectExpr("vec_id", "embedding", "1 AS n", "2 AS component", "3 AS __vector")
    assert whitening.whiten(clash).count() == 12
