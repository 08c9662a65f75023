"""Agreement between cluster solutions.

Pair rows come from packing an id's settings (one row per k setting) and pairing
them with k1 < k2: one scan, no self join. Everything after that works on the contingency table, whose size
is bounded by (#clusters)^2 per pair of settings: n_ij by one ``groupBy``,
margins by a second. The expected mutual information of AMI is a sum over
the hypergeometric support of every cell, evaluated in ``mapInPandas`` with a
log-factorial helper (no scipy); cells are spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

PAIR_KEYS = ("k1", "k2")


def _one_way_pairs(assign: DataFrame, k: str, id_col: str, grp: str) -> DataFrame:
    """(id, k1, k2, g1, g2) with k1 < k2, from one scan: an id's settings are packed, then paired."""
    packed = assign.groupBy(F.col(id_col).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), F.col(grp).alias("g")))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(
        F.filter("a", lambda y: y["k"] > x["k"]), lambda y: F.struct(
            x["k"].alias("k1"), y["k"].alias("k2"), x["g"].alias("g1"), y["g"].alias("g2")))))
    return packed.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def _mirrored(one: DataFrame, *other: str) -> DataFrame:
    """Rows of both directions: every (k1, g1) exchanged with (k2, g2)."""
    swap = F.array(*[F.struct(F.col(f"k{a}").alias("k1"), F.col(f"k{b}").alias("k2"), F.col(f"g{a}").alias("g1"),
                              F.col(f"g{b}").alias("g2")) for a, b in ((1, 2), (2, 1))])
    return one.select(*other, F.explode(swap).alias("p")).select(*other, "p.*")


def assignment_pairs(assign: DataFrame, k: str = "k", id_col: str = "id", grp: str = "grp") -> DataFrame:
    """(id, k1, k2, g1, g2) for every pair of settings, both directions."""
    return _mirrored(_one_way_pairs(assign, k, id_col, grp), "id")


def contingency(pairs: DataFrame) -> DataFrame:
    """n_ij per (k1, k2, g1, g2)."""
    return pairs.groupBy(*PAIR_KEYS, "g1", "g2").agg(F.count(F.lit(1)).alias("nij"))


def _margins(cont: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = cont.groupBy(*PAIR_KEYS, "g1").agg(F.sum("nij").alias("a"))
    b = cont.groupBy(*PAIR_KEYS, "g2").agg(F.sum("nij").alias("b"))
    return a, b


def _choose2(c):
    return c * (c - F.lit(1)) / F.lit(2.0)


def agreement_measures(cont: DataFrame, with_ami: bool = True) -> DataFrame:
    """MI, entropies, NMI (MI / max H), ARI and AMI per (k1, k2).

    Entropies are in nats. AMI = (MI - E[MI]) / (max(Hu, Hv) - E[MI]) with the
    hypergeometric expectation.
    """
    a, b = _margins(cont)
    n = cont.groupBy(*PAIR_KEYS).agg(F.sum("nij").cast("double").alias("N"))
    cells = cont.join(a, [*PAIR_KEYS, "g1"]).join(b, [*PAIR_KEYS, "g2"]).join(n, list(PAIR_KEYS))
    nij, ai, bj, N = (F.col(c).cast("double") for c in ("nij", "a", "b", "N"))
    mi = cells.groupBy(*PAIR_KEYS).agg(
        F.sum(nij / N * F.log(N * nij / (ai * bj))).alias("mi"),
        F.sum(_choose2(nij)).alias("sum_nij2"), F.first("N").alias("N"))
    hu = a.join(n, list(PAIR_KEYS)).groupBy(*PAIR_KEYS).agg(
        (-F.sum(F.col("a") / F.col("N") * F.log(F.col("a") / F.col("N")))).alias("hu"),
        F.sum(_choose2(F.col("a").cast("double"))).alias("sum_a2"))
    hv = b.join(n, list(PAIR_KEYS)).groupBy(*PAIR_KEYS).agg(
        (-F.sum(F.col("b") / F.col("N") * F.log(F.col("b") / F.col("N")))).alias("hv"),
        F.sum(_choose2(F.col("b").cast("double"))).alias("sum_b2"))
    out = mi.join(hu, list(PAIR_KEYS)).join(hv, list(PAIR_KEYS))
    hmax = F.greatest("hu", "hv")
    expected = F.col("sum_a2") * F.col("sum_b2") / _choose2(F.col("N"))
    max_index = (F.col("sum_a2") + F.col("sum_b2")) / F.lit(2.0)
    out = out.withColumns({
        "nmi": F.try_divide(F.col("mi"), hmax),
        "ari": F.try_divide(F.col("sum_nij2") - expected, max_index - expected),
    })
    if with_ami:
        emi = expected_mutual_information(cont)
        out = (out.join(emi, list(PAIR_KEYS))
               .withColumn("ami", F.try_divide(F.col("mi") - F.col("emi"), hmax - F.col("emi"))))
    return out.drop("sum_nij2", "sum_a2", "sum_b2", "N")


# ---------------------------------------------------------------- E[MI]
_SMALL = 256
_LOGFACT_SMALL = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) for integer arrays: exact table below 256, Stirling series above."""
    n = np.asarray(n, dtype=np.float64)
    out = np.empty_like(n)
    small = n < _SMALL
    out[small] = _LOGFACT_SMALL[n[small].astype(np.int64)]
    x = n[~small] + 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    out[~small] = ((x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi)
                   + inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680))))
    return out


def _emi_cell(a: int, b: int, n: int, chunk: int = 1 << 16) -> float:
    """Sum over the hypergeometric support of one cell, outward from the mode.

    Terms shrink monotonically away from the mode; a chunk in which every
    probability underflows to 0.0 ends that direction (all later terms are
    exactly 0.0 in double precision as well).
    """
    lo, hi = max(1, a + b - n), min(a, b)
    if hi < lo:
        return 0.0
    const = (log_factorial(np.array([a, b, n - a, n - b], dtype=np.float64)).sum()
             - log_factorial(np.array([n], dtype=np.float64))[0])
    mode = min(max(int((a + 1) * (b + 1) // (n + 2)), lo), hi)

    def block(start: int, stop: int) -> tuple[float, bool]:
        k = np.arange(start, stop, dtype=np.float64)
        logp = const - (log_factorial(k) + log_factorial(a - k) + log_factorial(b - k)
                        + log_factorial(n - a - b + k))
        p = np.exp(logp)
        term = k / n * np.log(n * k / (float(a) * b)) * p
        return float(term.sum()), bool((p > 0).any())

    total = 0.0
    start = mode
    while start <= hi:  # upward, mode included
        stop = min(hi + 1, start + chunk)
        s, alive = block(start, stop)
        total += s
        if not alive:
            break
        start = stop
    stop = mode
    while stop > lo:  # downward
        start = max(lo, stop - chunk)
        s, alive = block(start, stop)
        total += s
        if not alive:
            break
        stop = start
    return total


_EMI_SCHEMA = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                            T.StructField("term", T.DoubleType())])


def _emi_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        terms = [_emi_cell(int(a), int(b), int(n)) for a, b, n in zip(pdf["a"], pdf["b"], pdf["N"])]
        yield pd.DataFrame({"k1": pdf["k1"].astype("int64"), "k2": pdf["k2"].astype("int64"),
                            "term": np.asarray(terms, dtype=np.float64)})


def expected_mutual_information(cont: DataFrame) -> DataFrame:
    """E[MI] per (k1, k2) under the permutation (hypergeometric) model."""
    a, b = _margins(cont)
    n = cont.groupBy(*PAIR_KEYS).agg(F.sum("nij").alias("N"))
    cells = (a.join(b, list(PAIR_KEYS)).join(n, list(PAIR_KEYS))
             .select(F.col("k1").cast("long"), F.col("k2").cast("long"), "a", "b", "N"))
    # one cell per row; spread cells over tasks before the Python step
    cells = cells.repartition(F.col("k1"), F.col("k2"), F.col("a"), F.col("b"))
    terms = cells.mapInPandas(_emi_partition, _EMI_SCHEMA)
    return terms.groupBy("k1", "k2").agg(F.sum("term").alias("emi")).withColumns(
        {"k1": F.col("k1").cast(cont.schema["k1"].dataType), "k2": F.col("k2").cast(cont.schema["k2"].dataType)})


def cluster_agreement(assign: DataFrame, with_ami: bool = True) -> DataFrame:
    """A12 end to end: (k1, k2, mi, hu, hv, nmi, ari[, emi, ami]) both directions.

    One scan counts one direction; the table (clusters squared per pair of
    settings) is checkpointed, and the symmetric measures are mirrored with the
    two entropies exchanged.
    """
    cont = cut_lineage(contingency(_one_way_pairs(assign, "k", "id", "grp")))
    one = agreement_measures(cont, with_ami)
    rest = [c for c in one.columns if c not in (*PAIR_KEYS, "hu", "hv")]
    both = F.array(*[F.struct(F.col(f"k{a}").alias("k1"), F.col(f"k{b}").alias("k2"), F.col(f"h{x}").alias("hu"),
                              F.col(f"h{y}").alias("hv")) for a, b, x, y in ((1, 2, "u", "v"), (2, 1, "v", "u"))])
    return one.select(F.explode(both).alias("p"), *rest).select("p.*", *rest)


def mean_agreement(agree: DataFrame, col: str = "ami", by: str = "k1") -> DataFrame:
    """M7: mean agreement of each setting against all others."""
    return agree.groupBy(by).agg(F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n_pairs"))


def choose_k(agree: DataFrame, col: str = "ami", by: str = "k1") -> DataFrame:
    """M7: the setting with the highest mean agreement (ties: smallest k)."""
    m = mean_agreement(agree, col, by)
    return m.agg(F.max_by(F.col(by), F.struct(F.col("mean"), -F.col(by))).alias("k"),
                 F.max("mean").alias("mean"))


def bootstrap_mean_ci(df: DataFrame, by: str, col: str, conf: float = 0.66, reps: int = 1000,
                      seed: int = 779) -> DataFrame:
    """Mean and percentile bootstrap CI of ``col`` per ``by``.

    Each group is resampled with replacement ``reps`` times; groups are small
    (one value per other setting), and replicates are spread over tasks: the
    (group, replicate) grid is generated in Spark and each replicate draws its
    own resample from a seeded generator.
    """
    lo_q, hi_q = (1 - conf) / 2, 1 - (1 - conf) / 2
    vals = df.groupBy(by).agg(F.sort_array(F.collect_list(F.col(col).cast("double"))).alias("vals"),
                              F.avg(col).alias("mean"))
    reps_df = vals.select(by, "vals", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    # resample indices: floor(rand * n) per draw, seeded per (group, replicate) row
    n = F.size("vals")
    draws = reps_df.select(by, "rep", "vals", F.explode(F.sequence(F.lit(1), n)).alias("draw"))
    # a hash of (seed, group, replicate, draw): the same resample for any partitioning
    idx = F.pmod(F.xxhash64(F.lit(seed), F.col(by), "rep", "draw"), F.size("vals")).cast("int")
    picked = draws.select(by, "rep", F.element_at("vals", idx + 1).alias("x"))
    means = picked.groupBy(by, "rep").agg(F.avg("x").alias("m"))
    ci = means.groupBy(by).agg(F.percentile("m", lo_q).alias("lower"), F.percentile("m", hi_q).alias("upper"))
    return vals.select(by, "mean").join(ci, by)
