"""Logistic regression with absorbed fixed effects of any number of levels.

Levels are never collected, listed in a plan or coded as columns. An IRLS step
needs the weighted cross-products of the predictors and the working response
after the level means have been taken out. Those follow from the regression of
every such column on the levels, whose normal equations are small rows keyed by
(effect, level): the weights summed per combination of levels ("cells") are all
they need of the data. They are solved for all columns at once by conjugate
gradients scaled by the level weights, which is alternating within-group
centring, accelerated. Each iteration is one join of the cells with the level
rows and one aggregation; only sums of a few numbers per column reach the
driver. A single effect is exact after one iteration.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .design import Design
from .glm import ALIAS_TOL, GLMFit, _binomial_loglik, clamp, complete, find_aliased
from .gram import dot, partition_sums, stack

NODE = ["effect", "level"]


@dataclass
class AbsorbedFit(GLMFit):
    """Slopes of the fit; ``effects`` holds ``(effect, level, value)``, one row per level.

    Level values are fixed up to a constant moved from one effect to another;
    their sum in a row, and so every fitted value, is unique.
    """

    effects: DataFrame | None = None
    n_levels: int = 0

    @property
    def n_params(self) -> int:
        return len(self.keep) + self.n_levels - max(len(self.fe) - 1, 0)

    def fitted(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        """``df`` with the fitted proportion; rows of levels that are not in the fit go."""
        eta = self.eta() if len(self.keep) else F.lit(0.0)
        out = df.withColumn("__eta", eta).where(F.col("__eta").isNotNull())
        for i, f in enumerate(self.fe):
            out = out.withColumn(f"__f{i}", F.col(f).cast("string"))
        out = _with_effects(out, self.effects, len(self.fe))
        return out.withColumn(name, 1.0 / (1.0 + F.exp(-F.col("__eta")))).drop("__eta", *_keys(len(self.fe)))


class _Tables:
    """Intermediate tables of one fit, in one folder that all executors share; removed when the fit ends."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/absorb-{uuid.uuid4().hex}"
        self.count = 0

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _keys(n: int) -> list[str]:
    return [f"__f{i}" for i in range(n)]


def _with_effects(rows: DataFrame, effects: DataFrame, n: int) -> DataFrame:
    """Rows whose levels are all known, level values added to ``__eta``."""
    for i in range(n):
        one = effects.where(F.col("effect") == i).select(F.col("level").alias(f"__f{i}"), F.col("value").alias("__v"))
        rows = rows.join(one, f"__f{i}").withColumn("__eta", F.col("__eta") + F.col("__v")).drop("__v")
    return rows


def drop_separated_levels(df: DataFrame, fe: Sequence[str], y: str, weight: str | None) -> DataFrame:
    """Drop rows of levels whose outcome is all 0 or all 1 (repeated to a fixpoint).

    Level sums stay in Spark; the levels to drop are joined back by key.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = df
    while True:  # ends: every round but the last drops a level
        dropped = False
        for f in fe:
            bad = (out.groupBy(f).agg(F.sum(w * F.col(y)).alias("s1"), F.sum(w * (F.lit(1.0) - F.col(y))).alias("s0"))
                   .where((F.col("s1") <= 0) | (F.col("s0") <= 0)).select(f))
            if not bad.isEmpty():
                out, dropped = cut_lineage(out.join(bad, f, "left_anti").select(*out.columns)), True
        if not dropped:
            return out


def _sums(cells: DataFrame, n: int, q: int, values: list[Column]) -> DataFrame:
    """``values`` of the cells added up per level of every effect, as ``s0, s1, ...``."""
    node = F.array(*[F.struct(F.lit(i).alias("effect"), F.col(k).alias("level")) for i, k in enumerate(_keys(n))])
    rows = cells.select(F.explode(node).alias("n"), *[v.alias(f"s{j}") for j, v in enumerate(values)])
    return rows.groupBy("n.effect", "n.level").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(values))])


def _times(cells: DataFrame, vectors: DataFrame, n: int, q: int) -> DataFrame:
    """Normal matrix of the levels times ``v0 .. v(q-1)`` of every level."""
    out = cells.select(*_keys(n), "wt")
    total = [F.lit(0.0)] * q
    for i in range(n):
        one = vectors.where(F.col("effect") == i).select(
            F.col("level").alias(f"__f{i}"), *[F.col(f"v{j}").alias(f"u{i}_{j}") for j in range(q)])
        out = out.join(one, f"__f{i}")
        total = [t + F.col(f"u{i}_{j}") for j, t in enumerate(total)]
    return _sums(out, n, q, [F.col("wt") * t for t in total])


def _solve(tables: _Tables, cells: DataFrame, start: DataFrame, n: int, q: int, tol: float, max_iter: int) -> DataFrame:
    """Levels with right sides ``b``, solutions ``a`` and residuals ``r`` of the normal equations.

    ``start`` has ``effect, level, d, b*, a*`` with a first guess ``a``.
    """
    js = range(q)
    first = _times(cells, start.select(*NODE, *[F.col(f"a{j}").alias(f"v{j}") for j in js]), n, q)
    state = start.join(first, NODE).select(
        *NODE, "d", *[f"b{j}" for j in js], *[f"a{j}" for j in js],
        *[(F.col(f"b{j}") - F.col(f"s{j}")).alias(f"r{j}") for j in js])
    state = tables.store(state.select("*", *[(F.col(f"r{j}") / F.col("d")).alias(f"p{j}") for j in js]))
    size = state.agg(*[F.sum(F.col(f"b{j}") * F.col(f"b{j}") / F.col("d")) for j in js],
                     *[F.sum(F.col(f"r{j}") * F.col(f"r{j}") / F.col("d")) for j in js]).first()
    goal, rr = tol * tol * np.array(size[:q], float), np.array(size[q:], float)
    for _ in range(max_iter):
        if (rr <= goal).all():
            return state
        product = _times(cells, state.select(*NODE, *[F.col(f"p{j}").alias(f"v{j}") for j in js]), n, q)
        both = tables.store(state.join(product, NODE))
        dots = both.agg(*[F.sum(F.col(f"p{j}") * F.col(f"s{j}")) for j in js],
                        *[F.sum(F.col(f"r{j}") * F.col(f"s{j}") / F.col("d")) for j in js],
                        *[F.sum(F.col(f"s{j}") * F.col(f"s{j}") / F.col("d")) for j in js]).first()
        ps, rs, ss = (np.array(dots[i * q:(i + 1) * q], float) for i in range(3))
        going = (rr > goal) & (ps > 0)  # a solved column stands still
        step = np.where(going, rr / np.where(going, ps, 1.0), 0.0)
        after = np.maximum(rr - 2 * step * rs + step * step * ss, 0.0)
        turn = np.where(going, after / np.where(going, rr, 1.0), 0.0)
        new_r = [F.col(f"r{j}") - F.lit(float(step[j])) * F.col(f"s{j}") for j in js]
        state = both.select(
            *NODE, "d", *[f"b{j}" for j in js],
            *[(F.col(f"a{j}") + F.lit(float(step[j])) * F.col(f"p{j}")).alias(f"a{j}") for j in js],
            *[new_r[j].alias(f"r{j}") for j in js],
            *[(new_r[j] / F.col("d") + F.lit(float(turn[j])) * F.col(f"p{j}")).alias(f"p{j}") for j in js])
        if not going.any():
            return state
        rr = np.where(going, after, rr)
    raise RuntimeError(f"level equations not solved in {max_iter} iterations")


def _working(first: bool):
    """Working weight, working response and deviance of a row, as columns."""
    y, w, eta = F.col("__y"), F.col("__w"), F.col("__eta")
    if first:  # R's start
        mu = (w * y + 0.5) / (w + 1.0)
        eta = F.log(mu / (1.0 - mu))
    else:
        eps = float(np.finfo(float).eps)
        mu = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), 1.0 / (1.0 + F.exp(-eta))))
    var = mu * (1.0 - mu)
    return w * var, eta + (y - mu) / var


def _deviance(y: np.ndarray, w: np.ndarray, mu: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        each = (np.where(y > 0, y * np.log(y / mu), 0.0)
                + np.where(y < 1, (1.0 - y) * np.log((1.0 - y) / (1.0 - mu)), 0.0))
    return 2.0 * float(w @ each)


def _final_deviance(pdf: pd.DataFrame) -> np.ndarray:
    mu = clamp(1.0 / (1.0 + np.exp(-pdf["__eta"].to_numpy(np.float64))))
    return np.array([_deviance(pdf["__y"].to_numpy(np.float64), pdf["__w"].to_numpy(np.float64), mu)])


def _totals(first: bool):
    """Per batch: cross-products of [x, z] and the deviance."""
    def fn(pdf: pd.DataFrame) -> np.ndarray:
        c = np.column_stack([stack(pdf["__x"]), pdf["__z"].to_numpy(np.float64)])
        y, w = pdf["__y"].to_numpy(np.float64), pdf["__w"].to_numpy(np.float64)
        mu = (w * y + 0.5) / (w + 1.0) if first else clamp(1.0 / (1.0 + np.exp(-pdf["__eta"].to_numpy(np.float64))))
        cross = (c * pdf["__wt"].to_numpy(np.float64)[:, None]).T @ c
        return np.concatenate([cross.ravel(), [_deviance(y, w, mu), float(len(y))]])
    return fn


def _products(q: int):
    """Per batch of levels: b'a + a'r, what the levels take out of the cross-products."""
    def fn(pdf: pd.DataFrame) -> np.ndarray:
        a, b, r = (pdf[[f"{c}{j}" for j in range(q)]].to_numpy(np.float64) for c in "abr")
        return np.concatenate([(b.T @ a + a.T @ r).ravel(), [float(len(a))]])
    return fn


def absorbed_binomial_fit(df: DataFrame, design: Design, y: str, weight: str | None, fe: Sequence[str],
                          max_iter: int = 25, tol: float = 1e-8, max_inner: int = 500) -> AbsorbedFit:
    """Logistic GLM with one or more fixed effects; slopes, deviance and fitted values equal the dummy-coded fit.

    ``y`` is a proportion, ``weight`` the number of trials. Rows with a NULL
    response, weight, level or design value, and levels without variation in the
    outcome, are dropped. Predictors that the levels explain, or that repeat
    earlier ones, are left out, as R does. An empty table, or one where no level
    varies, is an error, and so is a fit that does not converge.
    """
    n = len(fe)
    if not n:
        raise ValueError("no fixed effects given: use binomial_fit")
    design = Design(design.factors, design.numeric, design.polys, design.terms, False)
    names, cols = design.build()
    w_all = F.col(weight).cast("double") if weight else F.lit(1.0)
    x_all = F.array(*cols) if cols else F.array().cast("array<double>")
    rows = df.select(x_all.alias("__x"), F.col(y).cast("double").alias("__y"), w_all.alias("__w"),
                     *[F.col(f).cast("string").alias(k) for f, k in zip(fe, _keys(n), strict=True)])
    known = F.lit(True)
    for k in ("__y", "__w", *_keys(n)):
        known = known & F.col(k).isNotNull()
    tables = _Tables(df)
    try:
        rows = tables.store(rows.where(known & (F.col("__w") > 0) & complete("__x")))
        rows = drop_separated_levels(rows, _keys(n), "__y", "__w")
        if rows.isEmpty():
            raise ValueError("no rows with a level that varies")
        keep, beta = list(range(len(names))), np.zeros(len(names))
        effects = solved = None
        dev_old, change, converged, it = math.inf, 1e-8, False, 0
        for it in range(1, max_iter + 1):
            first, p = it == 1, len(keep)
            q = p + 1
            now = rows.withColumn("__eta", dot(F.col("__x"), beta) if p and not first else F.lit(0.0))
            if not first:
                now = _with_effects(now, effects, n)
            wt, z = _working(first)
            now = now.withColumn("__wt", wt).withColumn("__z", z).persist()
            sums = partition_sums(now.select("__x", "__y", "__w", "__eta", "__wt", "__z"), _totals(first), q * q + 2)
            cross, dev, n_obs = sums[:q * q].reshape(q, q), float(sums[-2]), sums[-1]
            if not math.isfinite(dev):
                raise RuntimeError("deviance is not finite")
            c = [F.col("__x")[j] for j in range(p)] + [F.col("__z")]
            cells = tables.store(now.groupBy(*_keys(n)).agg(
                F.sum("__wt").alias("wt"), *[F.sum(F.col("__wt") * v).alias(f"c{j}") for j, v in enumerate(c)]))
            now.unpersist()
            start = _sums(cells, n, q, [F.col("wt"), *[F.col(f"c{j}") for j in range(q)]]).select(
                *NODE, F.col("s0").alias("d"), *[F.col(f"s{j + 1}").alias(f"b{j}") for j in range(q)])
            if solved is None:
                start = start.select("*", *[F.lit(0.0).alias(f"a{j}") for j in range(q)])
            else:  # the last solution is near
                start = start.join(solved.select(*NODE, *[f"a{j}" for j in range(q)]), NODE)
            converged = not first and abs(dev - dev_old) / (abs(dev) + 0.1) < tol
            # the cross-products err by the square of it, and the next step corrects the level values
            inner = 1e-8 if converged else min(max(0.1 * math.sqrt(change), 1e-8), 1e-3)
            solved = _solve(tables, cells, tables.store(start), n, q, inner, max_inner)
            taken = partition_sums(solved.drop(*NODE, "d"), _products(q), q * q + 1)
            within = cross - taken[:-1].reshape(q, q)
            within = (within + within.T) / 2
            if first and p:
                own, whole = np.diag(within)[:p].copy(), np.diag(cross)[:p]
                a = within[:p, :p].copy()
                gone = own <= ALIAS_TOL * whole
                a[gone, :] = a[:, gone] = 0.0
                keep = find_aliased(a)
                if len(keep) < p:
                    rows = tables.store(rows.withColumn("__x", F.array(*[F.col("__x")[i] for i in keep]) if keep
                                                        else F.array().cast("array<double>")))
                    order = [*keep, p]
                    within = within[np.ix_(order, order)]
                    solved = solved.select(*NODE, *[F.col(f"a{i}").alias(f"a{j}") for j, i in enumerate(order)])
                p = len(keep)
            beta = np.linalg.solve(within[:p, :p], within[:p, p]) if p else np.zeros(0)
            value = F.col(f"a{p}")
            for j in range(p):
                value = value - F.lit(float(beta[j])) * F.col(f"a{j}")
            effects = solved.select(*NODE, value.alias("value"))
            if converged:  # the step just taken is beyond the tolerance
                break
            if not first:
                change = abs(dev - dev_old) / (abs(dev) + 0.1)
            dev_old = dev
        if not converged:
            raise RuntimeError(f"fit of {y!r} did not converge in {max_iter} iterations")
        effects = cut_lineage(effects)
        cov = np.linalg.inv(within[:p, :p]) if p else np.zeros((0, 0))
        fit = AbsorbedFit(design, names, keep, beta, cov, dev, 0.0, float(n_obs), it, True, y, weight, tuple(fe),
                          effects=effects, n_levels=int(taken[-1]))
        last = _with_effects(rows.withColumn("__eta", dot(F.col("__x"), beta) if p else F.lit(0.0)), effects, n)
        fit.deviance = float(partition_sums(last.select("__y", "__w", "__eta"), _final_deviance, 1)[0])
        fit.loglik, fit.rmse = _binomial_loglik(last.select(F.array("__eta").alias("__x"), "__y", "__w"), np.ones(1), 0.0)
        return fit
    finally:
        tables.remove()
