"""Cluster bootstrap of logistic fits and counterfactual curves.

Replicates resample clusters with replacement. A cluster drawn m times enters
the refit with weight m (copies carry identical rows, and with their own
fixed effects the copies' slopes equal one weighted fit). A cluster's
multiplicities in all replicates are one array; rows are packed into blocks of
one cluster, so an array travels once per block and no row is repeated. A task
forms X'WX of all replicates that drew a block's cluster as one matrix product
(products of the block's distinct columns by rows, times rows by replicates); Spark adds the tasks' sums per
chunk of replicates, and one p x p system per replicate reaches the driver. A
replicate whose fit fails (singular system) or does not converge is left out
and counted; all failing is an error.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .glm import GLMFit, clamp, complete, find_aliased
from .gram import vector_sums

log = logging.getLogger(__name__)


#: Replicates whose sums travel together.
CHUNK = 50
#: Most rows of a block.
BLOCK_ROWS = 1024


def cluster_numbers(df: DataFrame, cluster: str) -> DataFrame:
    """``(cluster, idx)``: the clusters in order, numbered from 0, without one task that holds them all.

    The sorted clusters are written, so their partitions stay as they are; a number is
    the place in its partition behind the sizes of the partitions before it.
    """
    marked = cut_lineage(df.select(cluster).distinct().orderBy(cluster)
                         .select(cluster, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mark")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = (marked.groupBy("part").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
             .select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    return marked.join(parts, "part").select(cluster, (F.col("mark") - F.col("first") + F.col("ahead")).alias("idx"))


def multiplicity_arrays(df: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """``(cluster, m)``: how often each replicate drew the cluster, an array of ``reps`` numbers.

    Each replicate draws #clusters clusters with replacement. Draws are made
    with ``spark.range`` and counted, so nothing is enumerated on the driver. A
    null cluster is a cluster of its own.
    """
    ids = cluster_numbers(df, cluster)
    n_g = ids.count()
    draws = (df.sparkSession.range(reps * n_g)
             .select((F.col("id") / n_g).cast("int").alias("rep"),
                     # a draw is a hash of (seed, number): the same for any partitioning
                     F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n_g)).alias("idx")))
    drawn = (draws.groupBy("idx", "rep").agg(F.count(F.lit(1)).cast("int").alias("m"))
             .groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("rep", "m"))).alias("drawn")))
    every = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.col("drawn")[r], F.lit(0)))
    never = F.array_repeat(F.lit(0), reps)
    return ids.join(drawn, "idx", "left").select(cluster, F.when(F.col("drawn").isNull(), never).otherwise(every).alias("m"))


def cluster_multiplicities(arrays: DataFrame, cluster: str) -> DataFrame:
    """``(rep, cluster, m)`` of the multiplicity arrays, a row per replicate and drawn cluster."""
    return arrays.select(F.posexplode("m").alias("rep", "m"), cluster).where("m > 0").select("rep", cluster, "m")


def _flat(column: pa.ListArray, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def packed(rows: DataFrame, key: str, p: int) -> DataFrame:
    """``rows`` (``key``, ``__x``, ``__y``, ``__w``) as blocks of one key each: flat arrays of up to ``BLOCK_ROWS`` rows."""
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            x = _flat(b.column(1)).reshape(b.num_rows, p)
            y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            order = np.argsort(coded, kind="stable")
            heads = np.flatnonzero(np.diff(coded[order], prepend=-1))
            blocks = [order[lo:min(lo + BLOCK_ROWS, z)] for a, z in zip(heads, [*heads[1:], len(order)], strict=True)
                      for lo in range(a, z, BLOCK_ROWS)]
            lists = lambda of, per: pa.ListArray.from_arrays(
                np.cumsum([0, *[per * len(i) for i in blocks]]).astype(np.int32), pa.array(np.concatenate([of[i].ravel() for i in blocks])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i[0] for i in blocks])), lists(x, p), lists(y, 1), lists(w, 1)], [key, "xs", "ys", "ws"])

    return rows.select(key, "__x", "__y", "__w").mapInArrow(
        run, f"`{key}` {key_type}, xs array<double>, ys array<double>, ws array<double>")


def _distinct_columns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a block that differ and are not zero, and every column's place among them (-1: zero).

    Within one cluster most indicators are constant, so that many interactions are zero or equal.
    """
    seen: dict[bytes, int] = {}
    first, at = [], np.full(x.shape[1], -1)
    some = (x != 0).any(axis=0)
    for j in np.flatnonzero(some):
        place = seen.setdefault(x[:, j].tobytes(), len(first))
        if place == len(first):
            first.append(j)
        at[j] = place
    return np.array(first, dtype=int), at


def _add_products(total: np.ndarray, at: np.ndarray, m: np.ndarray, part: np.ndarray, upper: tuple) -> None:
    """Add ``part``, the sums over a block's distinct columns, to the rows of the replicates that drew its cluster."""
    act, own, q = np.flatnonzero(m), np.flatnonzero(at >= 0), at.max(initial=-1) + 1
    pairs = np.flatnonzero((at[upper[0]] >= 0) & (at[upper[1]] >= 0))
    one, two = at[upper[0][pairs]], at[upper[1][pairs]]
    lo, hi = np.minimum(one, two), np.maximum(one, two)
    triangle = q * (q + 1) // 2
    cols = np.concatenate([pairs, len(upper[0]) + own, [total.shape[1] - 1]])
    from_ = np.concatenate([lo * q - lo * (lo - 1) // 2 + hi - lo, triangle + at[own], [part.shape[1] - 1]])
    total[np.ix_(act, cols)] += m[act][:, None] * part[:, from_]


def _replicate_sums(blocks: DataFrame, betas: np.ndarray, reps: np.ndarray, p: int) -> np.ndarray:
    """Upper triangles of X'WX, X'Wz and the deviance of every replicate, a row each; one pass over the blocks.

    A block's sums are formed over its distinct columns, for the replicates that drew
    its cluster, and once for all replicates while these have the same coefficients.
    """
    upper = np.triu_indices(p)
    width = len(upper[0]) + p + 1
    equal = bool((betas == betas[:, :1]).all())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(reps), width))
        held: dict[tuple, np.ndarray] = {}

        def emptied():
            for (at, m), part in held.items():
                _add_products(total, np.frombuffer(at, dtype=np.int64), np.frombuffer(m), part, upper)
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                m = _flat(b.column(3)[i:i + 1])[reps]
                act = np.flatnonzero(m)
                if not len(act):
                    continue
                every = _flat(b.column(0)[i:i + 1]).reshape(-1, p)
                first, at = _distinct_columns(every)
                x, own = every[:, first], np.flatnonzero(at >= 0)
                y, w = _flat(b.column(1)[i:i + 1])[:, None], _flat(b.column(2)[i:i + 1])[:, None]
                coef = np.zeros((len(first), 1 if equal else len(act)))
                np.add.at(coef, at[own], betas[own][:, :1] if equal else betas[np.ix_(own, act)])
                eta = x @ coef
                mu = clamp(1.0 / (1.0 + np.exp(-eta)))
                var = mu * (1.0 - mu)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lost = np.where(y > 0, y * np.log(y / mu), 0.0) + np.where(y < 1, (1.0 - y) * np.log((1.0 - y) / (1.0 - mu)), 0.0)
                weight = w * var
                one, two = np.triu_indices(len(first))
                part = np.hstack([weight.T @ (x[:, one] * x[:, two]), (weight * eta + w * (y - mu)).T @ x, 2 * (w * lost).sum(0)[:, None]])
                key = at.astype(np.int64).tobytes(), m.tobytes()
                held[key] = held[key] + part if key in held else part
                if len(held) > 32:
                    emptied()
        emptied()
        at = np.arange(0, len(reps), CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i:i + CHUNK].ravel() for i in at], pa.list_(pa.float64()))], ["at", "s"])

    parts = blocks.select("xs", "ys", "ws", "m").mapInArrow(run, "at long, s array<double>")
    sums = np.zeros((len(reps), width))
    for at, s in vector_sums(parts, "at", F.col("s")).collect():  # replicates x p x p numbers
        sums[at:at + CHUNK] = np.asarray(s).reshape(-1, width)
    return sums


def _batched_irls(blocks: DataFrame, reps: list[int], beta0: np.ndarray, p: int, max_iter: int = 25,
                  tol: float = 1e-8) -> dict[int, np.ndarray]:
    """IRLS for many replicates at once; ``blocks`` has xs, ys, ws and the multiplicities ``m`` of all replicates."""
    betas = {r: beta0.copy() for r in reps}
    dev_old = dict.fromkeys(reps, np.inf)
    active, upper, done = list(reps), np.triu_indices(p), {}
    for _ in range(max_iter):
        if not active:
            break
        sums = _replicate_sums(blocks, np.column_stack([betas[r] for r in active]), np.array(active), p)
        still = []
        for rep, vec in zip(active, sums, strict=True):
            xtwx = np.zeros((p, p))
            xtwx[upper] = vec[:-p - 1]
            xtwx += np.triu(xtwx, 1).T
            try:
                keep = find_aliased(xtwx)
                sol = np.zeros(p)
                sol[keep] = np.linalg.solve(xtwx[np.ix_(keep, keep)], vec[-p - 1:-1][keep])
                if not np.isfinite(sol).all():
                    raise np.linalg.LinAlgError("coefficients are not finite")
            except np.linalg.LinAlgError:
                continue
            if abs(vec[-1] - dev_old[rep]) / (abs(vec[-1]) + 0.1) < tol:
                done[rep] = sol
            else:
                still.append(rep)
            dev_old[rep], betas[rep] = vec[-1], sol
        active = still
    return done  # what has not converged by the last step is no replicate either


def bootstrap_fits(fit: GLMFit, df: DataFrame, cluster: str, reps: int = 1000, seed: int = 779,
                   batch: int = 100) -> tuple[dict[int, np.ndarray], DataFrame]:
    """G12 refits: coefficient vectors per replicate (over the fit's kept columns) + multiplicities (rep, cluster, m)."""
    betas, arrays = _fits(fit, df, cluster, reps, seed, batch)
    return betas, cluster_multiplicities(arrays, cluster)


def _fits(fit: GLMFit, df: DataFrame, cluster: str, reps: int, seed: int, batch: int) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Coefficient vectors per replicate and the multiplicity arrays.

    ``batch`` replicates are fitted in step; a task holds some numbers per row of
    a block and replicate of the batch.
    """
    mult = cut_lineage(multiplicity_arrays(df, cluster, reps, seed))
    w = F.col(fit.weight).cast("double") if fit.weight else F.lit(1.0)
    base = (df.where(F.col(fit.y).isNotNull() & (w > 0))
            .select(F.col(cluster), fit.x().alias("__x"), F.col(fit.y).cast("double").alias("__y"), w.alias("__w"))
            .where(complete("__x")))
    p = len(fit.keep)
    blocks = packed(base, cluster, p)
    weighed = mult.withColumnRenamed(cluster, "__c")
    blocks = cut_lineage(blocks.join(weighed, F.col(cluster).eqNullSafe(F.col("__c"))).select("xs", "ys", "ws", "m"))
    out: dict[int, np.ndarray] = {}
    for start in range(0, reps, batch):
        out.update(_batched_irls(blocks, list(range(start, min(reps, start + batch))), fit.beta, p))
    if not out:
        raise RuntimeError(f"no replicate of {reps} could be fitted")
    if len(out) < reps:
        log.warning("interval from %d replicates; %d could not be fitted", len(out), reps - len(out))
    return out, mult


def _curve_sums(base: np.ndarray, rest: np.ndarray, pieces: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sums over rows of 1 / (1 + exp(-(base + (rest * piece) beta))), a row per row of ``pieces``.

    Rows with the same ``rest`` have the same shift at a value, so exp(-base) is
    formed once and only scaled per value; where that could overflow, and where
    hardly a ``rest`` comes twice, every value is computed on its own.
    """
    kinds, at = np.unique(rest, axis=0, return_inverse=True)
    at = at.ravel()
    shift = np.stack([(kinds * piece) @ beta for piece in pieces]) if len(pieces) else np.zeros((0, len(kinds), base.shape[1]))
    out = np.zeros((len(pieces), base.shape[1]))
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=len(kinds)))
    plain = not (np.abs(base).max(initial=0.0) < 300.0 and np.abs(shift).max(initial=0.0) < 300.0)
    for kind, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        for start in range(lo, hi, 64):  # some rows at a time stay in the processor's cache
            part = base[order[start:min(start + 64, hi)]]
            part = part if plain else np.exp(-part)
            for j in range(len(pieces)):
                with np.errstate(over="ignore"):
                    mu = np.exp(-(part + shift[j, kind])) if plain else part * np.exp(-shift[j, kind])
                mu += 1.0
                np.reciprocal(mu, out=mu)
                out[j] += mu.sum(0)
    return out


def bootstrap_curves(spark: SparkSession, fit: GLMFit, df: DataFrame, varnames: Sequence[str],
                     by: Sequence[str], cluster: str, discrete: Sequence[str] = (), reps: int = 1000,
                     grid_n: int = 20, grid_probs: tuple[float, float] = (0.005, 0.995), seed: int = 779,
                     batch: int = 100, level: float = 0.95) -> DataFrame:
    """Population-averaged prediction curves with cluster-bootstrap percentile CIs.

    A continuous variable's grid has evenly spaced quantiles of ``df``, a discrete
    one's all its values. One refit per replicate serves all variables. Each task evaluates a block
    of rows (of one cluster and group) for the point fit, all replicates and all
    grid values (one matrix product per variable with the coefficients of the
    others) and weights it by its cluster's multiplicity in every replicate;
    per-cell sums are added by Spark. Cells are grid values x groups (bounded).
    Output: focal, value, *by, estimate, conf_low, conf_high, n_replicates (those
    of the interval), n_failed (those that could not be fitted).
    """
    probs = list(np.linspace(grid_probs[0], grid_probs[1], grid_n))
    grids: dict[str, list[float]] = {}
    q = df.agg(*[F.percentile(F.col(v).cast("double"), F.array(*[F.lit(float(x)) for x in probs])).alias(v)
                 for v in varnames]).first() if varnames else {}
    for v in varnames:
        grids[v] = list(dict.fromkeys(float(x) for x in q[v]))  # quantiles that agree are one value
    for v in discrete:
        vals = sorted(r[0] for r in df.select(F.col(v)).distinct().collect() if r[0] is not None)
        grids[v] = vals
    betas, mult = _fits(fit, df, cluster, reps, seed, batch)
    ok = sorted(betas)
    # p x (1 + R) coefficients; column 0 is the point fit, for which every cluster counts once
    bmat, used = np.column_stack([fit.beta] + [betas[r] for r in ok]), np.array(ok)
    ncol, p = 1 + len(ok), len(fit.keep)
    weighed = mult.withColumnRenamed(cluster, "__g")

    # A row's design at a value of the focal variable is its other columns as they are, and in the columns of the
    # variable what is left without it times the variable's piece: rows travel once, with both, for all grid values.
    focal, columns, width = [], [], p
    for v in [*varnames, *discrete]:
        split = fit.design.without(v)
        own = [j for j, c in enumerate(fit.keep) if split[c] is not None]
        kind = df.schema[v].dataType if v in discrete else "double"
        values = spark.createDataFrame(list(enumerate(grids[v])), "i int, v double") if kind == "double" else spark.createDataFrame(
            [(i, x) for i, x in enumerate(grids[v])], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
        pieces = (fit.design.piece_values(v, values.withColumnRenamed("v", v), "i")[:, [split[fit.keep[j]][1] for j in own]]
                  if grids[v] and own else np.zeros((len(grids[v]), 0)))
        columns += [split[fit.keep[j]][0] for j in own]
        focal.append((v, np.array(own, dtype=int), np.array([j for j in range(p) if j not in own], dtype=int), width, pieces))
        width += len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i, cell in enumerate(b.column(0).to_pylist()):
                every = _flat(b.column(1)[i:i + 1]).reshape(-1, width)
                m = np.concatenate([[1.0], _flat(b.column(2)[i:i + 1])[used]])
                drew = np.flatnonzero(m)
                for k, (_, own, others, at, pieces) in enumerate(focal):
                    x, rest = every[:, others], every[:, at:at + len(own)]
                    whole = ~(np.isnan(x).any(axis=1) | np.isnan(rest).any(axis=1))
                    if not whole.any():
                        continue
                    x, kind = x[whole], _distinct_columns(x[whole])
                    coef = np.zeros((len(kind[0]), len(drew)))
                    np.add.at(coef, kind[1][kind[1] >= 0], bmat[np.ix_(others[kind[1] >= 0], drew)])
                    mu = np.zeros((len(pieces), ncol))
                    mu[:, drew] = _curve_sums(x[:, kind[0]] @ coef, rest[whole], pieces, bmat[np.ix_(own, drew)])
                    for j in np.flatnonzero(~np.isnan(pieces).any(axis=1)):
                        name = f"{k}\u0001{j}\u0001{cell}"
                        sums[name] = sums.get(name, 0.0) + np.concatenate([mu[j] * m, whole.sum() * m])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["cell", "s"])

    known = F.transform(F.concat(fit.x(), F.array(*columns).cast("array<double>")), lambda c: F.coalesce(c, F.lit(float("nan"))))
    cell = F.concat_ws("\u0001", *[F.col(b).cast("string") for b in by])
    rows = df.select(F.to_json(F.struct(cell.alias("cell"), F.col(cluster).alias("g"))).alias("__key"), known.alias("__x"),
                     F.lit(0.0).alias("__y"), F.lit(1.0).alias("__w"))
    key = F.from_json("__key", f"cell string, g {df.schema[cluster].dataType.simpleString()}")
    blocks = packed(rows, "__key", width).select(key.alias("__key"), "xs")
    cells = (blocks.join(weighed, F.col("__key.g").eqNullSafe(F.col("__g")))
             .select(F.col("__key.cell").alias("cell"), "xs", "m").mapInArrow(run, "cell string, s array<double>"))
    out_rows = []
    for name, vec in vector_sums(cells, "cell", F.col("s")).collect():
        k, j, *parts = name.split("\u0001")
        v, vec = focal[int(k)][0], np.asarray(vec)
        num, den = vec[:ncol], vec[ncol:]
        with np.errstate(invalid="ignore", divide="ignore"):
            est = num / den
        reps_est = est[1:][den[1:] > 0]
        lo, hi = (np.quantile(reps_est, [(1 - level) / 2, 1 - (1 - level) / 2]) if len(reps_est)
                  else (float("nan"), float("nan")))
        out_rows.append((v, _as_value(str(grids[v][int(j)]).lower()), *(parts if by else []), float(est[0]), float(lo), float(hi),
                         len(reps_est), reps - len(ok)))
    schema = ", ".join(["focal string", "value double", *[f"`{b}` string" for b in by],
                        "estimate double", "conf_low double", "conf_high double", "n_replicates int", "n_failed int"])
    return spark.createDataFrame(out_rows, schema)


def _as_value(s: str) -> float:
    if s == "true":
        return 1.0
    if s == "false":
        return 0.0
    return float(s)
