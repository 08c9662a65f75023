"""Model design columns (G1, G2) as Spark column expressions.

A design is a list of named column expressions built from the raw columns,
so the same design can be re-evaluated after a counterfactual substitution
(G11) or on resampled data. Factors use treatment contrasts (first level is
the base); an interaction of factors is the product of their indicators over
all non-base level combinations, as R builds ``a*b`` with default contrasts.
Interactions are passed as tuples of variable names; ``star("a", "b")``
expands ``a*b`` into its main effects and interactions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(*names: str) -> list[tuple[str, ...]]:
    """All non-empty subsets of ``names`` in R's term order (by order, then position)."""
    return [c for r in range(1, len(names) + 1) for c in combinations(names, r)]


@dataclass
class Poly2:
    """Orthogonal quadratic basis of one column (R's ``poly(x, 2)``) from its moments."""

    alpha0: float
    alpha1: float
    n: float
    norm1: float
    norm2: float

    def columns(self, x: Column) -> tuple[Column, Column]:
        p1 = x - F.lit(self.alpha0)
        p2 = (x - F.lit(self.alpha1)) * p1 - F.lit(self.norm1 / self.n)
        return p1 / F.lit(np.sqrt(self.norm1)), p2 / F.lit(np.sqrt(self.norm2))


def poly2(df: DataFrame, col: str, weight: str | None = None) -> Poly2:
    """Three-term recurrence coefficients from two aggregations (mean, then central moments).

    ``weight`` gives frequency weights (equal to repeating rows).
    """
    x = F.col(col).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.where(x.isNotNull() & ~F.isnan(x) & w.isNotNull())  # NULL and NaN count nowhere, also not in n
    first = df.agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx")).first()
    n = float(first["n"])
    a0 = float(first["sx"]) / n
    xc = x - F.lit(a0)
    m = df.agg(*[F.sum(w * F.pow(xc, F.lit(k))).alias(f"c{k}") for k in (2, 3, 4)]).first()
    c2, c3, c4 = float(m["c2"]), float(m["c3"]), float(m["c4"])
    n1 = c2
    a1 = (c3 + a0 * c2) / n1          # sum x * P1^2 / n1
    d = a0 - a1                       # x - a1 = P1 + d
    q = n1 / n
    # P2 = P1^2 + d * P1 - q; sum of squares from central moments (sum P1 = 0)
    n2 = c4 + d * d * c2 + q * q * n + 2 * d * c3 - 2 * q * c2
    return Poly2(a0, a1, n, n1, n2)


@dataclass
class Design:
    """Named design columns; ``expr(df_cols)`` rebuilds them as one array column."""

    factors: Mapping[str, Sequence[str]] = field(default_factory=dict)
    numeric: Sequence[str] = ()
    polys: Mapping[str, Poly2] = field(default_factory=dict)
    terms: Sequence[tuple[str, ...]] = ()
    intercept: bool = True
    names: list[str] = field(default_factory=list)
    _cols: list = field(default_factory=list, repr=False)

    def _pieces(self, var: str, overrides: Mapping[str, Column]) -> list[tuple[str, Column]]:
        src = overrides.get(var, F.col(var))
        if var in self.factors:
            levels = list(self.factors[var])
            s = src.cast("string")
            return [(f"{var}{lv}", F.when(s.isNull(), F.lit(None).cast("double")).when(s == F.lit(lv), 1.0)
                     .otherwise(0.0)) for lv in levels[1:]]
        if var in self.polys:
            p1, p2 = self.polys[var].columns(src.cast("double"))
            return [(f"poly({var},2)1", p1), (f"poly({var},2)2", p2)]
        return [(var, src.cast("double"))]

    def build(self, overrides: Mapping[str, Column] | None = None) -> tuple[list[str], list[Column]]:
        overrides = overrides or {}
        names: list[str] = []
        cols: list[Column] = []
        if self.intercept:
            names.append("(Intercept)")
            cols.append(F.lit(1.0))
        for term in self.terms:
            parts = [self._pieces(v, overrides) for v in term]
            for combo in product(*parts):
                names.append(":".join(n for n, _ in combo))
                c = combo[0][1]
                for _, other in combo[1:]:
                    c = c * other
                cols.append(c)
        return names, cols

    def without(self, var: str) -> list[tuple[Column, int] | None]:
        """For every column the product of its other variables and the place of its piece of ``var``; None where ``var`` does not enter."""
        out: list[tuple[Column, int] | None] = [None] if self.intercept else []
        for term in self.terms:
            for combo in product(*[list(enumerate(self._pieces(v, {}))) for v in term]):
                if var not in term:
                    out.append(None)
                    continue
                rest, at = F.lit(1.0), 0
                for v, (i, (_, c)) in zip(term, combo, strict=True):
                    if v == var:
                        at = i
                    else:
                        rest = rest * c
                out.append((rest, at))
        return out

    def piece_values(self, var: str, values: DataFrame, order: str) -> np.ndarray:
        """The pieces of ``var`` at every value of the column ``var`` of ``values`` (few rows), a row each."""
        rows = values.orderBy(order).select(F.array(*[c for _, c in self._pieces(var, {})]).alias("x")).collect()
        return np.array([r["x"] for r in rows], dtype=np.float64)

    def array(self, overrides: Mapping[str, Column] | None = None, keep: Sequence[int] | None = None) -> Column:
        names, cols = self.build(overrides)
        if keep is not None:
            cols = [cols[i] for i in keep]
        return F.array(*cols)

    def column_names(self) -> list[str]:
        return self.build()[0]


def factor_levels(df: DataFrame, col: str, levels: Sequence[str] | None = None) -> list[str]:
    """Levels of a factor: given order, else sorted distinct values (R's default)."""
    if levels is not None:
        return [str(v) for v in levels]
    vals = [r[0] for r in df.select(F.col(col).cast("string")).distinct().collect() if r[0] is not None]
    return sorted(vals)


def make_design(df: DataFrame, terms: Sequence[tuple[str, ...]], factors: Sequence[str] = (),
                levels: Mapping[str, Sequence[str]] | None = None, poly: Sequence[str] = (),
                intercept: bool = True, weight: str | None = None) -> Design:
    """Resolve factor levels and polynomial bases from the data and return a :class:`Design`."""
    levels = dict(levels or {})
    used = {v for t in terms for v in t}
    fac = {f: factor_levels(df, f, levels.get(f)) for f in factors if f in used}
    polys = {p: poly2(df, p, weight) for p in poly if p in used}
    numeric = [v for v in used if v not in fac and v not in polys]
    return Design(fac, numeric, polys, list(terms), intercept)
