"""Panel estimators from per-cluster Gram matrices.

The columns of a model are written once. Counts by (cluster, large effect, small effect) tell levels,
clusters and singletons; then one pass over the rows gives, for each group of the large fixed effect,
the count, the means and the centred cross products of (y, X, dummies of the small effect); groups add
up to clusters. The matrices are as wide as the model, however many rows there are, and everything else
- coefficients, clustered standard errors, wild bootstrap, step-down tests, decompositions - is read off
them with numpy. The numbers of clusters, levels and columns bound what the driver holds; all are
checked before the pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.sources.scratch import drop, staged

#: Clusters times squared columns that the driver holds at most (numbers of 8 bytes), levels of an effect whose dummies are columns, and rows of a table of cell means.
MOST_CELLS, MOST_LEVELS, MOST_MEANS = 40_000_000, 2000, 1_000_000
#: Partial sums are added up in so many parts before they meet.
PARTS = 32


def add_design(df: DataFrame, periods: tuple[str, ...] = ("P1", "P2", "P3")) -> tuple[DataFrame, list[str]]:
    """pilot x period and pilot x period x migrant columns, and the two effects' ids."""
    names = []
    for p in periods:
        df = df.withColumn(f"pilot_{p}", ((F.col("pilot") == 1) & (F.col("period") == p)).cast("double")).withColumn(f"pilot_{p}_mig", F.col(f"pilot_{p}") * F.col("migrant"))
        names += [f"pilot_{p}", f"pilot_{p}_mig"]
    return df.withColumn("city_mig", F.concat_ws("_", "city", "migrant")).withColumn("q_mig", F.concat_ws("_", "q", "migrant")), names


def event_design(df: DataFrame, base: int, window: tuple[int, int], time: str = "rel") -> tuple[DataFrame, list[str]]:
    """pilot x quarter columns, by group; far quarters count as the window's ends, the base has none."""
    low, high = window
    at = F.least(F.greatest(F.col(time), F.lit(low)), F.lit(high))
    names = []
    for k in range(low, high + 1):
        if k == base:
            continue
        tag = f"m{-k}" if k < 0 else f"p{k}"
        df = df.withColumn(f"ev_{tag}", ((F.col("pilot") == 1) & (at == k)).cast("double")).withColumn(f"ev_{tag}_mig", F.col(f"ev_{tag}") * F.col("migrant"))
        names += [f"ev_{tag}", f"ev_{tag}_mig"]
    return df.withColumn("city_mig", F.concat_ws("_", "city", "migrant")).withColumn("q_mig", F.concat_ws("_", "q", "migrant")), names


def simple_event_design(df: DataFrame, base: int, window: tuple[int, int], time: str = "rel") -> tuple[DataFrame, list[str]]:
    """As event_design for one group: pilot x quarter columns only."""
    df, names = event_design(df.withColumn("migrant", F.lit(0)), base, window, time)
    return df, [n for n in names if not n.endswith("_mig")]


def without_singletons(cells: DataFrame, effects: tuple[str, ...]) -> DataFrame:
    """Cells (effects, n) of which no level of an effect has one row only; dropping some may leave others alone.

    Up to MOST_MEANS cells are settled by the driver; beyond, each round is a written table.
    """
    if cells.count() <= MOST_MEANS:
        pdf = cells.toPandas()  # bounded just above
        while True:
            lone = np.zeros(len(pdf), dtype=bool)
            for e in effects:
                lone |= (pdf.groupby(e)["n"].transform("sum") == 1).to_numpy()
            if not lone.any():
                return cells.sparkSession.createDataFrame(pdf, cells.schema)
            pdf = pdf[~lone]
    while True:
        before = cells
        for e in effects:
            cells = cells.join(cells.groupBy(e).agg(F.sum("n").alias("_n")).where("_n > 1").select(e), e, "left_semi")
        cells = staged(cells, "cells")
        if cells.count() == before.count():
            return cells


def pack(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype=np.float64).tobytes()


def unpack(b: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float64).reshape(shape)


def merged(a: tuple, b: tuple) -> tuple:
    """Rows, weights, means and centred products of two parts as those of the whole."""
    n, gap = a[1] + b[1], b[2] - a[2]
    return a[0] + b[0], n, a[2] + gap * b[1] / n, a[3] + b[3] + np.outer(gap, gap) * a[1] * b[1] / n


@dataclass
class Grams:
    """names: y first, then the regressors; by_cluster: Gram matrices with both effects taken out of the pooled moments; sizes: rows by cluster."""

    names: list[str]
    clusters: list[str]
    by_cluster: np.ndarray
    sizes: np.ndarray
    absorbed: int
    total: np.ndarray = field(init=False)
    n: int = field(init=False)

    def __post_init__(self):
        self.total = self.by_cluster.sum(axis=0)
        self.n = int(self.sizes.sum())

    def of(self, clusters: np.ndarray) -> Grams:
        """Of some clusters only, by their places."""
        return Grams(self.names, [self.clusters[i] for i in clusters], self.by_cluster[clusters], self.sizes[clusters], self.absorbed)

    def without(self, columns: list[str]) -> Grams:
        """With columns taken out of the pooled moments of all others; dependent ones among them don't matter."""
        out = [self.names.index(c) for c in columns]
        rest = [i for i in range(len(self.names)) if i not in out]
        turn = np.zeros((len(self.names), len(rest)))
        turn[rest, range(len(rest))] = 1
        turn[out] = -np.linalg.pinv(self.total[np.ix_(out, out)], rcond=1e-10, hermitian=True) @ self.total[np.ix_(out, rest)]
        return Grams([self.names[i] for i in rest], self.clusters, turn.T @ self.by_cluster @ turn, self.sizes, self.absorbed + np.linalg.matrix_rank(self.total[np.ix_(out, out)], hermitian=True))


def grams(df: DataFrame, ys: list[str], xs: list[str], large: str, small: str | None, cluster: str, weight: str | None = None, singletons: bool = True) -> Grams:
    """Centred within `large`, which must lie within `cluster`; `small` is partialled out of the pooled Gram exactly.

    Rows with a null in any column are left out, and without `singletons` those that are alone in a level of an effect.
    """
    cols = [*ys, *xs]
    keys = {"_c": cluster, "_l": large} | ({"_s": small} if small else {})
    table = staged(df.select(*[F.col(v).cast("string").alias(k) for k, v in keys.items()], *([F.col(weight).cast("double").alias("_w")] if weight else []), *[F.col(c).cast("double").alias(c) for c in cols]).dropna(), "panel")
    cells = counts = staged(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "cells")
    if not singletons:
        cells = without_singletons(counts, tuple(k for k in keys if k != "_c"))
    counted = cells.agg(F.count_distinct("_c").alias("c"), *([F.count_distinct("_s").alias("s")] if small else [])).first()
    n_levels = counted["s"] if small else 0
    k = len(cols) + n_levels
    if n_levels > MOST_LEVELS or counted["c"] * k * k > MOST_CELLS:
        raise ValueError(f"{counted['c']} clusters of {k} columns, {n_levels} of them levels of {small}, are more than the driver may hold")
    levels = sorted(r[0] for r in cells.select("_s").distinct().collect()) if small else []
    place = {v: len(cols) + i for i, v in enumerate(levels)}
    rows = table if singletons else table.join(cells.select(*keys), list(keys), "left_semi")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple] = {}
        p = len(cols)
        for pdf in batches:
            x, w = pdf[cols].to_numpy(dtype=float), pdf["_w"].to_numpy() if weight else np.ones(len(pdf))
            groups = pdf.groupby(["_c", "_l"]).indices
            if not groups:
                continue
            g = np.empty(len(pdf), dtype=np.int64)
            for i, at in enumerate(groups.values()):
                g[at] = i
            n = np.bincount(g, w)
            means = np.stack([np.bincount(g, w * x[:, j]) for j in range(p)], axis=1) / n[:, None]
            c = x - means[g]
            cw = c * w[:, None]
            if small:
                # dummies are counted and never made: rows have one of them each
                spot = g * n_levels + pdf["_s"].map(place).to_numpy(dtype=np.int64) - p
                add_up = lambda v: np.bincount(spot, v, len(groups) * n_levels).reshape(len(groups), n_levels)  # noqa: B023, E731
                by_level, crossed = add_up(w), np.stack([add_up(cw[:, j]) for j in range(p)], axis=1)
            for i, (key, at) in enumerate(groups.items()):
                mean, gram = np.zeros(k), np.zeros((k, k))
                mean[:p], gram[:p, :p] = means[i], cw[at].T @ c[at]
                if small:
                    mean[p:], gram[:p, p:], gram[p:, :p] = by_level[i] / n[i], crossed[i], crossed[i].T
                    gram[p:, p:] = np.diag(by_level[i]) - np.outer(by_level[i], by_level[i]) / n[i]
                now = len(at), n[i], mean, gram
                held[key] = merged(held[key], now) if key in held else now
        if held:
            yield frame(held, slot=TaskContext.get().partitionId() % PARTS)

    def frame(held: dict, **more) -> pd.DataFrame:
        return pd.DataFrame({"_c": [a for a, _ in held], "_l": [b for _, b in held], "m": [v[0] for v in held.values()], "n": [v[1] for v in held.values()], "mean": [pack(v[2]) for v in held.values()], "gram": [pack(v[3]) for v in held.values()]} | more)

    def together(pdf: pd.DataFrame) -> dict:
        held: dict[tuple[str, str], tuple] = {}
        for c, l, m, n, mean, g in zip(pdf["_c"], pdf["_l"], pdf["m"], pdf["n"], pdf["mean"], pdf["gram"], strict=True):
            now = m, n, unpack(mean, k), unpack(g, k, k)
            held[c, l] = merged(held[c, l], now) if (c, l) in held else now
        return held

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        held = together(pdf).values()
        return pd.DataFrame({"_c": [pdf["_c"].iloc[0]], "m": [sum(v[0] for v in held)], "gram": [pack(sum(v[3] for v in held))]})

    kind = "_c string, _l string, m long, n double, mean binary, gram binary"
    parts = rows.mapInPandas(sums, f"{kind}, slot int").groupBy("_c", "slot").applyInPandas(lambda pdf: frame(together(pdf)), kind)
    got = sorted(parts.groupBy("_c").applyInPandas(whole, "_c string, m long, gram binary").collect())  # bounded just above
    drop(table, counts, cells)
    if not got:
        raise ValueError("no rows without nulls")
    full = np.stack([unpack(r["gram"], k, k) for r in got])
    absorbed = 0
    if levels:
        a, b = full.sum(axis=0)[len(cols) :, len(cols) :], full.sum(axis=0)[len(cols) :, : len(cols)]
        turn = np.vstack([np.eye(len(cols)), -np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b])
        absorbed = int(np.linalg.matrix_rank(a, tol=1e-8 * max(1.0, np.abs(a).max())))
        full = turn.T @ full @ turn
    return Grams(cols, [r["_c"] for r in got], full, np.array([r["m"] for r in got]), absorbed)


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, value = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (value - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    v: np.ndarray
    n: int
    n_clusters: int

    def rows(self) -> list[tuple]:
        """name, coef, se, t, p, n, clusters; p from Student's distribution with one degree of freedom less than clusters."""
        se = np.sqrt(np.diag(self.v))
        return [(name, float(b), float(s), float(b / s), t_two_sided(float(b / s), self.n_clusters - 1), self.n, self.n_clusters) for name, b, s in zip(self.names, self.beta, se, strict=True)]


def independent(gram: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns that earlier ones don't span."""
    keep: list[int] = []
    for j in range(len(gram)):
        rest = gram[j, j]
        if keep:
            b = gram[np.ix_(keep, [j])]
            rest = rest - (b.T @ np.linalg.solve(gram[np.ix_(keep, keep)], b)).item()
        if rest > tol * max(1e-300, gram[j, j]) and gram[j, j] > 0:
            keep.append(j)
    return keep


def ols(g: Grams, y: str, xs: list[str], correction: bool = True) -> Fit:
    """Least squares of y on xs with standard errors by cluster; dependent columns are left out."""
    at = [g.names.index(x) for x in xs]
    keep = independent(g.total[np.ix_(at, at)])
    at, names, iy = [at[i] for i in keep], [xs[i] for i in keep], g.names.index(y)
    a = np.linalg.inv(g.total[np.ix_(at, at)])
    beta = a @ g.total[at, iy]
    scores = g.by_cluster[:, at, iy] - g.by_cluster[:, at][:, :, at] @ beta
    k, c = len(at) + g.absorbed, len(g.clusters)
    ssc = (g.n - 1) / (g.n - k) * c / (c - 1) if correction else 1.0
    return Fit(names, beta, ssc * a @ (scores.T @ scores) @ a, g.n, c)


def triple_diff(panel: DataFrame, y: str = "y", controls: tuple[str, ...] = (), cluster: str = "city") -> Fit:
    """Rows that are alone in a level of an effect don't count."""
    df, names = add_design(panel)
    return ols(grams(df, [y], [*names, *controls], "city_mig", "q_mig", cluster, singletons=False), y, [*names, *controls])


def wald(fit: Fit, rows: list[dict[str, float]]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of sums of coefficients being zero: F with clusters - 1; a row names the coefficients and their weights."""
    r = np.array([[row.get(n, 0.0) for n in fit.names] for row in rows])
    b = r @ fit.beta
    stat = float(b @ np.linalg.solve(r @ fit.v @ r.T, b)) / len(rows)
    df = fit.n_clusters - 1
    return stat, len(rows), beta_share(df / 2, len(rows) / 2, df / (df + len(rows) * stat))


def restricted_t(g: Grams, y: str, xs: list[str], tested: str, signs: np.ndarray) -> tuple[float, np.ndarray]:
    """t of `tested` and its values in the restricted wild cluster bootstrap; signs: draws x clusters.

    Under the restriction y = X0 b0 + u. A draw turns the sign of u by cluster; its X'y is X'X0 b0 plus
    the signed X'u of the clusters, and so are its scores, all from the clusters' Gram matrices.
    """
    fit = ols(g, y, xs)
    names = fit.names
    at, iy, j = [g.names.index(n) for n in names], g.names.index(y), names.index(tested)
    t = fit.beta[j] / math.sqrt(fit.v[j, j])
    a = np.linalg.inv(g.total[np.ix_(at, at)])
    others = [i for i in range(len(at)) if i != j]
    xx, xy = g.by_cluster[:, at][:, :, at], g.by_cluster[:, at, iy]
    tot = g.total[np.ix_(at, at)]
    b0 = np.zeros(len(at))
    if others:
        b0[others] = np.linalg.solve(tot[np.ix_(others, others)], g.total[at, iy][others])
    xu = xy - xx @ b0
    fitted = xx @ b0
    betas = (fitted.sum(axis=0) + signs @ xu) @ a
    k, c = len(at) + g.absorbed, len(g.clusters)
    ssc = (g.n - 1) / (g.n - k) * c / (c - 1)
    out = np.empty(len(signs))
    for i in range(0, len(signs), 256):
        b, s = betas[i : i + 256], signs[i : i + 256]
        scores = fitted[None] + s[:, :, None] * xu[None] - np.einsum("gij,rj->rgi", xx, b)
        out[i : i + 256] = b[:, j] / np.sqrt(ssc * ((scores @ a[j]) ** 2).sum(axis=1))
    return float(t), out


def draws(clusters: list[str], reps: int, seed: int = 42) -> np.ndarray:
    """Rademacher signs, reps x clusters; alike for all hypotheses of the same clusters."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(reps, len(clusters)))


def wild_p(t: float, stars: np.ndarray) -> float:
    return float(np.mean(np.abs(stars) >= abs(t)))


def romano_wolf(ts: list[float], stars: np.ndarray) -> list[float]:
    """Step-down p values; stars: hypotheses x draws. From the largest |t| on, the maximum of what is left counts."""
    order = np.argsort(-np.abs(ts))
    out, most = np.zeros(len(ts)), 0.0
    for i, h in enumerate(order):
        left = np.abs(stars[order[i:]]).max(axis=0)
        most = max(most, float(np.mean(left >= abs(ts[h]))))
        out[h] = most
    return out.tolist()


def gelbach(g: Grams, y: str, base: list[str], added: dict[str, list[str]], focus: str) -> dict[str, float]:
    """How much each group of added controls moves the coefficient of `focus`: the sum of Gamma times beta."""
    extra = [c for cs in added.values() for c in cs]
    full = ols(g, y, [*base, *extra])
    at = [g.names.index(n) for n in base]
    a = np.linalg.inv(g.total[np.ix_(at, at)])
    j = base.index(focus)
    out = {}
    for name, cs in added.items():
        out[name] = float(sum((a @ g.total[at, g.names.index(c)])[j] * full.beta[full.names.index(c)] for c in cs if c in full.names))
    out["total"] = sum(out.values())
    return out


def mde(se: float) -> float:
    """Least effect found with power 0.8 at the 5 % level."""
    return (1.959964 + 0.841621) * se


def lasso(g: Grams, y: str, xs: list[str], penalty: float, sweeps: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the Gram matrix, columns scaled to variance one; penalty in units of the mean cross product."""
    at, iy = [g.names.index(x) for x in xs], g.names.index(y)
    sd = np.sqrt(np.maximum(np.diag(g.total)[at], 1e-300) / g.n)
    q, r = g.total[np.ix_(at, at)] / g.n / np.outer(sd, sd), g.total[at, iy] / g.n / sd
    b = np.zeros(len(at))
    for _ in range(sweeps):
        old = b.copy()
        for j in range(len(b)):
            z = r[j] - q[j] @ b + q[j, j] * b[j]
            b[j] = math.copysign(max(abs(z) - penalty, 0.0), z) / max(q[j, j], 1e-12)
        if np.abs(b - old).max() < tol:
            break
    return b / sd


def folds_of(clusters: list[str], n: int) -> np.ndarray:
    """Fold of each cluster, by a digest of its name, so that reruns and other engines agree."""
    return np.array([int(hashlib.md5(c.encode()).hexdigest()[:8], 16) % n for c in clusters])


def cross_validated(g: Grams, y: str, xs: list[str], folds: int = 5, steps: int = 20, least: float = 1e-3) -> float:
    """The penalty, of a falling series from the least that picks nothing, with the least squared error on left-out clusters.

    Errors of left-out clusters are read off their Gram matrices.
    """
    at, iy = [g.names.index(x) for x in xs], g.names.index(y)
    sd = np.sqrt(np.maximum(np.diag(g.total)[at], 1e-300) / g.n)
    top = float(np.abs(g.total[at, iy] / g.n / sd).max())
    if top <= 0:
        return 0.0
    penalties, fold = top * least ** (np.arange(steps) / (steps - 1)), folds_of(g.clusters, folds)
    error = np.zeros(steps)
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(rest) or not len(own):
            continue
        part, out = g.of(rest), g.by_cluster[own].sum(axis=0)
        for i, penalty in enumerate(penalties):
            b = lasso(part, y, xs, float(penalty), sweeps=200, tol=1e-8)
            error[i] += out[iy, iy] - 2 * b @ out[at, iy] + b @ out[np.ix_(at, at)] @ b
    return float(penalties[int(error.argmin())])


def double_selection(g: Grams, y: str, treat: str, controls: list[str], always: list[str] = (), folds: int = 5, penalty: float | None = None) -> Fit:
    """Controls that a lasso picks for y or for the treatment join the regression; its penalty is cross-validated if none is given.

    Columns of `always` are in every regression and aren't penalised.
    """
    free = g.without(list(always)) if always else g
    picked = set()
    for target in (y, treat):
        least = cross_validated(free, target, controls, folds) if penalty is None else penalty
        picked |= {c for c, b in zip(controls, lasso(free, target, controls, least), strict=True) if b != 0}
    return ols(g, y, [treat, *always, *[c for c in controls if c in picked]])


def dml_plr(g: Grams, y: str, treat: str, controls: list[str], always: list[str] = (), folds: int = 5, inner: int = 3, penalty: float | None = None) -> Fit:
    """Partially linear model with cross-fitting: lasso residuals of y and the treatment, folds of whole clusters.

    Residuals are linear in the columns, so their products within each cluster are read off its Gram matrix.
    """
    g = g.without(list(always)) if always else g
    fold = folds_of(g.clusters, folds)
    iy, it, ix = g.names.index(y), g.names.index(treat), [g.names.index(c) for c in controls]
    vv, vu = np.zeros(len(g.clusters)), np.zeros(len(g.clusters))
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(own) or not len(rest):
            continue
        part = g.of(rest)
        u, v = np.zeros(len(g.names)), np.zeros(len(g.names))
        u[iy], v[it] = 1.0, 1.0
        for target, into in ((y, u), (treat, v)):
            into[ix] = -lasso(part, target, controls, cross_validated(part, target, controls, inner) if penalty is None else penalty)
        vv[own] = np.einsum("i,gij,j->g", v, g.by_cluster[own], v)
        vu[own] = np.einsum("i,gij,j->g", v, g.by_cluster[own], u)
    theta = vu.sum() / vv.sum()
    return Fit([treat], np.array([theta]), np.array([[((vu - theta * vv) ** 2).sum() / vv.sum() ** 2]]), g.n, len(g.clusters))


@dataclass
class Logit:
    """intercept (0 with effects), coefficients of columns, and of the levels of each effect."""

    intercept: float
    columns: dict[str, float]
    effects: dict[str, dict[str, float]]

    def probability(self) -> Column:
        """Levels that weren't met when it was fitted count as the level left out."""
        z = F.lit(self.intercept)
        for x, b in self.columns.items():
            z = z + F.col(x).cast("double") * b
        for e, levels in self.effects.items():
            table = F.create_map(*[F.lit(v) for kv in levels.items() for v in kv])
            z = z + F.coalesce(F.try_element_at(table, F.col(e).cast("string")), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def logit(df: DataFrame, y: str, xs: list[str], effects: tuple[str, ...] = (), rounds: int = 30, tol: float = 1e-8) -> Logit:
    """Maximum likelihood by Newton steps; a step is one pass that sums gradient and Hessian.

    Effects are dummies, of all levels of the first effect and all but the least of the others. Rows
    with nulls don't count. A trace of ridge keeps levels without variation finite.
    """
    table = staged(df.select(F.col(y).cast("double").alias("_y"), *[F.col(e).cast("string").alias(f"_e{i}") for i, e in enumerate(effects)], *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).dropna(), "logit")
    counts = table.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(f"_e{i}").alias(f"e{i}") for i in range(len(effects))]).first()
    if sum(counts[f"e{i}"] for i in range(len(effects))) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    levels = [sorted(r[0] for r in table.select(f"_e{i}").distinct().collect())[min(i, 1) :] for i in range(len(effects))]
    fixed = len(xs) + (not effects)
    starts = np.cumsum([fixed, *map(len, levels)])
    places = [{v: int(s) + j for j, v in enumerate(ls)} for s, ls in zip(starts[:-1], levels, strict=True)]
    k, b = int(starts[-1]), np.zeros(int(starts[-1]))

    def step(b: np.ndarray):
        def sums(batches):
            g, h = np.zeros(k), np.zeros((k, k))
            for pdf in batches:
                z = np.zeros((len(pdf), k))
                if not effects:
                    z[:, 0] = 1.0
                z[:, fixed - len(xs) : fixed] = pdf[[f"_x{i}" for i in range(len(xs))]].to_numpy()
                for i, place in enumerate(places):
                    at = pdf[f"_e{i}"].map(place)
                    some = np.flatnonzero(at.notna())
                    z[some, at.iloc[some].astype(int)] = 1.0
                p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
                g += z.T @ (pdf["_y"].to_numpy() - p)
                h += (z * (p * (1 - p))[:, None]).T @ z
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % PARTS], "g": [pack(g)], "h": [pack(h)]})

        def added(pdf):
            return pd.DataFrame({"g": [pack(sum(unpack(x, k) for x in pdf["g"]))], "h": [pack(sum(unpack(x, k, k) for x in pdf["h"]))]})

        got = table.mapInPandas(sums, "slot int, g binary, h binary").groupBy("slot").applyInPandas(added, "g binary, h binary").collect()  # PARTS rows at most
        return sum(unpack(r["g"], k) for r in got), sum(unpack(r["h"], k, k) for r in got)

    for _ in range(rounds if counts["n"] else 0):
        g, h = step(b)
        move = np.clip(np.linalg.solve(h + 1e-8 * np.eye(k), g), -3, 3)
        b += move
        if np.abs(move).max() < tol:
            break
    drop(table)
    return Logit(0.0 if effects else float(b[0]), dict(zip(xs, b[fixed - len(xs) : fixed].tolist(), strict=True)), {e: {v: float(b[j]) for v, j in place.items()} for e, place in zip(effects, places, strict=True)})


def inverse_probability(df: DataFrame, y: str, xs: list[str], effects: tuple[str, ...] = (), low: float = 0.02) -> DataFrame:
    """df with the fitted probability, clipped to [low, 1], and its inverse as weight."""
    p = logit(df, y, xs, effects).probability()
    return df.withColumn("propensity", F.greatest(F.lit(low), F.least(F.lit(1.0), p))).withColumn("weight", 1 / F.col("propensity"))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def predicted(df: DataFrame, y: str, xs: list[str], on: Column, name: str = "predicted") -> DataFrame:
    """df with the prediction of a least-squares fit with intercept to the rows where `on` holds."""
    used = complete_cases(df.where(on), [y, *xs])
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    row = used.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i + 1)]).first()
    m = np.array([[row[f"s{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return df.withColumn(name, sum((F.col(x).cast("double") * float(c) for x, c in zip(xs, b[1:], strict=True)), F.lit(float(b[0]))))


def publication_rates(cases: DataFrame, court: str, year: str, serial: str) -> DataFrame:
    """court, year, n, highest, rate: distinct serial numbers of a court's year by the greatest one."""
    out = cases.where(F.col(serial).isNotNull()).groupBy(court, year).agg(F.count_distinct(serial).alias("n"), F.max(serial).alias("highest"))
    return out.withColumn("rate", F.least(F.lit(1.0), F.col("n") / F.col("highest")))


def well_covered(df: DataFrame, court: str, covered: Column, before: Column, least: float = 0.5) -> DataFrame:
    """Rows of the courts whose share of covered rows, among those of the earlier time, is `least` or more."""
    good = df.where(before).groupBy(court).agg(F.avg(covered.cast("int")).alias("_share")).where(F.col("_share") >= least).select(court)
    return df.join(good, court, "left_semi")


def shifted(day: Column, years: int) -> Column:
    """The same day some years later; the last of February where there is no 29th."""
    return F.add_months(day, 12 * years)


def version_shares(df: DataFrame, by: str, old: Column, new: Column) -> DataFrame:
    """by, n, shares of rows of both versions whose values are alike within a half, doubled, greater or less."""
    both = df.where(old.isNotNull() & new.isNotNull())
    share = lambda c: F.avg(c.cast("int"))
    return both.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(F.abs(old - new) < 0.5).alias("same"), share(new == 2 * old).alias("doubled"), share(new > old).alias("greater"), share(new < old).alias("less"))


def variants(spark: SparkSession, fits: dict[str, Fit], param: str) -> DataFrame:
    """variant, coef, se, p, n of one coefficient in several fits."""
    rows = [(name, *[r[i] for i in (1, 2, 4, 5)]) for name, fit in fits.items() for r in fit.rows() if r[0] == param]
    return spark.createDataFrame(rows, "variant string, coef double, se double, p double, n long")


def robustness(rows: DataFrame, coef: str = "coef", p: str = "p", level: float = 0.05) -> DataFrame:
    """n_variants, lowest, highest, n_significant, all_same_sign."""
    return rows.agg(F.count(F.lit(1)).alias("n_variants"), F.min(coef).alias("lowest"), F.max(coef).alias("highest"), F.count_if(F.col(p) < level).alias("n_significant"), (F.min(F.signum(coef)) == F.max(F.signum(coef))).alias("all_same_sign"))


def within_slope(df: DataFrame, y: str, x: str, effect: str, cluster: str) -> DataFrame:
    """slope and se of one regressor with one fixed effect, clustered, as one plan without numpy."""
    rows = df.select(F.col(effect).alias("e"), F.col(cluster).alias("c"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna()
    means = rows.groupBy("e").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    centred = rows.join(means, "e").select("c", (F.col("y") - F.col("my")).alias("y"), (F.col("x") - F.col("mx")).alias("x"))
    by_c = centred.groupBy("c").agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count(F.lit(1)).alias("n"))
    tot = by_c.agg(F.sum("xx").alias("sxx"), F.sum("xy").alias("sxy"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    joined = by_c.select("xx", "xy").crossJoin(tot.withColumn("slope", F.col("sxy") / F.col("sxx")))  # one row
    score = F.col("xy") - F.col("slope") * F.col("xx")
    return joined.groupBy("slope", "sxx", "n", "g").agg(F.sum(score * score).alias("meat")).select("slope", (F.sqrt(F.col("meat")) / F.col("sxx") * F.sqrt(F.col("g") / (F.col("g") - 1.0) * (F.col("n") - 1.0) / (F.col("n") - 2.0))).alias("se"), "n", "g")


def cohort_cells(panel: DataFrame) -> DataFrame:
    """city, q, means of both groups and their gap; cities without one of them in a quarter are left out."""
    cells = panel.groupBy("city", "pilot", "q").pivot("migrant", [0, 1]).agg(F.avg("y"))
    return cells.withColumnsRenamed({"0": "local", "1": "mig"}).withColumn("gap", F.col("mig") - F.col("local")).dropna()


def group_time_effects(cells: DataFrame, first_treated: str) -> DataFrame:
    """q, att: the pilots' change of the gap since the last quarter before treatment, less that of the others."""
    base = cells.where(F.col("q") < first_treated).groupBy("city").agg(F.max_by("gap", "q").alias("base"))
    moved = cells.join(base, "city").withColumn("change", F.col("gap") - F.col("base"))
    return moved.groupBy("q").agg((F.avg(F.when(F.col("pilot") == 1, F.col("change"))) - F.avg(F.when(F.col("pilot") == 0, F.col("change")))).alias("att")).dropna()


@dataclass
class Dynamic:
    """Effects by quarters since treatment, and what each city adds to them."""

    events: list[int]
    att: np.ndarray
    n_treated: np.ndarray
    influence: np.ndarray

    def bands(self, reps: int = 999, seed: int = 42, level: float = 0.95) -> tuple[np.ndarray, float]:
        """Standard errors from Rademacher multipliers of the cities, and the critical value of a band over all events."""
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(reps, len(self.influence)))
        moved = signs @ self.influence
        se = moved.std(axis=0, ddof=1)
        return se, float(np.quantile(np.abs(moved / np.where(se > 0, se, np.inf)).max(axis=1), level))


def staggered(cells: DataFrame, first: Column) -> Dynamic:
    """Effects of several adoption dates: each cohort's change of the gap since its last quarter before treatment, less that of the cities not yet treated.

    cells: city, q, gap; first: a city's first treated quarter, null if never. Cohorts count by their
    treated cities at each event time. Cities without a gap in the base quarter or at the time don't count there.
    """
    rows = cells.select("city", "q", "gap", first.alias("first"))
    if rows.count() > MOST_MEANS:
        raise ValueError(f"more than {MOST_MEANS} cells")
    got = rows.toPandas()  # bounded just above
    qs = sorted(got["q"].unique())
    at = {q: i for i, q in enumerate(qs)}
    cities = sorted(got["city"].unique())
    gap = np.full((len(cities), len(qs)), np.nan)
    gap[got["city"].map({c: i for i, c in enumerate(cities)}), got["q"].map(at)] = got["gap"]
    start = got.groupby("city")["first"].first().reindex(cities)
    begins = np.array([len(qs) + 1 if pd.isna(f) else sum(q < f for q in qs) for f in start])
    parts: dict[int, list[tuple[float, int, np.ndarray]]] = {}
    for g in sorted({int(b) for b in begins if 0 < b <= len(qs)}):
        for t in range(len(qs)):
            change = gap[:, t] - gap[:, g - 1]
            seen = ~np.isnan(change)
            own, others = np.flatnonzero(seen & (begins == g)), np.flatnonzero(seen & (begins > max(t, g - 1)) & (begins != g))
            if not len(own) or not len(others) or t == g - 1:
                continue
            up, down = change[own].mean(), change[others].mean()
            inf = np.zeros(len(cities))
            inf[own] = (change[own] - up) / len(own)
            inf[others] = -(change[others] - down) / len(others)
            parts.setdefault(t - g, []).append((up - down, len(own), inf))
    events = sorted(parts)
    weights = [np.array([n for _, n, _ in parts[e]], dtype=float) for e in events]
    att = np.array([w @ [a for a, _, _ in parts[e]] / w.sum() for e, w in zip(events, weights, strict=True)])
    inf = np.array([(w[:, None] * np.array([i for _, _, i in parts[e]])).sum(axis=0) / w.sum() for e, w in zip(events, weights, strict=True)]).reshape(len(events), len(cities)).T
    return Dynamic(events, att, np.array([int(w.sum()) for w in weights]), inf)


def tidy(spark: SparkSession, fit: Fit, digits: int = 8) -> DataFrame:
    rows = [(r[0], *[round(x, digits) for x in r[1:5]], r[5], r[6]) for r in fit.rows()]
    return spark.createDataFrame(rows, "param string, coef double, se double, t double, p double, n long, n_clusters long")
