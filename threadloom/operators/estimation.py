"""Logit and least squares with one- and two-way clustered covariance.

Rows never leave the executors: every Newton step is one aggregate of X'WX and
X'(y - p), summed per partition in NumPy and then by Spark, so the driver gets
k x k numbers. Cluster sums of scores are a groupBy (map-side combined, so a hot
cluster is a few rows), and their outer products are summed the same way. The
two-way covariance is V1 + V2 - V12 with the usual small-sample factors. Rows with a
null term or a category outside the design take no part; ``Fit.n`` counts those that do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Design:
    """Terms: column names, ``a:b`` products, and treatment-coded categories (name -> levels, the first left out)."""

    terms: Sequence[str]
    categories: dict[str, Sequence[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        dummies = [f"{c}[{v}]" for c, levels in self.categories.items() for v in list(levels)[1:]]
        return ["Intercept", *self.terms, *dummies]

    def columns(self) -> list[Column]:
        out = [F.lit(1.0)]
        for t in self.terms:
            c = F.lit(1.0)
            for part in t.split(":"):
                c = c * F.col(part).cast("double")
            out.append(c)
        for name, levels in self.categories.items():
            out += [(F.col(name) == v).cast("double") for v in list(levels)[1:]]
        return out

    def vector(self) -> Column:
        return F.array(*self.columns())

    def complete(self) -> Column:
        """True for rows that have every term and, of every category, a level of the design; others take no part."""
        known = [F.coalesce(F.col(name).isin(list(levels)), F.lit(False)) for name, levels in self.categories.items()]
        there = [c.isNotNull() & ~F.isnan(c) for c in self.columns()[1 : 1 + len(self.terms)]]
        out = F.lit(True)
        for c in [*there, *known]:
            out = out & F.coalesce(c, F.lit(False))
        return out


def levels(df: DataFrame, column: str, limit: int = 500) -> list[str]:
    """Distinct values in order; more than ``limit`` are refused, as a category has to be small."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return found


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    log_likelihood: float
    converged: bool
    null_log_likelihood: float = float("nan")

    def table(self) -> list[dict]:
        """term, estimate, se (not a number if the variance is negative), z, p, odds ratio with 95 % interval."""
        var = np.diag(self.covariance)
        se = np.sqrt(np.where(var >= 0, var, np.nan))
        rows = []
        for name, b, s in zip(self.names, self.beta, se):
            z = b / s if s > 0 else float("nan")
            rows.append({"term": name, "estimate": float(b), "se": float(s), "z": float(z), "p": math.erfc(abs(z) / math.sqrt(2)) if z == z else float("nan"), "odds_ratio": math.exp(min(b, 700)), "low": math.exp(min(b - 1.96 * s, 700)) if s == s else float("nan"), "high": math.exp(min(b + 1.96 * s, 700)) if s == s else float("nan")})
        return rows

    def statistics(self) -> dict:
        k = len(self.beta)
        ll, null = float(self.log_likelihood), float(self.null_log_likelihood)
        return {"n": self.n, "log_likelihood": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(max(self.n, 1)) - 2 * ll, "mcfadden": 1 - ll / null if null else float("nan"), "converged": self.converged}


def _sum(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum over partitions of a vector that ``part`` makes of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(pdf)
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def _meat(scores: DataFrame, cluster: Sequence[str], k: int, n: int) -> np.ndarray:
    """Clustered sum of outer products with its small-sample factor."""
    sums = scores.groupBy(*cluster).agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(k)])

    def part(pdf: pd.DataFrame) -> np.ndarray:
        m = pdf[[f"s{j}" for j in range(k)]].to_numpy()
        return np.r_[(m.T @ m).ravel(), len(m)]

    v = _sum(sums, part, k * k + 1)
    g = v[-1]
    return v[:-1].reshape(k, k) * (g / (g - 1) if g > 1 else 1.0) * ((n - 1) / (n - k) if n > k else 1.0)


def _sandwich(rows: DataFrame, bread: np.ndarray, score, clusters: Sequence[str], n: int) -> np.ndarray:
    k = len(bread)
    keys = ", ".join(f"{c} string" for c in clusters)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[list(clusters)].assign(s=list(score(pdf)))

    s = rows.mapInPandas(make, f"{keys}, s array<double>")
    meat = _meat(s, clusters[:1], k, n)
    if len(clusters) > 1:
        meat = meat + _meat(s, clusters[1:2], k, n) - _meat(s, clusters[:2], k, n)
    return bread @ meat @ bread


def _rows(df: DataFrame, design: Design, y: str, clusters: Sequence[str]) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & design.complete()).select(design.vector().alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("string").alias(c) for c in clusters])


def fit_logit(df: DataFrame, design: Design, y: str, clusters: Sequence[str] = (), iterations: int = 50, tolerance: float = 1e-8) -> Fit:
    """Newton maximum likelihood; ``clusters``: none, one or two columns. Keep ``df`` if it is costly: it is read once a step."""
    rows = _rows(df, design, y, clusters)
    k = len(design.names)
    beta, converged, ll, n, mean = np.zeros(k), False, float("nan"), 0, 0.5
    bread = np.zeros((k, k))
    for _ in range(iterations):
        b = beta

        def part(pdf: pd.DataFrame, b=b) -> np.ndarray:
            x, t = _matrix(pdf), pdf["y"].to_numpy()
            p = _sigmoid(x @ b)
            q = np.clip(p, 1e-15, 1 - 1e-15)
            return np.r_[((x.T * (p * (1 - p))) @ x).ravel(), x.T @ (t - p), (t * np.log(q) + (1 - t) * np.log(1 - q)).sum(), len(t), t.sum()]

        v = _sum(rows, part, k * k + k + 3)
        h, g, ll, n = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-3], int(v[-2])
        if not n:
            break
        mean = v[-1] / n
        step = _solve(h, g)
        bread = np.linalg.pinv(h)
        if np.abs(g).max() < tolerance * max(1, n) or np.abs(step).max() < tolerance:
            converged = True
            break
        beta = beta + np.clip(step, -5, 5)
    cov = bread
    if clusters and n:
        b = beta
        cov = _sandwich(rows, bread, lambda pdf: _matrix(pdf) * (pdf["y"].to_numpy() - _sigmoid(_matrix(pdf) @ b))[:, None], clusters, n)
    null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean)) if 0 < mean < 1 else 0.0
    return Fit(design.names, beta, cov, n, float(ll), converged, null)


def fit_ols(df: DataFrame, design: Design, y: str, clusters: Sequence[str] = ()) -> Fit:
    rows = _rows(df, design, y, clusters)
    k = len(design.names)

    def part(pdf: pd.DataFrame) -> np.ndarray:
        x, t = _matrix(pdf), pdf["y"].to_numpy()
        return np.r_[(x.T @ x).ravel(), x.T @ t, t @ t, len(t), t.sum()]

    v = _sum(rows, part, k * k + k + 3)
    h, g, tt, n = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-3], int(v[-2])
    bread = np.linalg.pinv(h)
    beta = bread @ g
    rss = max(tt - beta @ g, 0.0)
    ll = -n / 2 * (math.log(2 * math.pi * max(rss / max(n, 1), 1e-300)) + 1)
    cov = bread * rss / max(n - k, 1)
    if clusters and n:
        cov = _sandwich(rows, bread, lambda pdf: _matrix(pdf) * (pdf["y"].to_numpy() - _matrix(pdf) @ beta)[:, None], clusters, n)
    return Fit(design.names, beta, cov, n, ll, True)


def mean_prediction(df: DataFrame, design: Design, fit: Fit, overrides: dict[str, Column] | None = None) -> tuple[float, np.ndarray]:
    """Average predicted probability of the complete rows with columns overridden, and its gradient."""
    rows = df.withColumns(overrides or {}).filter(design.complete()).select(design.vector().alias("x"))
    k, b = len(design.names), fit.beta

    def part(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf)
        p = _sigmoid(x @ b)
        return np.r_[p.sum(), x.T @ (p * (1 - p)), len(x)]

    v = _sum(rows, part, k + 2)
    n = max(v[-1], 1)
    return v[0] / n, v[1:-1] / n


def contrast(df: DataFrame, design: Design, fit: Fit, scenarios: Sequence[tuple[float, dict[str, Column]]]) -> dict:
    """Weighted sum of average predictions with its delta-method error and 95 % interval."""
    value, grad = 0.0, np.zeros(len(fit.beta))
    for weight, overrides in scenarios:
        p, g = mean_prediction(df, design, fit, overrides)
        value, grad = value + weight * p, grad + weight * g
    var = float(grad @ fit.covariance @ grad)
    se = math.sqrt(var) if var >= 0 else float("nan")
    value = float(value)
    return {"estimate": value, "se": se, "low": value - 1.96 * se, "high": value + 1.96 * se}


def nearest_psd(cov: np.ndarray) -> tuple[np.ndarray, int]:
    """Symmetric, with negative eigenvalues set to 0, and how many there were."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return (vectors * np.maximum(values, 0)) @ vectors.T, int((values < 0).sum())
