"""Distances with parameters: a small neural net, a linear metric, and the adaptive choice among metrics.

Models are small arrays on the driver, fitted on bounded samples of pairs and sent to the rows with the expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators import knn


def custom_distance(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column | str, Column | str], Column]:
    """A distance from any function of two arrays of vectors (n, d) to n numbers; null where a vector is null. One Arrow batch at a time."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        have = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        if len(have):
            x, y = (np.stack([np.asarray(v, float) for v in s.iloc[have]]) for s in (a, b))
            out[have] = np.asarray(f(x, y), float)
        return pd.Series(out)

    return lambda a, b: run(a, b)


@dataclass
class Neural:
    """A net over both vectors side by side: hidden layers with ReLU, then one sigmoid. layers: (weights (out, in), biases)."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = np.concatenate([x, y], axis=1)
        for w, b in self.layers[:-1]:
            h = np.maximum(h @ w.T + b, 0)
        w, b = self.layers[-1]
        return 1 / (1 + np.exp(-(h @ w.T + b)[:, 0]))


def fit_neural(x: np.ndarray, y: np.ndarray, target: np.ndarray, hidden: int = 16, steps: int = 300, rate: float = 0.02, seed: int = 1) -> Neural:
    """Fits the net to targets between 0 and 1 for a bounded sample of pairs, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    z = np.concatenate([x, y], axis=1)
    p = [rng.standard_normal((hidden, z.shape[1])) * (2 / z.shape[1]) ** 0.5, np.zeros(hidden), rng.standard_normal((1, hidden)) * (2 / hidden) ** 0.5, np.zeros(1)]
    m = [(np.zeros_like(q), np.zeros_like(q)) for q in p]
    for t in range(1, steps + 1):
        h = np.maximum(z @ p[0].T + p[1], 0)
        d = (1 / (1 + np.exp(-(h @ p[2].T + p[3])[:, 0])) - target)[:, None] / len(z)
        back = (d @ p[2]) * (h > 0)
        for q, g, (a, b) in zip(p, (back.T @ z, back.sum(axis=0), d.T @ h, d.sum(axis=0)), m, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Neural([(p[0], p[1]), (p[2], p[3])])


def update_metric(m: np.ndarray, near: tuple[np.ndarray, np.ndarray], far: tuple[np.ndarray, np.ndarray], rate: float = 0.01, rounds: int = 5, pull: float = 0.1, push: float = 1.0) -> np.ndarray:
    """M for |Ma - Mb|: pairs that belong together and are farther than `pull` shrink, others nearer than `push` grow, by gradient steps."""
    m = np.array(m, float)
    for _ in range(rounds):
        for (a, b), sign, limit in ((near, -1.0, pull), (far, 1.0, push)):
            if not len(a):
                continue
            gap = a - b
            moved = gap @ m.T
            d = np.sqrt((moved * moved).sum(axis=1))
            on = (d > limit) if sign < 0 else (d < limit)
            if on.any():
                unit = moved[on] / np.maximum(d[on], 1e-12)[:, None]
                m += sign * rate * unit.T @ gap[on] / on.sum()
    return m


@dataclass(frozen=True)
class Figures:
    """Of a table of vectors: share of zeros, mean variance of the components, share of vectors beyond three deviations of the norm, mean distance to the nearest."""

    sparsity: float
    variance: float
    outliers: float
    nearest: float


def figures(rows: DataFrame, asked: DataFrame) -> Figures:
    """asked (query_id, query): the rows whose distance to the nearest other row is taken."""
    x = rows.select(F.posexplode(V.doubles("vector")).alias("i", "x"))
    per = x.groupBy("i").agg(F.var_pop("x").alias("v"), F.avg((F.abs("x") < 1e-12).cast("double")).alias("z")).agg(F.avg("v").alias("v"), F.avg("z").alias("z")).first()
    norms = rows.select(V.magnitude("vector").alias("n"))
    s = norms.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd")).first()
    out = norms.agg(F.avg((F.abs(F.col("n") - s["mean"]) > 3 * s["sd"]).cast("double")).alias("o")).first()["o"]
    near = knn.search(rows, asked, 2).where("id != query_id").groupBy("query_id").agg(F.min("distance").alias("d")).agg(F.avg("d").alias("d")).first()["d"]
    return Figures(float(per["z"] or 0), float(per["v"] or 0), float(out or 0), float(near or 0))


@dataclass(frozen=True)
class Adaptive:
    """A metric, its weight, weights of the components for the blend, and whether near and far distances are stretched."""

    metric: str = "euclidean"
    weight: float = 1.0
    weights: tuple[float, ...] = ()
    locality: bool = False
    nearest: float = 0.0
    p: float = 2.0
    inverse: tuple[tuple[float, ...], ...] = field(default=(), repr=False)

    def distance(self, a: Column | str, b: Column | str) -> Column:
        if self.metric == "minkowski":
            base = V.minkowski(a, b, self.p)
        elif self.metric == "mahalanobis":
            base = V.mahalanobis(a, b, F.lit([list(r) for r in self.inverse]))
        else:
            base = V.distance(a, b, self.metric)
        out = base * self.weight
        if self.weights:
            out = 0.7 * out + 0.3 * V.weighted_euclidean(a, b, F.lit(list(self.weights)))
        if self.locality:
            out = out * F.when(base < 0.5 * self.nearest, 1.2).when(base > 2.0 * self.nearest, 0.8).otherwise(1.0)
        return out


def choose_metric(f: Figures, strategy: str = "distribution", query_sparsity: float = 0.0, dimensions_used: int = 10**9) -> str:
    """cosine for sparse data or queries, Mahalanobis for uneven spread, Manhattan where few components matter, else Euclidean."""
    if strategy == "distribution":
        return "cosine" if f.sparsity > 0.7 else "mahalanobis" if f.variance > 0.5 else "euclidean"
    if strategy == "queries":
        return "cosine" if query_sparsity > 0.6 else "manhattan" if dimensions_used < 100 else "euclidean"
    if strategy == "mixed":
        spread = 0.3 * f.variance
        return "cosine" if 0.3 * f.sparsity + spread + 0.4 * query_sparsity > 0.6 else "mahalanobis" if spread > 0.2 else "euclidean"
    raise ValueError(f"no strategy {strategy!r}")


def metric_weight(metric: str, f: Figures, accuracy: float = 1.0) -> float:
    """How much the metric counts, 0.1 to 2."""
    own = {"euclidean": 1 - f.sparsity, "cosine": (1 + f.sparsity) / 2, "manhattan": (1 + f.outliers) / 2}.get(metric, 1.0)
    return min(max(own * accuracy, 0.1), 2.0)


def candidates(f: Figures) -> list[Adaptive]:
    """The grid of eighteen: three metrics, with and without locality, three exponents."""
    return [Adaptive(m, metric_weight(m, f), (), near, f.nearest, p) for m in ("euclidean", "cosine", "manhattan") for near in (True, False) for p in (2.0, 3.0, 4.0)]


def tune(rows: DataFrame, queries: DataFrame, f: Figures, k: int = 10) -> DataFrame:
    """metric, locality, p, loss: each candidate's 1 - mean NDCG against exact Euclidean, for few queries."""
    exact = knn.search(rows, queries, k)
    grid = candidates(f)
    # The exponent counts for none of the three metrics: candidates that differ in it alone are searched once.
    searched = {(c.metric, c.locality): c for c in grid}
    met = rows.crossJoin(F.broadcast(queries))
    loss = {}
    for key, c in searched.items():
        found = knn.top_k(met.select("query_id", "id", c.distance("query", "vector").alias("distance")), k)
        loss[key] = knn.ndcg(exact, found).agg(F.round(1 - F.avg("ndcg"), 6).alias("loss")).first()["loss"]
    spark = rows.sparkSession
    return spark.createDataFrame([(c.metric, c.locality, c.p, float(loss[c.metric, c.locality])) for c in grid], "metric string, locality boolean, p double, loss double")
