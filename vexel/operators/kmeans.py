"""k-means over (id, vector) tables: Lloyd, mini-batch and incremental, with assignments and quality figures.

Centroids are a small array on the driver (k * dimensions numbers), sent to the rows at each step; the rows' sums come
back as k * dimensions numbers, added up by Spark. Plans don't grow from step to step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.operators.running import running_total


@dataclass
class Result:
    centroids: np.ndarray
    iterations: int
    converged: bool
    inertia: float  # sum of distances
    wcss: float  # sum of squared distances


def centroid_count(n: int) -> int:
    """A list count for n rows: sqrt(n) within 16 and 4096."""
    return int(min(4096, max(16, round(n**0.5))))


def initial(rows: DataFrame, k: int, method: str = "hash", seed: int = 1, sample: int = 10_000) -> np.ndarray:
    """k rows to start from: those whose ids hash lowest, or k-means++ over a bounded sample of these."""
    ranked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k if method == "hash" else max(k, sample))
    x = np.array([r["vector"] for r in ranked.select("vector").collect()], float)
    if method == "hash":
        return x
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    best = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        at = int(rng.choice(len(x), p=best / best.sum())) if best.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(x[at])
        best = np.minimum(best, ((x - x[at]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the lowest of equals) and the squared distance."""
    d = np.stack([((x - m) ** 2).sum(axis=1) for m in c], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists, without nulls, as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def assign(rows: DataFrame, centroids: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, cluster and distance of the rows with a vector, and the columns to keep."""
    now = rows.sparkSession.sparkContext.broadcast(centroids)
    picked = rows.where("vector is not null").select("id", F.col("vector").alias("__vector"), *keep)
    schema = T.StructType([picked.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType()), *(picked.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = nearest(_matrix(batch.column(1)), now.value) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(np.sqrt(d)), *(batch.column(i + 2) for i in range(len(keep)))], names=schema.names)

    return picked.mapInArrow(run, schema)


def step(rows: DataFrame, centroids: np.ndarray, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray]:
    """Weighted sums and weights of each cluster, the sums of distances and of their squares, and the farthest row.

    One job: each task passes on its own sums, one number a row, and its farthest row.
    """
    now = rows.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, far, row = np.zeros(k * size + k + 2), -1.0, np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
            at, d = nearest(x, now.value)
            np.add.at(total[: k * size].reshape(k, size), at, x * w[:, None])
            total[k * size : -2] += np.bincount(at, weights=w, minlength=k)
            total[-2:] += np.sqrt(d).sum(), d.sum()
            if d.max() > far:
                far, row = float(d.max()), x[d.argmax()]
        if far >= 0:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1), pa.int32()), pa.array(np.append(total[cells], far)), pa.array([None] * len(cells) + [row], pa.list_(pa.float64()))], names=["i", "x", "row"])

    part = rows.where("vector is not null").select("vector", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    found = part.mapInArrow(run, "i int, x double, row array<double>").groupBy("i").agg(F.sum("x").alias("x"), F.max_by("row", "x").alias("row")).collect()
    total, far = np.zeros(k * size + k + 2), centroids[0]
    for r in found:
        if r["i"] < 0:
            far = np.array(r["row"])
        else:
            total[r["i"]] = r["x"]
    return total[: k * size].reshape(k, size), total[k * size : -2], float(total[-2]), float(total[-1]), far


def fit(rows: DataFrame, k: int, max_iterations: int = 100, tolerance: float = 1e-4, start: np.ndarray | None = None, method: str = "hash", weight: str | None = None, seed: int = 1) -> Result:
    """Lloyd's iterations until the sum of distances moves by less than the tolerance. An empty cluster takes the farthest row."""
    c = np.array(start, float) if start is not None else initial(rows, k, method, seed)
    before, done, it = float("inf"), False, 0
    inertia = wcss = 0.0
    while it < max_iterations and not done:
        sums, weights, inertia, wcss, far = step(rows, c, weight)
        it += 1
        c = np.where(weights[:, None] > 0, sums / np.where(weights > 0, weights, 1)[:, None], far)
        done = abs(before - inertia) < tolerance
        before = inertia
    return Result(c, it, done, inertia, wcss)


def fit_mini_batch(rows: DataFrame, k: int, iterations: int = 20, fraction: float = 0.1, start: np.ndarray | None = None, seed: int = 1) -> Result:
    """Each iteration moves centroids by 1 / (iteration + 1) towards the means of a sample."""
    c = np.array(start, float) if start is not None else initial(rows, k, seed=seed)
    for it in range(iterations):
        sums, weights, *_ = step(sample_random(rows, fraction, seed + it), c)
        mean = sums / np.where(weights > 0, weights, 1)[:, None]
        c = np.where(weights[:, None] > 0, c + (mean - c) / (it + 1), c)
    _, _, inertia, wcss, _ = step(rows, c)
    return Result(c, iterations, True, inertia, wcss)


def update(centroids: np.ndarray, batch: np.ndarray, rate: float = 0.05) -> np.ndarray:
    """Online learning: each row pulls its nearest centroid towards itself by the rate."""
    c = centroids.copy()
    for x in batch:
        j = int(((c - x) ** 2).sum(axis=1).argmin())
        c[j] += rate * (x - c[j])
    return c


def update_batches(rows: DataFrame, centroids: np.ndarray, batch_of: Column, batches: int, rate: float = 0.05) -> np.ndarray:
    """Micro-batches (0 to batches - 1) one after the other: n rows of a cluster pull its centroid to their mean by 1 - (1 - rate)^n."""
    c = np.array(centroids, float)
    for b in range(batches):
        sums, weights, *_ = step(rows.where(batch_of == b), c)
        mean = sums / np.where(weights > 0, weights, 1)[:, None]
        c = c + (1 - (1 - rate) ** weights)[:, None] * (mean - c)
    return c


def soft_centroids(rows: DataFrame) -> DataFrame:
    """cluster, i, x: means of the vectors weighted by the probabilities (an array) of their clusters."""
    long = rows.select("vector", F.posexplode("probability").alias("cluster", "p")).select("cluster", "p", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    return long.groupBy("cluster", "i").agg((F.sum(F.col("p") * F.col("x")) / F.sum("p")).alias("x"))


def centroid_table(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


def list_statistics(assigned: DataFrame, k: int) -> DataFrame:
    """One row over the k lists, empty ones included: lists, rows, mean, largest, smallest, population variance, rows per list."""
    sizes = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.count("*").alias("lists"), F.sum("n").alias("rows"), F.floor(F.sum("n") / F.count("*")).alias("average"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.var_pop("n").alias("variance"), (F.sum("n") / F.count("*")).alias("density"))


def validate(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """quantization_error (mean squared distance), balance (1 - deviation / mean of sizes), separability, coverage of a clustering."""
    k = len(centroids)
    gaps = [float(np.linalg.norm(centroids[i] - centroids[j])) for i in range(k) for j in range(i)]
    stats = list_statistics(assigned, k).select((1 - F.sqrt("variance") / F.nullif("density", F.lit(0.0))).alias("balance"))
    error = assigned.agg(F.avg(F.col("distance") * F.col("distance")).alias("quantization_error"), (F.count_distinct("cluster") / k).alias("coverage"))
    return error.crossJoin(stats).withColumn("separability", F.lit(min(1.0, min(gaps) / 10) if gaps else 0.0)).select("quantization_error", "balance", "separability", "coverage")


def draw_order(seed: int = 1) -> Column:
    """A number from 0 to 2**48 by a hash of id and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id"))), 1, 12), 16, 10).cast("double")


def sample_random(rows: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """Each row with that probability, by a seeded hash of its id: the same rows in every run and at every partitioning."""
    return rows.where(draw_order(seed) < fraction * 2.0**48)


def sample_reservoir(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows, every set of n as likely: those with the lowest seeded hashes."""
    return rows.orderBy(draw_order(seed), "id").limit(n)


def sample_stratified(assigned: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """Of each cluster the share, and one row at least."""
    w = Window.partitionBy("cluster")
    ranked = assigned.withColumns({"r": F.row_number().over(w.orderBy(draw_order(seed), "id")), "n": F.count("*").over(w)})
    return ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).drop("r", "n")


def sample_coreset(rows: DataFrame, n: int) -> list:
    """Ids of n rows, each the farthest from those before; the first has the smallest id. One pass a row: for small n."""
    chosen = [(r["id"], np.array(r["vector"], float)) for r in rows.where("vector is not null").orderBy("id").limit(1).select("id", "vector").collect()]
    while chosen and len(chosen) < n:
        hit = assign(rows, np.array([v for _, v in chosen]), ("vector",)).orderBy(F.desc("distance"), "id").first()
        if hit is None or hit["distance"] == 0:
            break
        chosen.append((hit["id"], np.array(hit["vector"], float)))
    return [i for i, _ in chosen]


def sample_importance(rows: DataFrame, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n draws with replacement, by weight: id, draws. Each row's count of draws is the number of even marks it covers."""
    total = rows.agg(F.sum(weight)).first()[0] or 0.0
    part = rows.select("id", F.col(weight).cast("double").alias("w"), draw_order(seed).alias("o"))
    ends = running_total(part, "o", "id", "w", "end")
    shift = float(np.random.default_rng(seed).random())
    marks = lambda x: F.floor(x / total * n + shift)
    return ends.select("id", (marks(F.col("end")) - marks(F.col("end") - F.col("w"))).cast("int").alias("draws")).where("draws > 0")


def sample_size(n: int, least: int = 100, move: float = 0.01) -> int:
    """Doubles a sample from `least` until the error 1 / size moves by less than `move`."""
    size = least
    while size < n and 1 / size - 1 / (2 * size) >= move:
        size *= 2
    return min(n, size)
