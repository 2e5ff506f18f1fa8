"""Approximate nearest neighbours by a forest of random-projection trees, searched through one shared priority queue.

1. Equal vectors become one point that keeps its smallest ids (as many as an answer can need), so copies in any number
   cost nothing and none of their answers is lost.
2. The trees are fitted on a bounded sample of the points (`sample`, those whose hash is lowest): each node splits at the
   median of the projection on the difference of two random points. Then every point is dealt to a leaf of each tree.
3. A query walks all trees by one queue, nearest margin first, until the leaves popped hold a share `probe` of the sample,
   counted over all trees together, or `least` sample points.
4. The queries, in blocks of bounded size, are sent to the points, where they lie: a point is a query's candidate if one
   of its leaves is among the query's. Each task keeps the nearest candidates of its points by exact distance in double
   precision, and the tasks' best are merged. So no vector is shuffled, and a crowded leaf burdens no single task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't the
most frequent one (the smaller of two as frequent). Rows that repeat an id and its vector count once. Ties go to the smaller id.
Other columns than id and vector are not read. Without usable vectors, or without queries, the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.session import written


@dataclass
class Forest:
    """Complete binary trees of one depth; node i has children 2i+1 and 2i+2. share: (trees, leaves) of the sample."""

    normals: np.ndarray
    cuts: np.ndarray
    share: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.cuts.shape[1] + 1))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree."""
        out = np.empty((len(x), len(self.cuts)), np.int32)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.cuts.shape[1]
        return out

    def probe(self, q: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, nearest margin first, until their shares add up to wanted."""
        inner = self.cuts.shape[1]
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.cuts))]
        heapq.heapify(queue)
        found, have = [], 0.0
        while queue and have < wanted:
            gap, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[t, node])
                far = 2 * node + 1 + (m <= 0)
                heapq.heappush(queue, (max(gap, abs(m)), t, far))
                node = 2 * node + 1 + (m > 0)
            found.append((t, node - inner))
            have += self.share[t, node - inner]
        return found


def fit(sample: np.ndarray, trees: int, leaf: int, seed: int = 1) -> Forest:
    """Trees whose leaves have at most about `leaf` sample rows each."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
    inner = 2**depth - 1
    normals, cuts = np.zeros((trees, inner, sample.shape[1])), np.zeros((trees, inner))
    share = np.zeros((trees, inner + 1))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            here = rows.pop(node)
            if len(here) > 1:
                a, b = sample[rng.choice(here, 2, replace=False)]
                n = a - b
            else:
                n = rng.standard_normal(sample.shape[1])
            n = n / (np.linalg.norm(n) or 1.0)
            p = sample[here] @ n
            cut = float(np.median(p)) if len(p) else 0.0
            normals[t, node], cuts[t, node] = n, cut
            rows[2 * node + 1], rows[2 * node + 2] = here[p <= cut], here[p > cut]
        for node, here in rows.items():
            share[t, node - inner] = len(here) / max(1, len(sample))
    return Forest(normals, cuts, share)


def usable(vectors: DataFrame, ids: str, column: str) -> DataFrame:
    """id and vector of the rows that can take part."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(column, lambda x: x != 0)
    return vectors.where(F.col(ids).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(ids).cast("long").alias("id"), F.col(column).alias("vector"))


def points(vectors: DataFrame, ids: str, column: str, keep: int) -> tuple[DataFrame, int]:
    """vector, ids: distinct usable vectors with their smallest `keep` ids; and the vectors' length."""
    found = usable(vectors, ids, column)
    size = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = size["n"] if size else 0
    same = found.where(F.size("vector") == length).distinct()
    first = same.withColumn("k", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("k") <= keep)
    return written(first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points"), length


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, ids: str = "vec_id", column: str = "embedding", trees: int = 48, leaf: int = 20, sample: int = 20_000, probe: float = 0.45, least: int = 4000, block: int = 20_000, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among the vectors with another id.

    queries holds ids and column like vectors, and is usually some of their rows. They are asked in blocks of about
    `block` distinct vectors.
    """
    spark = vectors.sparkSession
    base, length = points(vectors, ids, column, k + 1)
    asked = usable(queries, ids, column).where(F.size("vector") == length).withColumnRenamed("id", "query_id").distinct()
    drawn = base.orderBy(F.xxhash64("vector"), "vector").limit(sample).select("vector").toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = fit(np.stack(drawn["vector"].to_numpy()).astype(float), trees, leaf, seed)
    now = spark.sparkContext.broadcast(forest)  # trees * sample / leaf hyperplanes at most
    wanted = max(probe, least / len(drawn))
    width = forest.share.shape[1]

    def ask(frames):
        for f in frames:
            places = [sorted(t * width + x for t, x in now.value.probe(np.asarray(v, float), wanted)) for v in f["vector"]]
            yield f.assign(places=places)

    # Queries with equal vectors are searched once.
    kind = asked.schema["vector"].dataType.simpleString()
    sought = written(asked.select("vector").distinct().withColumn("seek", F.monotonically_increasing_id()), "sought")
    plans = written(sought.repartition(F.col("seek")).mapInPandas(ask, f"vector {kind}, seek long, places array<int>"), "plans")
    blocks = max(1, -(-plans.count() // block))
    near = None
    for b in range(blocks):
        part = plans.where(F.pmod(F.xxhash64("seek"), F.lit(blocks)) == b).toPandas()
        plan = spark.sparkContext.broadcast((part["seek"].to_numpy(), [np.asarray(v, float) for v in part["vector"]], [np.asarray(p) for p in part["places"]]))
        found = base.mapInPandas(_scan(now, plan, width, k), "seek long, vec_id long, score double")
        near = found if near is None else near.unionByName(found)
    # k + 1 ids for each searched vector, since a query's own is one of them.
    best = Window.partitionBy("seek").orderBy("score", "vec_id")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    mine = asked.join(sought, "vector").select("query_id", "seek")
    answers = mine.join(near, "seek").where("vec_id != query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(forest, plan, width: int, k: int):
    """A partition's candidates of every query of a block: those in its leaves, the nearest k + 1 ids by exact distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeks, asked, places = plan.value
        best: list[list[tuple[float, int]]] = [[] for _ in seeks]
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["vector"].to_numpy()).astype(float)
            ids = f["ids"].to_numpy()
            cells = (forest.value.leaves(x) + np.arange(len(forest.value.cuts), dtype=np.int64) * width).ravel()
            order = np.argsort(cells, kind="stable")
            cells, row = cells[order], order // len(forest.value.cuts)
            for n, (q, want) in enumerate(zip(asked, places, strict=True)):
                lo = np.searchsorted(cells, want, "left")
                size = np.searchsorted(cells, want, "right") - lo
                mark = np.zeros(len(x), bool)
                mark[row[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)]] = True
                at = np.flatnonzero(mark)
                d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    close = d <= np.partition(d, k)[k]
                    at, d = at[close], d[close]
                pairs = best[n] + [(s, i) for s, r in zip(d.tolist(), at.tolist(), strict=True) for i in ids[r]]
                best[n] = sorted(pairs)[: k + 1]
        yield pd.DataFrame([(seek, i, s) for seek, pairs in zip(seeks, best, strict=True) for s, i in pairs], columns=["seek", "vec_id", "score"])

    return run
