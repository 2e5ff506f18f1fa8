"""Approximate search: inverted lists (k-means cells) and locality-sensitive hash tables, both as plain tables.

An index is a DataFrame, so it is stored as Parquet (lists as partitions), and a search is an equi-join on list or bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators import kmeans, knn, quantize
from vexel.operators.shared import written

#: How many lists a strategy probes, from k and the number of lists.
STRATEGIES = ("exact", "approximate", "adaptive", "learned", "hybrid", "anytime", "multimodal")


def build_lists(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, vector, the rows' other columns, and list_id, in one pass without a join."""
    others = tuple(c for c in rows.columns if c not in ("id", "list_id", "cluster", "distance"))
    return kmeans.assign(rows, centroids, others).withColumnRenamed("cluster", "list_id").drop("distance")


@dataclass
class ListIndex:
    """Inverted lists: centroids on the driver, rows with list_id as a table."""

    centroids: np.ndarray
    lists: DataFrame

    def save(self, path: str) -> None:
        """Centroids and lists as Parquet; a search of stored lists reads only the probed ones, each a partition."""
        kmeans.centroid_table(self.lists, self.centroids).coalesce(1).write.parquet(f"{path}/centroids")
        self.lists.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/lists")

    def retrained(self, iterations: int = 10) -> ListIndex:
        """Centroids from the rows of all lists, starting at the present ones; every row is assigned anew."""
        rows = self.lists.drop("list_id")
        c = kmeans.fit(rows, len(self.centroids), iterations, start=self.centroids).centroids
        return ListIndex(c, build_lists(rows, c))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, **how) -> DataFrame:
        return search_lists(self.lists, self.centroids, queries, k, probes, **how)


def load_index(spark: SparkSession, path: str) -> ListIndex:
    c = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()
    return ListIndex(np.array([r["centroid"] for r in c], float), spark.read.parquet(f"{path}/lists"))


def train_index(rows: DataFrame, lists: int | None = None, iterations: int = 10, sample: int | None = None, start: np.ndarray | None = None) -> ListIndex:
    """An index of all rows, whose centroids come from all of them or, with `sample`, from about so many, those with the lowest hashes. Needs a row for each list."""
    n = rows.count()
    k = len(start) if start is not None else lists or kmeans.centroid_count(n)
    if n < k:
        raise ValueError(f"{n} rows can't make {k} lists")
    drawn = rows if sample is None or n <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    c = kmeans.fit(drawn, k, iterations, start=start).centroids
    return ListIndex(c, build_lists(rows, c))


def probes_for(strategy: str, lists: int, probes: int) -> int:
    """Exact search probes all lists; the others the configured number, some of them twice that."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    if strategy == "exact":
        return lists
    return min(lists, probes * (2 if strategy in ("learned", "hybrid", "multimodal") else 1))


def difficulty(d: np.ndarray, q: np.ndarray) -> float:
    """How hard a query is, 0 to 1, from its distances to the centroids: spread, ambiguity of the nearest, outlyingness, zeros, entropy."""
    d = np.sort(d)
    mean = d.mean() or 1.0
    spread = 1 - min(1.0, d.std() / mean)
    ambiguity = d[0] / d[1] if len(d) > 1 and d[1] > 0 else 1.0
    outlying = min(1.0, d[0] / mean)
    size = np.linalg.norm(q)
    zeros = float((np.abs(q) <= 1e-6).mean()) if len(q) else 0.0
    p = np.abs(q[q != 0]) / size if size else np.zeros(0)
    entropy = float(-(p * np.log(p)).sum() / np.log(max(2, len(q)))) if len(p) else 0.0
    return float(np.clip(0.25 * spread + 0.25 * ambiguity + 0.2 * outlying + 0.1 * min(1.0, size / 10) + 0.1 * zeros + 0.1 * min(1.0, entropy), 0, 1))


def difficulties(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """query_id, difficulty."""
    now = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        vectors = [np.asarray(q, float) for q in s]
        return pd.Series([difficulty(np.sqrt(((now.value - v) ** 2).sum(axis=1)), v) for v in vectors])

    return queries.where("query is not null").select("query_id", run("query").alias("difficulty"))


def probe_table(queries: DataFrame, centroids: np.ndarray, probes: int, adaptive: bool = False, perturb: int = 0) -> DataFrame:
    """query_id, list_id, query, place (from 1): each query's nearest lists; hard queries probe half as many more, easy ones 0.7 of them.

    With `perturb`, each probed list brings that many lists next to it, by the centroids' distances, behind the query's own.
    """
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2) if perturb else np.zeros((0, 0))
    beside = np.argsort(gaps, axis=1, kind="stable")[:, 1 : perturb + 1] if perturb else None
    now = queries.sparkSession.sparkContext.broadcast((centroids, beside))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, beside = now.value
        for f in frames:
            out = []
            for i, q in zip(f["query_id"], f["query"], strict=True):
                v = np.asarray(q, float)
                d = np.sqrt(((c - v) ** 2).sum(axis=1))
                n = probes
                if adaptive:
                    hard = difficulty(d, v)
                    n = round(probes * (1.5 if hard > 0.8 else 0.7 if hard < 0.2 else 1))
                own = np.argsort(d, kind="stable")[: max(1, min(n, len(d)))].tolist()
                if beside is not None:
                    own = list(dict.fromkeys(own + beside[own].ravel().tolist()))
                out += [(i, j, v.tolist(), place) for place, j in enumerate(own, 1)]
            yield pd.DataFrame(out, columns=["query_id", "list_id", "query", "place"])

    return queries.where("query is not null").select("query_id", "query").mapInPandas(run, f"query_id {kind}, list_id int, query array<double>, place int")


def confidence(k: int, probed: Column, probes: int) -> Column:
    """How sure the k nearest of a sorted array of distances are, 0 to 1: lists probed, candidates, the gap behind the k-th, even distances."""
    d = F.col("near")
    first = F.slice(d, 1, k)
    mean = V.total(first) / k
    spread = F.sqrt(V.total(F.transform(first, lambda x: (x - mean) * (x - mean))) / k) / (mean + 0.001)
    kth, after = F.get(d, F.lit(k - 1)), F.get(d, F.lit(k))
    gap = F.when(F.size(d) > k, F.least(F.lit(1.0), (after - kth) / (kth + 0.001))).otherwise(0.5)
    whole = 0.25 * probed / float(probes) + 0.2 * F.least(F.lit(1.0), F.size(d) / float(5 * k)) + 0.3 * gap + 0.25 * F.greatest(F.lit(0.0), 1.0 - spread)
    return F.when(F.size(d) < k, 0.0).otherwise(F.least(F.lit(1.0), F.pow(whole, 1.5)))


def search_in_rounds(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, least: float = 0.95, metric: str = "euclidean") -> DataFrame:
    """query_id, rank, id, distance, probed: lists are probed in rounds of 1, 1, 2, 4 ...; a query that has 10 k candidates and enough confidence ends.

    The driver sees only how many queries go on; candidates stay in tables, 2 k of each query.
    """
    asked = written(probe_table(queries, centroids, probes))
    going, best, done, upto, ended = asked.select("query_id").distinct(), None, 0, 1, []
    while True:
        now = asked.join(going, "query_id", "left_semi").where((F.col("place") > done) & (F.col("place") <= upto))
        met = lists.select("id", "vector", "list_id").join(now, "list_id").select("query_id", "id", V.distance("query", "vector", metric).alias("distance"))
        seen = met.groupBy("query_id").agg(F.count("*").alias("candidates"))
        if best is not None:
            met = met.unionByName(best.select("query_id", "id", "distance"))
            seen = seen.unionByName(best.select("query_id", "candidates").distinct()).groupBy("query_id").agg(F.sum("candidates").alias("candidates"))
        top = knn.top_k(met, 2 * k).join(seen, "query_id")
        near = top.groupBy("query_id").agg(F.array_sort(F.collect_list("distance")).alias("near"), F.max("candidates").alias("candidates"))
        sure = near.select("query_id", ((F.col("candidates") >= 10 * k) & (confidence(k, F.lit(float(min(upto, probes))), probes) >= least)).alias("sure"))
        top = written(top.join(sure, "query_id"))
        last = upto >= probes
        ended.append(top.where("true" if last else "sure").withColumn("probed", F.lit(min(upto, probes))))
        best = top.where("not sure").drop("rank", "sure")
        going = best.select("query_id").distinct()
        if last or going.limit(1).count() == 0:
            break
        done, upto = upto, min(probes, 2 * upto)
    return reduce(DataFrame.unionByName, ended).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "probed")


def routed_probes(queries: DataFrame, model, probes: int) -> DataFrame:
    """query_id, list_id, query: the lists to which a trained classifier (features to probability) gives the highest probability."""
    shown = model.transform(queries.select("query_id", "query", array_to_vector(V.doubles("query")).alias("features")))
    ranked = F.slice(F.reverse(F.array_sort(F.transform(vector_to_array("probability"), lambda p, i: F.struct(p.alias("p"), (-i).alias("j"))))), 1, probes)
    return shown.select("query_id", V.doubles("query").alias("query"), F.explode(ranked).alias("x")).select("query_id", (-F.col("x.j")).cast("int").alias("list_id"), "query")


def fit_router(lists: DataFrame, centroids: np.ndarray, hidden: int = 16, iterations: int = 30, seed: int = 1):
    """A multilayer perceptron that learns each row's list."""
    labelled = lists.select(array_to_vector(V.doubles("vector")).alias("features"), F.col("list_id").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[centroids.shape[1], hidden, len(centroids)], labelCol="label", maxIter=iterations, seed=seed).fit(labelled)


def probes_needed(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall, probes: how many lists, nearest first, hold that share of each query's exact neighbours."""
    order = probe_table(queries, centroids, len(centroids)).select("query_id", "list_id", "place")
    where = exact.select("query_id", "id").join(lists.select("id", "list_id"), "id").join(order, ["query_id", "list_id"])
    w = Window.partitionBy("query_id")
    ranked = where.select("query_id", "place", (F.row_number().over(w.orderBy("place", "id")) / F.count("*").over(w)).alias("recall"))
    return ranked.groupBy("query_id", "recall").agg(F.max("place").alias("probes"))


def fit_probe_predictor(needed: DataFrame, queries: DataFrame):
    """A regression of the probes on the query and the recall wanted; predict with predicted_probes."""
    rows = needed.join(queries.select("query_id", "query"), "query_id").select(array_to_vector(F.concat(V.doubles("query"), F.array(F.col("recall").cast("double")))).alias("features"), F.col("probes").cast("double").alias("label"))
    return GBTRegressor(maxIter=10, seed=1).fit(rows)


def predicted_probes(model, queries: DataFrame, recall: float, lists: int) -> DataFrame:
    """query_id, probes, from 1 to the number of lists."""
    asked = queries.select("query_id", array_to_vector(F.concat(V.doubles("query"), F.array(F.lit(float(recall))))).alias("features"))
    return model.transform(asked).select("query_id", F.greatest(F.lit(1), F.least(F.lit(lists), F.ceil("prediction").cast("int"))).alias("probes"))


def search_lists(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, strategy: str = "approximate", metric: str = "euclidean", where: Column | None = None, perturb: int = 0) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of the probed lists that meet the condition (which comes before the cut)."""
    asked = probe_table(queries, centroids, probes_for(strategy, len(centroids), probes), strategy == "adaptive", perturb)
    rows = lists.where(where) if where is not None else lists
    met = rows.select("id", "vector", "list_id").join(asked, "list_id")
    return knn.top_k(met.select("query_id", "id", V.distance("query", "vector", metric).alias("distance")), k).select("query_id", "rank", "id", "distance")


def check_lists(lists: DataFrame, k: int) -> DataFrame:
    """check, severity, failures: duplicated ids, missing vectors, unknown lists, one list above ten times the mean."""
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("n"))
    checks = [
        ("duplicate_id", "error", lists.groupBy("id").count().where("count > 1")),
        ("missing_vector", "error", lists.where("vector is null or size(vector) = 0")),
        ("unknown_list", "error", lists.where(f"list_id is null or list_id < 0 or list_id >= {k}")),
        ("large_list", "warning", sizes.crossJoin(sizes.agg((F.sum("n") / k).alias("mean"))).where("n > 10 * mean")),
    ]
    out = None
    for name, severity, bad in checks:
        row = bad.agg(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.count("*").alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out


class Hashes:
    """`tables` hash functions of `bits` bits: spherical (signs of projections), stable (cells of projections) or polytope (nearest axis after rotation)."""

    def __init__(self, dimension: int, tables: int = 32, bits: int = 16, family: str = "spherical", width: float = 1.0, seed: int = 42):
        if family not in ("spherical", "stable", "polytope"):
            raise ValueError(f"no family {family!r}")
        rng = np.random.default_rng(seed)
        self.family, self.bits, self.width, self.tables = family, bits, width, tables
        self.planes = rng.standard_normal((tables, bits, dimension))
        self.shift = rng.random((tables, bits)) * width
        #: Subtracted from each projection.
        self.center = np.zeros((tables, bits))

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) as long."""
        p = np.einsum("tbd,nd->ntb", self.planes, x) - self.center
        if self.family == "spherical":
            return ((p > 0) @ (1 << np.arange(self.bits))).astype(np.int64)
        if self.family == "stable":
            cells = np.floor((p + self.shift) / self.width).astype(np.int64)
            out = np.zeros(cells.shape[:2], np.int64)
            for b in range(self.bits):
                out = out * 1_000_003 + cells[:, :, b]
            return out
        best = np.abs(p).argmax(axis=2)
        return 2 * best + (np.take_along_axis(p, best[:, :, None], 2)[:, :, 0] > 0)

    def probes(self, value: int, radius: int) -> list[int]:
        """The value and those within so many flipped bits."""
        return [value ^ sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(self.bits), r)]


def learned_hashes(rows: DataFrame, tables: int = 4, bits: int = 16, seed: int = 42) -> Hashes:
    """Spherical hashes whose planes follow the data: random rotations of the principal components, so that bits part the rows evenly."""
    p = quantize.pca(rows, bits, whiten=True)
    h = Hashes(p.matrix.shape[1], tables, bits, "spherical", seed=seed)
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((bits, bits)))[0] for _ in range(tables)]
    h.planes = np.stack([t @ p.matrix for t in turns])
    h.center = h.planes @ p.mean
    return h


def hash_table(rows: DataFrame, hashes: Hashes) -> DataFrame:
    """table_id, bucket, id of every row."""
    now = rows.sparkSession.sparkContext.broadcast(hashes)
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                h = now.value.values(np.stack([np.asarray(v, float) for v in f["vector"]]))
                yield pd.DataFrame({"table_id": np.tile(np.arange(h.shape[1]), len(f)), "bucket": h.ravel(), "id": np.repeat(f["id"].to_numpy(), h.shape[1])})

    return rows.where("vector is not null").select("id", "vector").mapInPandas(run, f"table_id int, bucket long, id {kind}")


def search_hashes(table: DataFrame, rows: DataFrame, queries: DataFrame, hashes: Hashes, k: int = 10, radius: int = 0, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, distance: the distinct rows that share a bucket with a query, reranked exactly."""
    asked = hash_table(queries.select(F.col("query_id").alias("id"), F.col("query").alias("vector")), hashes).withColumnRenamed("id", "query_id")
    if radius and hashes.family == "spherical":
        masks = [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(hashes.bits), r)]
        asked = asked.withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("bucket").bitwiseXOR(m))))
    met = table.join(asked, ["table_id", "bucket"]).select("query_id", "id").distinct()
    return knn.rerank(met, rows, queries, k, metric)


def collisions(table: DataFrame, queries: DataFrame, hashes: Hashes) -> DataFrame:
    """query_id, id, similarity: the share of tables in which a row meets the query."""
    asked = hash_table(queries.select(F.col("query_id").alias("id"), F.col("query").alias("vector")), hashes).withColumnRenamed("id", "query_id")
    return table.join(asked, ["table_id", "bucket"]).groupBy("query_id", "id").agg((F.count("*") / hashes.tables).alias("similarity"))


def hash_statistics(table: DataFrame, tables: int, bits: int) -> DataFrame:
    """buckets, non_empty, average, largest, collisions (rows beyond each bucket's first), load_factor."""
    sizes = table.groupBy("table_id", "bucket").agg(F.count("*").alias("n"))
    space = float(tables * 2**bits)
    return sizes.agg(F.lit(space).alias("buckets"), F.count("*").alias("non_empty"), F.avg("n").alias("average"), F.max("n").alias("largest"), F.sum(F.col("n") - 1).alias("collisions"), (F.count("*") / space).alias("load_factor"))
