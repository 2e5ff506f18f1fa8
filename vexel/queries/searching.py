"""Exact and approximate search, joins, reranking, set operations and result figures over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel import plans
from vexel.functions import filters as L
from vexel.functions import vectors as V
from vexel.operators import indexes, knn, learned, quantize
from vexel.operators.shared import scratch

QUERIES: dict = {}
ORACLES: dict = {}

MACRO = "with b as (select vec_id as id, label, cast(embedding as double[]) as v, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(table: DataFrame, n: int = 20) -> DataFrame:
    return table.where(F.col("id") < n).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def six(df: DataFrame) -> DataFrame:
    """Distances to six places, without a negative zero."""
    return df.withColumn("distance", F.coalesce(F.nullif(F.round("distance", 6), F.lit(0.0)), F.lit(0.0)))


def knn_sql(distance: str, k: int, where: str = "true", n: int = 20, columns: str = "query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance") -> str:
    return f"""{MACRO}, d as (select a.id as query_id, b.id as id, {distance} as distance from b as a, b where a.id < {n} and ({where})),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select {columns} from r where rank <= {k}"""


DISTANCES = {
    "euclidean": "list_distance(a.v, b.v)",
    "cosine": "case when a.n = 0 or b.n = 0 then 1 else 1 - list_inner_product(a.v, b.v) / (a.n * b.n) end",
    "dot": "-list_inner_product(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
}


def _exact(metric: str):
    return lambda spark, sf_dir: six(knn.search(rows(spark, sf_dir), asked(rows(spark, sf_dir)), 10, metric))


for _m, _sql in DISTANCES.items():
    QUERIES[f"x1_exact_knn_{_m}"] = _exact(_m)
    ORACLES[f"x1_exact_knn_{_m}"] = knn_sql(_sql, 10)


def x1_exact_knn_cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ten queries, ten nearest by cosine among rows with some labels."""
    table = rows(spark, sf_dir)
    return six(plans.search(table, asked(table, 10), 10, "cosine", where=F.col("label").isin(1, 2, 3)))


def j1_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    return six(knn.pairs(table, asked(table, 3)))


def j2_self_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 50, against all rows."""
    return six(knn.self_matrix(rows(spark, sf_dir), F.col("id") % 50 == 0))


def j4_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    return six(knn.radius(table, asked(table), 1.2))


def fixed_centroids(spark: SparkSession, sf_dir: str, k: int = 8) -> np.ndarray:
    """The vectors with the smallest ids."""
    return np.array([r["vector"] for r in rows(spark, sf_dir).where(F.col("id") < k).orderBy("id").collect()], float)


def x2_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of eight lists probed."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    return six(indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 10, 3))


def x2_inverted_lists_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    return six(indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 5, 3, where=F.col("label") < 5))


def x8_exact_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    return six(indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 10, 3, "exact"))


def x3_adaptive_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    found = indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 10, 4, "adaptive")
    return knn.recall(knn.search(table, asked(table), 10), found)


def x5_query_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How hard each query is, and how many lists it probes under the adaptive strategy."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    probes = indexes.probe_table(asked(table), c, 4, True).groupBy("query_id").agg(F.count("*").alias("probes"))
    return indexes.difficulties(asked(table), c).select("query_id", F.round("difficulty", 6).alias("difficulty")).join(probes, "query_id")


def x3_perturbed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of eight lists probed, each with the list next to it."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    return six(indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 10, 2, perturb=1))


def x4_early_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight lists in rounds; a query ends once its confidence reaches 0.62."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    return six(indexes.search_in_rounds(indexes.build_lists(table, c), c, asked(table), 5, 8, 0.62))


def x17_stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, read again and searched."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    path = f"{scratch(spark)}/index"
    indexes.ListIndex(c, indexes.build_lists(table, c)).save(path)
    return six(indexes.load_index(spark, path).search(asked(table), 10, 3))


def a7_trained_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index trained by one of Lloyd's steps from vectors 0 to 7, written, read again, searched."""
    table = rows(spark, sf_dir)
    path = f"{scratch(spark)}/index"
    indexes.train_index(table, iterations=1, start=fixed_centroids(spark, sf_dir)).save(path)
    return six(indexes.load_index(spark, path).search(asked(table), 10, 3))


def a7_retrained_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retraining for one step assigns every row anew: rows and ids of each list."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    again = indexes.ListIndex(c, indexes.build_lists(table, c)).retrained(1)
    return again.lists.groupBy("list_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def x11_routed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists chosen by a trained classifier: recall of the ten nearest."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    lists = indexes.build_lists(table, c)
    routed = indexes.routed_probes(asked(table), indexes.fit_router(lists, c), 4)
    met = lists.select("id", "vector", "list_id").join(routed, "list_id").select("query_id", "id", V.distance("query", "vector").alias("distance"))
    return knn.recall(knn.search(table, asked(table), 10), knn.top_k(met, 10))


def a6_needed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists, nearest first, hold each share of the exact ten nearest: what the predictor learns."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    n = indexes.probes_needed(indexes.build_lists(table, c), c, asked(table), knn.search(table, asked(table), 10))
    return n.select("query_id", F.round("recall", 6).alias("recall"), "probes")


def a6_predicted_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    known = table.where("id % 5 = 1").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    needed = indexes.probes_needed(indexes.build_lists(table, c), c, known, knn.search(table, known, 10))
    return indexes.predicted_probes(indexes.fit_probe_predictor(needed, known), asked(table), 0.9, len(c))


def x10_learned_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of hashes whose planes follow the principal components."""
    table = rows(spark, sf_dir)
    h = indexes.learned_hashes(table, 16, 8)
    return knn.recall(knn.search(table, asked(table), 10, "cosine"), indexes.search_hashes(indexes.hash_table(table, h), table, asked(table), h, 10, 1))


def m14_planned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive strategy searches lists where the table has more rows than it scans exactly."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    index = plans.Index(indexes.build_lists(table, c), c)
    config = plans.preset("quick", probes=3, exact_up_to=100)
    return six(plans.search(table, asked(table), 10, "euclidean", "adaptive", index=index, config=config))


def c1_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(n, c.dimension, c.lists, c.probes, c.strategy) for n, c in plans.PRESETS.items()]
    return spark.createDataFrame(made, "preset string, dimension int, lists int, probes int, strategy string")


def u2_hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the lists and of the exact search together, once each."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    near = indexes.search_lists(indexes.build_lists(table, c), c, asked(table), 5, 1).select("query_id", "id")
    return near.unionByName(knn.search(table, asked(table), 5, "cosine").select("query_id", "id")).distinct()


def _hashes(family: str) -> indexes.Hashes:
    return indexes.Hashes(64, 16, {"spherical": 8, "stable": 3, "polytope": 16}[family], family, 1.0)


def x9_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, h = rows(spark, sf_dir), _hashes("spherical")
    return six(indexes.search_hashes(indexes.hash_table(table, h), table, asked(table), h, 10, 1))


def x9_hash_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall of each family of hashes."""
    table, out = rows(spark, sf_dir), None
    exact = knn.search(table, asked(table), 10, "cosine")
    for family in ("spherical", "stable", "polytope"):
        h = _hashes(family)
        r = knn.recall(exact, indexes.search_hashes(indexes.hash_table(table, h), table, asked(table), h, 10)).agg(F.lit(family).alias("family"), F.avg("recall").alias("recall"))
        out = r if out is None else out.unionByName(r)
    return out


def x9_collision_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, h = rows(spark, sf_dir), _hashes("spherical")
    return indexes.collisions(indexes.hash_table(table, h), asked(table, 3), h)


def a33_hash_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hashes("spherical")
    return indexes.hash_statistics(indexes.hash_table(rows(spark, sf_dir), h), h.tables, h.bits)


def x12_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest by Manhattan distance, reranked by Euclidean, cut in two stages."""
    table = rows(spark, sf_dir)
    first = knn.search(table, asked(table), 50, "manhattan")
    return six(knn.cascade(knn.rerank(first, table, asked(table), 20), [20, 5]))


def x13_semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    return six(knn.rerank(knn.search(table, asked(table), 30, "euclidean"), table, asked(table), 10, "cosine"))


def x16_list_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.check_lists(indexes.build_lists(rows(spark, sf_dir), fixed_centroids(spark, sf_dir)), 8)


def a28_search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    q = knn.search_quality(knn.search(table, asked(table), 10, "cosine"))
    return q.select("query_id", F.round("relevance", 6).alias("relevance"), F.round("diversity", 6).alias("diversity"))


def a29_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by Manhattan distance, measured against those by Euclidean."""
    table = rows(spark, sf_dir)
    return knn.recall(knn.search(table, asked(table), 10), knn.search(table, asked(table), 10, "manhattan"))


def a30_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    found = knn.ndcg(knn.search(table, asked(table), 10), knn.search(table, asked(table), 10, "manhattan"))
    return found.select("query_id", F.round("ndcg", 6).alias("ndcg"))


def u1_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct candidates of two metrics."""
    table = rows(spark, sf_dir)
    one, two = (knn.search(table, asked(table), 10, m).select("query_id", "id") for m in ("euclidean", "manhattan"))
    return one.unionByName(two).distinct()


def u5_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    one, two = (knn.search(table, asked(table), 10, m).select("query_id", "id") for m in ("euclidean", "manhattan"))
    return one.join(two, ["query_id", "id"], "left_anti")


def t5_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("label = 3").orderBy("id").offset(5).limit(10).select("id", "label")


def _adaptive(spark: SparkSession, sf_dir: str, strategy: str) -> learned.Adaptive:
    table = rows(spark, sf_dir)
    f = learned.figures(table, asked(table))
    metric = learned.choose_metric(f, strategy, dimensions_used=64)
    return learned.Adaptive(metric, learned.metric_weight(metric, f), tuple(float(1 + i % 3) for i in range(1, 65)), True, f.nearest)


def v19_adaptive_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric chosen from the table's figures, weighted, blended with a weighted Euclidean one, and stretched by locality."""
    table, found = rows(spark, sf_dir), None
    for strategy in ("distribution", "queries"):
        a = _adaptive(spark, sf_dir, strategy)
        d = table.crossJoin(F.broadcast(asked(table, 5))).select("query_id", "id", a.distance("query", "vector").alias("distance"))
        top = knn.top_k(d, 5).select(F.lit(strategy).alias("strategy"), F.lit(a.metric).alias("metric"), "query_id", "rank", "id", "distance")
        found = top if found is None else found.unionByName(top)
    return six(found)


def v20_metric_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the eighteen candidates' loss: 1 - mean NDCG@10 against exact Euclidean."""
    table = rows(spark, sf_dir)
    return learned.tune(table, asked(table, 10), learned.figures(table, asked(table)))


#: A net whose weights follow a rule that SQL can state.
def rule_net() -> learned.Neural:
    i, j = np.arange(128)[None, :], np.arange(6)[:, None]
    return learned.Neural([(((7 * i + 3 * j) % 11 - 5) / 20.0, np.full(6, 0.05)), ((np.arange(6)[None, :] % 3 - 0.8), np.array([0.1]))])


def v16_neural_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    d = learned.custom_distance(rule_net())
    found = table.crossJoin(F.broadcast(asked(table, 3))).select("query_id", "id", d("query", "vector").alias("distance"))
    return six(found)


def v16_fitted_neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A net fitted to tell whether two vectors have one label, on at most 4,000 pairs; its share of right answers on all pairs of ten queries."""
    table = rows(spark, sf_dir)
    sample = table.orderBy("id").limit(90).select("vector", "label").collect()
    x = np.array([r["vector"] for r in sample], float)
    y = np.array([r["label"] for r in sample])
    i, j = np.triu_indices(len(x), 1)
    net = learned.fit_neural(x[i], x[j], (y[i] != y[j]).astype(float))
    d = learned.custom_distance(net)
    both = table.crossJoin(F.broadcast(table.where("id < 10").select(F.col("vector").alias("query"), F.col("label").alias("own"))))
    return both.agg(F.avg(((d("query", "vector") > 0.5) == (F.col("label") != F.col("own"))).cast("double")).alias("right"))


def v18_metric_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of vectors 0 to 9 to the others of their label, and to the rest, before and after pulling and pushing."""
    table = rows(spark, sf_dir)
    own = table.where("id < 100").orderBy("id").collect()
    x, y = np.array([r["vector"] for r in own], float), np.array([r["label"] for r in own])
    i, j = np.triu_indices(len(x), 1)
    near, far = y[i] == y[j], y[i] != y[j]
    start = np.eye(16, x.shape[1])
    m = learned.update_metric(start, (x[i[near]], x[j[near]]), (x[i[far]], x[j[far]]), 0.05, 20)
    both = table.crossJoin(F.broadcast(table.where("id < 10").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("label").alias("own")))).where("id != query_id")
    mean = lambda a: F.avg(V.matrix_metric("query", "vector", F.lit([[float(v) for v in r] for r in a])))
    return both.groupBy((F.col("label") == F.col("own")).alias("same")).agg(mean(start).alias("before"), mean(m).alias("after"))


def v18_matrix_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.lit([[float(x) for x in r] for r in quantize.random_projection(64, 8).matrix])
    table = rows(spark, sf_dir)
    found = table.crossJoin(F.broadcast(asked(table, 3))).select("query_id", "id", V.matrix_metric("query", "vector", m).alias("distance"))
    return six(knn.top_k(found, 5))


def l20_fused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest to the blend of each query with vector 0."""
    table = rows(spark, sf_dir)
    zero = table.where("id = 0").select(F.col("vector").alias("z"))
    blended = asked(table, 5).crossJoin(zero).select("query_id", F.zip_with(V.doubles("query"), V.doubles("z"), lambda a, b: 0.7 * a + 0.3 * b).alias("query"))
    return six(knn.search(table, blended, 5))


def f14_batch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter tree over typed columns, before the cut to k."""
    table = rows(spark, sf_dir)
    tree = L.Every((L.Where("label", "ge", 2), L.Not((L.Where("label", "equals", 7),))))
    return six(knn.search(table, asked(table, 5), 5, where=L.compile_filter(tree, metadata=None, mode="typed")))


FUNCTIONS = (m14_planned_search, c1_presets, x3_perturbed_probes, x4_early_termination, x17_stored_lists, a7_trained_lists, a7_retrained_lists, x11_routed_lists, a6_needed_probes, a6_predicted_probes, x10_learned_hashes, u2_hybrid_union, v16_neural_distance, v16_fitted_neural, v18_metric_update, x1_exact_knn_cosine_filtered, j1_distance_join, j2_self_matrix, j4_radius_join, x2_inverted_lists, x2_inverted_lists_filtered, x8_exact_strategy, x3_adaptive_probes, x5_query_difficulty, x9_hash_search, x9_hash_families, x9_collision_similarity, a33_hash_statistics, x12_rerank, x13_semantic_rerank, x16_list_checks, a28_search_quality, a29_recall, a30_ndcg, u1_candidate_union, u5_except, t5_limit_offset, v19_adaptive_metric, v20_metric_tuning, v18_matrix_metric, l20_fused_vectors, f14_batch_filter)
QUERIES |= {f.__name__: f for f in FUNCTIONS}

EUC, L1, CO = DISTANCES["euclidean"], DISTANCES["manhattan"], DISTANCES["cosine"]
ORACLES["x1_exact_knn_cosine_filtered"] = knn_sql(CO, 10, "b.label in (1, 2, 3)", 10)
ORACLES["j1_distance_join"] = f"{MACRO} select a.id as query_id, b.id as id, coalesce(nullif(round({EUC}, 6), 0), 0) as distance from b as a, b where a.id < 3"
ORACLES["j2_self_matrix"] = f"{MACRO} select a.id as a, b.id as b, coalesce(nullif(round({EUC}, 6), 0), 0) as distance from b as a, b where a.id % 50 = 0"
ORACLES["j4_radius_join"] = f"{MACRO} select a.id as query_id, b.id as id, coalesce(nullif(round({EUC}, 6), 0), 0) as distance from b as a, b where a.id < 20 and {EUC} <= 1.2"
#: Each vector's list is its nearest of vectors 0 to 7; each query probes its three nearest.
LISTS = f"""{MACRO}, cd as (select a.id as id, b.id as list_id, row_number() over (partition by a.id order by {EUC}, b.id) as place from b as a, b where b.id < 8),
probed as (select p.id as query_id, l.id as id from cd p join cd l using (list_id) where l.place = 1 and p.place <= {{probes}} and p.id < 20),
d as (select p.query_id, p.id, {EUC} as distance from probed p join b as a on a.id = p.query_id join b on b.id = p.id where {{where}}),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= {{k}}"""
ORACLES["x2_inverted_lists"] = LISTS.format(probes=3, where="true", k=10)
ORACLES["x2_inverted_lists_filtered"] = LISTS.format(probes=3, where="b.label < 5", k=5)
ORACLES["x8_exact_strategy"] = knn_sql(EUC, 10)
ORACLES["x12_rerank"] = f"""{MACRO}, f as (select a.id as query_id, b.id, {EUC} as distance, row_number() over (partition by a.id order by {L1}, b.id) as first from b as a, b where a.id < 20),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from f where first <= 50) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 5"""
ORACLES["x13_semantic_rerank"] = f"""{MACRO}, f as (select a.id as query_id, b.id, {CO} as distance, row_number() over (partition by a.id order by {EUC}, b.id) as first from b as a, b where a.id < 20),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from f where first <= 30) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 10"""
ORACLES["x16_list_checks"] = f"""{MACRO}, cd as (select a.id as id, b.id as list_id, row_number() over (partition by a.id order by {EUC}, b.id) as place from b as a, b where b.id < 8),
sizes as (select list_id, count(*) as n from cd where place = 1 group by 1)
select 'duplicate_id' as "check", 'error' as severity, count(*) as failures from (select id from b group by 1 having count(*) > 1) union all
select 'missing_vector', 'error', count(*) from b where v is null or len(v) = 0 union all select 'unknown_list', 'error', 0 union all
select 'large_list', 'warning', count(*) from sizes where n > 10 * (select sum(n) / 8 from sizes)"""
TWO = f"""{MACRO}, e as (select a.id as query_id, b.id, row_number() over (partition by a.id order by {EUC}, b.id) as r1, row_number() over (partition by a.id order by {L1}, b.id) as r2 from b as a, b where a.id < 20)"""
ORACLES["a28_search_quality"] = f"""with k as ({knn_sql(CO, 10, columns='query_id, rank, distance')}),
g as (select x.query_id, y.distance - x.distance as gap from k x join k y on x.query_id = y.query_id and y.rank > x.rank and y.rank <= x.rank + 4)
select query_id, round(1 - min(distance), 6) as relevance, round(coalesce((select avg(abs(gap)) from g where g.query_id = k.query_id), 0), 6) as diversity from k group by query_id"""
ORACLES["a29_recall"] = f"{TWO}, h as (select query_id, count(*) filter (r1 <= 10 and r2 <= 10) / 10.0 as h from e group by 1) select query_id, h as recall, h as precision, h as f1 from h"
ORACLES["a30_ndcg"] = f"{TWO} select query_id, round(sum(case when r1 <= 10 and r2 <= 10 then (1.0 / r1) / log2(r2 + 1) else 0 end) / sum(case when r1 <= 10 then (1.0 / r1) / log2(r1 + 1) else 0 end), 6) as ndcg from e group by 1"
ORACLES["u1_candidate_union"] = f"{TWO} select query_id, id from e where r1 <= 10 or r2 <= 10"
ORACLES["u5_except"] = f"{TWO} select query_id, id from e where r1 <= 10 and r2 > 10"
ORACLES["t5_limit_offset"] = "select vec_id as id, label from embeddings where label = 3 order by vec_id limit 10 offset 5"
ORACLES["l20_fused_vectors"] = f"""{MACRO}, q as (select a.id as query_id, list_transform(list_zip(a.v, z.v), lambda p: 0.7 * p[1] + 0.3 * p[2]) as v from b as a, b as z where z.id = 0 and a.id < 5),
d as (select query_id, b.id, list_distance(q.v, b.v) as distance from q, b), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d)
select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 5"""
ORACLES["f14_batch_filter"] = knn_sql(EUC, 5, "b.label >= 2 and b.label <> 7", 5)


def _values(m: np.ndarray, names: str) -> str:
    """An array as rows (its indexes, value)."""
    cells = ", ".join(f"({', '.join(map(str, at))}, {float(x)!r})" for at, x in np.ndenumerate(m))
    return f"(values {cells}) as m({names})"


LISTED = LISTS.split("probed as")[0]
ORACLES["x5_query_difficulty"] = f"""{LISTED} c as (select p.id as query_id, list_sort(list(list_distance(p.v, l.v))) as d, any_value(p.v) as v, any_value(p.n) as n from b p, b l where p.id < 20 and l.id < 8 group by 1),
s as (select *, list_avg(d) as mean, list_stddev_pop(d) as sd, list_transform(list_filter(v, lambda x: x <> 0), lambda x: abs(x) / n) as p from c),
f as (select query_id, least(1, greatest(0, 0.25 * (1 - least(1, sd / mean)) + 0.25 * (case when d[2] > 0 then d[1] / d[2] else 1 end) + 0.2 * least(1, d[1] / mean) + 0.1 * least(1, n / 10)
  + 0.1 * len(list_filter(v, lambda x: abs(x) <= 1e-6)) / len(v) + 0.1 * least(1, -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(v))))) as h from s)
select query_id, round(h, 6) as difficulty, cast(case when h > 0.8 then 6 when h < 0.2 then 3 else 4 end as bigint) as probes from f"""
ORACLES["x3_perturbed_probes"] = f"""{LISTED} beside as (select a.id as list_id, b.id as other, row_number() over (partition by a.id order by {EUC}, b.id) as place from b as a, b where a.id < 8 and b.id < 8 and a.id <> b.id),
own as (select id as query_id, list_id from cd where place <= 2 and id < 20), lists as (select * from own union select query_id, other from own join beside using (list_id) where place = 1),
d as (select query_id, b.id, {EUC} as distance from lists p join cd l on l.list_id = p.list_id and l.place = 1 join b as a on a.id = p.query_id join b on b.id = l.id),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 10"""
_ROUND = """d{n} as (select p.query_id, p.id, {euc} as distance from (select p.id as query_id, l.id as id from cd p join cd l using (list_id) where l.place = 1 and p.place <= {n} and p.id < 20) p join b as a on a.id = p.query_id join b on b.id = p.id),
k{n} as (select query_id, count(*) as candidates, list_slice(list_sort(list(distance)), 1, 10) as d from d{n} group by 1),
m{n} as (select *, list_avg(list_slice(d, 1, 5)) as mean, list_stddev_pop(list_slice(d, 1, 5)) as sd from k{n}),
s{n} as (select query_id, candidates >= 50 and len(d) >= 5 and least(1, pow(0.25 * {n} / 8 + 0.2 * least(1, len(d) / 25.0) + 0.3 * (case when len(d) > 5 then least(1, (d[6] - d[5]) / (d[5] + 0.001)) else 0.5 end) + 0.25 * greatest(0, 1 - sd / (mean + 0.001)), 1.5)) >= 0.62 as sure from m{n})"""
_ENDS = "select query_id, case when coalesce((select sure from s1 where s1.query_id = q.query_id), false) then 1 when coalesce((select sure from s2 where s2.query_id = q.query_id), false) then 2 when coalesce((select sure from s4 where s4.query_id = q.query_id), false) then 4 else 8 end as probed from (select id as query_id from b where id < 20) q"
ORACLES["x4_early_termination"] = LISTED + ", ".join(_ROUND.format(n=n, euc=EUC) for n in (1, 2, 4, 8)) + f", e as ({_ENDS}), a_ as (select 1 as probed, * from d1 union all select 2, * from d2 union all select 4, * from d4 union all select 8, * from d8), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from a_ join e using (query_id, probed)) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance, cast(probed as int) as probed from r where rank <= 5"
ORACLES["x17_stored_lists"] = ORACLES["x2_inverted_lists"]
#: Lists around the means of the first cells.
TRAINED = f"""{MACRO}, cd0 as (select a.id as id, b.id as list_id, row_number() over (partition by a.id order by {EUC}, b.id) as place from b as a, b where b.id < 8),
long as (select id, generate_subscripts(v, 1) as i, unnest(v) as x from b), mean as (select list_id, i, avg(x) as x from cd0 join long using (id) where place = 1 group by 1, 2), c as (select list_id, list(x order by i) as v from mean group by 1),
cd as (select b.id, c.list_id, row_number() over (partition by b.id order by list_distance(b.v, c.v), c.list_id) as place from b, c)"""
ORACLES["a7_trained_lists"] = f"""{TRAINED}, probed as{LISTS.split("probed as")[1].format(probes=3, where="true", k=10)}"""
ORACLES["a7_retrained_lists"] = f"{TRAINED} select cast(list_id as int) as list_id, count(*) as n, cast(sum(id) as bigint) as ids from cd where place = 1 group by 1"
ORACLES["a6_needed_probes"] = f"""{LISTED} e as (select a.id as query_id, b.id, row_number() over (partition by a.id order by {EUC}, b.id) as rank from b as a, b where a.id < 20),
w as (select e.query_id, e.id, p.place from e join cd l on l.id = e.id and l.place = 1 join cd p on p.id = e.query_id and p.list_id = l.list_id where rank <= 10),
r as (select query_id, place, row_number() over (partition by query_id order by place, id) / 10.0 as recall from w) select query_id, round(recall, 6) as recall, cast(place as int) as probes from r"""
ORACLES["u2_hybrid_union"] = f"""select query_id, id from ({LISTS.format(probes=1, where="true", k=5)}) union select query_id, id from ({knn_sql(CO, 5)})"""
_FIG = f"""{MACRO}, long as (select id, generate_subscripts(v, 1) as i, unnest(v) as x from b), dim as (select i, var_pop(x) as v, avg(case when abs(x) < 1e-12 then 1.0 else 0 end) as z from long group by 1),
nn as (select a.id, min({EUC}) as d from b as a, b where a.id < 20 and a.id <> b.id group by 1), fig as (select (select avg(z) from dim) as sparsity, (select avg(v) from dim) as variance, (select avg(d) from nn) as nearest,
  (select avg(case when abs(n - m) > 3 * s then 1.0 else 0 end) from b, (select avg(n) as m, stddev_pop(n) as s from b)) as outliers)"""
#: On these tables the figures choose Euclidean by distribution, and Manhattan where few components matter.
ORACLES["v19_adaptive_metric"] = f"""{_FIG}, w as (select a.id as query_id, b.id, {EUC} as e, {L1} as m, sqrt(list_sum(list_transform(list_zip(a.v, b.v, range(1, 65)), lambda z: (1 + z[3] % 3) * (z[1] - z[2]) * (z[1] - z[2])))) as weighted from b as a, b where a.id < 5),
d as (select 'distribution' as strategy, 'euclidean' as metric, query_id, id, e as base, greatest(0.1, 1 - sparsity) as weight, weighted, nearest from w, fig where sparsity <= 0.7 and variance <= 0.5
  union all select 'queries', 'manhattan', query_id, id, m, greatest(0.1, (1 + outliers) / 2), weighted, nearest from w, fig),
f as (select strategy, metric, query_id, id, (0.7 * base * weight + 0.3 * weighted) * case when base < 0.5 * nearest then 1.2 when base > 2 * nearest then 0.8 else 1 end as distance from d),
r as (select *, row_number() over (partition by strategy, query_id order by distance, id) as rank from f) select strategy, metric, query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 5"""
_GRID = " union all ".join(f"select '{m}' as metric, {str(near).lower()} as locality, query_id, id, {d} * {w}" + (f" * case when {d} < 0.5 * nearest then 1.2 when {d} > 2 * nearest then 0.8 else 1 end" if near else "") + " as distance from w, fig" for m, d, w in (("euclidean", "e", "(1 - sparsity)"), ("cosine", "c", "((1 + sparsity) / 2)"), ("manhattan", "m", "((1 + outliers) / 2)")) for near in (True, False))
ORACLES["v20_metric_tuning"] = f"""{_FIG}, w as (select a.id as query_id, b.id, {EUC} as e, {L1} as m, {CO} as c from b as a, b where a.id < 10), x as (select query_id, id, row_number() over (partition by query_id order by e, id) as r1 from w), g as ({_GRID}),
r as (select *, row_number() over (partition by metric, locality, query_id order by distance, id) as r2 from g),
n as (select metric, locality, query_id, sum(case when r1 <= 10 and r2 <= 10 then (1.0 / r1) / log2(r2 + 1) else 0 end) / sum(case when r1 <= 10 then (1.0 / r1) / log2(r1 + 1) else 0 end) as ndcg from r join x using (query_id, id) group by 1, 2, 3)
select metric, locality, p, round(1 - avg(ndcg), 6) as loss from n, (values (2.0::double), (3.0), (4.0)) as t(p) group by 1, 2, 3"""
ORACLES["v16_neural_distance"] = f"""{MACRO}, z as (select a.id as query_id, b.id, list_concat(a.v, b.v) as z from b as a, b where a.id < 3),
h as (select query_id, id, j, greatest(0, 0.05 + list_sum(list_transform(list_zip(z, range(128)), lambda t: t[1] * ((7 * t[2] + 3 * j) % 11 - 5) / 20.0))) as h from z, range(6) as r(j))
select query_id, id, round(1 / (1 + exp(-(0.1 + sum(h * (j % 3 - 0.8))))), 6) as distance from h group by 1, 2"""
ORACLES["v18_matrix_metric"] = f"""{MACRO}, m as (select * from {_values(quantize.random_projection(64, 8).matrix, 'i, j, x')}), g as (select a.id as query_id, b.id, list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2]) as d from b as a, b where a.id < 3),
p as (select query_id, id, i, sum(x * d[j + 1]) as y from g, m group by 1, 2, 3), d as (select query_id, id, sqrt(sum(y * y)) as distance from p group by 1, 2),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 5"""
#: Buckets of the eight signs of each of sixteen tables' projections.
_SIGNS = f"""{MACRO}, m as (select * from {_values(_hashes('spherical').planes, 't, k, j, x')}), long as (select id, generate_subscripts(v, 1) - 1 as j, unnest(v) as x from b),
p as (select id, t, k, sum(m.x * long.x) > 0 as s from long join m using (j) group by 1, 2, 3), h as (select id, t, sum(case when s then 1 << k else 0 end) as bucket from p group by 1, 2)"""
ORACLES["x9_collision_similarity"] = f"{_SIGNS} select q.id as query_id, h.id, count(*) / 16.0 as similarity from h q join h using (t, bucket) where q.id < 3 group by 1, 2"
ORACLES["a33_hash_statistics"] = f"{_SIGNS}, n as (select t, bucket, count(*) as n from h group by 1, 2) select 4096.0 as buckets, count(*) as non_empty, avg(n) as average, max(n) as largest, cast(sum(n - 1) as bigint) as collisions, count(*) / 4096.0 as load_factor from n"
ORACLES["x9_hash_search"] = f"""{_SIGNS}, c as (select distinct q.id as query_id, h.id from h q join h on h.t = q.t and bit_count(cast(xor(cast(q.bucket as bigint), cast(h.bucket as bigint)) as bigint)) <= 1 where q.id < 20),
d as (select query_id, c.id, {CO} as distance from c join b as a on a.id = query_id join b on b.id = c.id), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d)
select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance from r where rank <= 10"""
ORACLES["m14_planned_search"] = ORACLES["x2_inverted_lists"]
ORACLES["c1_presets"] = "select * from (values ('quick', 128, 16, 4, 'adaptive'), ('research', 768, 1024, 64, 'exact'), ('production', 768, 1024, 16, 'adaptive'), ('enterprise', 1536, 4096, 32, 'adaptive'), ('embedded', 64, 16, 2, 'adaptive')) as t(preset, dimension, lists, probes, strategy)"
