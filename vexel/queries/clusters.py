"""Clustering, sampling, quantization and reduction over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators import kmeans, knn, quantize
from vexel.queries.searching import MACRO, fixed_centroids, rows

QUERIES: dict = {}
ORACLES: dict = {}


def j7_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.assign(rows(spark, sf_dir), fixed_centroids(spark, sf_dir))
    return found.select("id", "cluster", F.round("distance", 6).alias("distance"))


def a1_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids after one of Lloyd's iterations from vectors 0 to 7: cluster, i, x."""
    table = rows(spark, sf_dir)
    c = kmeans.fit(table, 8, 1, start=fixed_centroids(spark, sf_dir)).centroids
    return kmeans.centroid_table(table, c).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def a3_weighted_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a1_one_step with weights 1 + id % 3."""
    table = rows(spark, sf_dir).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    c = kmeans.fit(table, 8, 1, start=fixed_centroids(spark, sf_dir), weight="w").centroids
    return kmeans.centroid_table(table, c).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def a4_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kmeans.assign(rows(spark, sf_dir), fixed_centroids(spark, sf_dir))
    return d.agg(F.round(F.sum("distance"), 4).alias("inertia"), F.round(F.sum(F.col("distance") * F.col("distance")), 4).alias("wcss"))


def a1_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about a whole fit by k-means++ and Lloyd."""
    return _about(spark, kmeans.fit(rows(spark, sf_dir), 10, 25, method="plus"))


def a2_mini_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _about(spark, kmeans.fit_mini_batch(rows(spark, sf_dir), 10, 10, 0.3))


def _about(spark: SparkSession, r: kmeans.Result) -> DataFrame:
    return spark.createDataFrame([(len(r.centroids), r.iterations, r.converged, float(r.inertia), float(r.wcss))], "clusters int, iterations int, converged boolean, inertia double, wcss double")


def _cells(spark: SparkSession, table: DataFrame, c: np.ndarray) -> DataFrame:
    return kmeans.centroid_table(table, c).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def a1_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids after three of Lloyd's iterations from vectors 0 to 7."""
    table = rows(spark, sf_dir)
    return _cells(spark, table, kmeans.fit(table, 8, 3, start=fixed_centroids(spark, sf_dir), tolerance=0).centroids)


def a2_mini_batch_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids after three mini-batches of about half of the rows each, from vectors 0 to 7."""
    table = rows(spark, sf_dir)
    return _cells(spark, table, kmeans.fit_mini_batch(table, 8, 3, 0.5, start=fixed_centroids(spark, sf_dir)).centroids)


def a8_list_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ten lists, of which two stay empty."""
    s = kmeans.list_statistics(kmeans.assign(rows(spark, sf_dir), fixed_centroids(spark, sf_dir)), 10)
    return s.select("lists", "rows", "average", "largest", "smallest", F.round("variance", 4).alias("variance"), F.round("density", 6).alias("density"))


def a16_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixed_centroids(spark, sf_dir)
    v = kmeans.validate(kmeans.assign(rows(spark, sf_dir), c), c)
    return v.select(*(F.round(x, 6).alias(x) for x in v.columns))


def a10_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.sample_random(rows(spark, sf_dir), 0.2).select("id")


def a11_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each cluster a tenth leaves."""
    d = kmeans.assign(rows(spark, sf_dir), fixed_centroids(spark, sf_dir))
    return kmeans.sample_stratified(d, 0.1).groupBy("cluster").agg(F.count("*").alias("n"))


def a12_reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.sample_reservoir(rows(spark, sf_dir), 100).select("id")


def a13_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in kmeans.sample_coreset(rows(spark, sf_dir), 6)], "id long")


def a14_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).agg(F.count("*").alias("n")).select("n", F.lit(kmeans.sample_size(rows(spark, sf_dir).count())).alias("size"), F.lit(kmeans.centroid_count(rows(spark, sf_dir).count())).alias("lists"))


def a15_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir).withColumn("w", 1.0 + F.col("label"))
    return kmeans.sample_importance(table, "w", 50)


def a17_online_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids after all vectors in four micro-batches, by id."""
    table = rows(spark, sf_dir)
    c = kmeans.update_batches(table, fixed_centroids(spark, sf_dir), F.col("id") % 4, 4)
    return kmeans.centroid_table(table, c).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def a22_scalar_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantize.statistics(rows(spark, sf_dir))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


def a23_dimension_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the components' variances, over their mean."""
    per = rows(spark, sf_dir).select(F.posexplode(V.doubles("vector")).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    return per.agg(F.round(F.sqrt(F.var_pop("v")) / F.avg("v"), 6).alias("spread"), F.round(F.avg("v"), 8).alias("mean"))


def z1_scalar_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each vector's int8 and uint8 codes."""
    table = rows(spark, sf_dir)
    a, b = quantize.fit_scale(table, "int8"), quantize.fit_scale(table, "uint8")
    return table.select("id", F.aggregate(quantize.encode("vector", a), F.lit(0), lambda s, x: s + x).alias("signed"), F.aggregate(quantize.encode("vector", b), F.lit(0), lambda s, x: s + x).alias("unsigned"))


def z2_scalar_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error and PSNR after coding and decoding."""
    table = rows(spark, sf_dir)
    s = quantize.fit_scale(table)
    back = table.withColumn("back", quantize.decode(quantize.encode("vector", s), s)).select("id", "vector", quantize.error("vector", "back").alias("mse"))
    return back.select("id", F.round(F.col("mse") * 1e6, 4).alias("mse"), F.round(quantize.psnr("vector", F.col("mse")), 4).alias("psnr"))


def z3_rowwise_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = rows(spark, sf_dir).select("id", quantize.encode_rowwise("vector").alias("q"))
    return coded.select("id", F.aggregate("q.codes", F.lit(0), lambda s, x: s + x).alias("total"), F.round("q.low", 6).alias("low"), F.round("q.scale", 4).alias("scale"))


def z1_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    back = quantize.half(table.withColumn("back", F.col("vector")), "back")
    return back.select("id", F.round(quantize.error("vector", "back") * 1e9, 3).alias("mse"))


def z5_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of product codes: mean, greatest, variance."""
    table = rows(spark, sf_dir)
    books = quantize.fit_product(table, 8, 4, 4)
    e = table.select(V.euclidean("vector", quantize.decode_product(quantize.encode_product("vector", books), books)).alias("e"))
    return e.agg(F.avg("e").alias("average"), F.max("e").alias("greatest"), F.var_pop("e").alias("variance"))


def z6_code_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from tables equal those to the decoded vectors: the greatest difference, and recall of the ten nearest."""
    table = rows(spark, sf_dir)
    books = quantize.fit_product(table, 8, 4, 4)
    coded = table.select("id", quantize.encode_product("vector", books).alias("codes"))
    asked = table.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), quantize.distance_table("vector", books).alias("table"))
    d = coded.crossJoin(F.broadcast(asked)).select("query_id", "id", quantize.table_distance("table", "codes").alias("distance"), V.euclidean("query", quantize.decode_product("codes", books)).alias("direct"))
    return d.agg(F.round(F.max(F.abs(F.col("distance") - F.col("direct"))), 9).alias("difference"), F.count("*").alias("pairs"))


def z7_rotated_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rows(spark, sf_dir)
    turn, books = quantize.fit_rotated_product(table, 8, 4, 4)
    turned = table.select(turn.apply("vector").alias("v"))
    return turned.agg(F.avg(V.euclidean("v", quantize.decode_product(quantize.encode_product("v", books), books))).alias("average"))


def z8_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by differing bits."""
    table = rows(spark, sf_dir).select("id", V.binary_words("vector").alias("bits"))
    asked = table.where("id < 5").select(F.col("id").alias("query_id"), F.col("bits").alias("q"))
    d = table.crossJoin(F.broadcast(asked)).select("query_id", "id", V.binary_hamming("q", "bits").cast("long").alias("distance"))
    return knn.top_k(d, 10).select("query_id", "rank", "id", "distance")


def z10_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rows(spark, sf_dir).count()
    s = quantize.savings(n, 64, 8)
    return spark.createDataFrame([(n, float(s["before"]), float(s["after"]), float(s["ratio"]))], "n long, before double, after double, ratio double")


def a25_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance of each of four components, which equals its share of the whole."""
    table = rows(spark, sf_dir)
    p = quantize.pca(table, 4)
    out = table.select(F.posexplode(p.apply("vector")).alias("component", "x")).groupBy("component").agg(F.round(F.var_pop("x"), 8).alias("variance"))
    return out.join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p.explained)], "component int, share double"), "component")


def a25_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, x: the population covariance of all components."""
    _, _, cov = quantize.moments(rows(spark, sf_dir))
    n = len(cov)
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 8)) for i in range(n) for j in range(n)], "i int, j int, x double")


def a25_pca_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components: the sum of their variances is that of the table, their shares make one, and they are at right angles."""
    table = rows(spark, sf_dir)
    p = quantize.pca(table, 64)
    per = table.select(F.posexplode(p.apply("vector")).alias("component", "x")).groupBy("component").agg(F.var_pop("x").alias("v"))
    angles = float(np.abs(p.matrix @ p.matrix.T - np.eye(64)).max())
    return per.agg(F.round(F.sum("v"), 6).alias("variance"), F.lit(round(float(p.explained.sum()), 6)).alias("shares"), F.lit(angles < 1e-9).alias("right"))


def a26_random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How squared lengths change under projection to 16 dimensions, on average."""
    p = quantize.random_projection(64, 16)
    return rows(spark, sf_dir).agg(F.round(F.avg(V.dot(p.apply("vector"), p.apply("vector")) / V.dot("vector", "vector")), 6).alias("ratio"))


def a5_soft_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multilayer perceptron learns the clusters; agreement with the nearest centroids, and each cluster's mean probability."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    table = rows(spark, sf_dir)
    d = table.join(kmeans.assign(table, fixed_centroids(spark, sf_dir)).select("id", F.col("cluster").cast("double").alias("cluster")), "id")
    d = d.select("id", array_to_vector(V.doubles("vector")).alias("features"), "cluster")
    net = MultilayerPerceptronClassifier(layers=[64, 16, 8], labelCol="cluster", maxIter=30, seed=1).fit(d)
    p = net.transform(d)
    return p.agg(F.avg((F.col("prediction") == F.col("cluster")).cast("double")).alias("agreement"), F.avg(F.array_max(vector_to_array("probability"))).alias("probability"))


def a5_soft_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids as means weighted by each row's probabilities, here by 1 / (1 + squared distance) to vectors 0 to 7: cluster, i, x."""
    table, c = rows(spark, sf_dir), fixed_centroids(spark, sf_dir)
    centers = F.array(*(F.array(*(F.lit(float(x)) for x in v)) for v in c))
    near = F.transform(centers, lambda m: 1.0 / (1.0 + V.squared_euclidean("vector", m)))
    soft = table.select("id", "vector", near.alias("near")).select("id", "vector", F.transform("near", lambda x: x / V.total(F.col("near"))).alias("probability"))
    return kmeans.soft_centroids(soft).withColumn("x", F.round("x", 6))


def z4_rounded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each vector's codes by round((x - least) * scale), held between 0 and 255."""
    table = rows(spark, sf_dir)
    s = quantize.statistics(table).first()
    codes = quantize.encode_rounded("vector", s["minimum"], 255.0 / (s["maximum"] - s["minimum"]))
    return table.select("id", F.aggregate(codes, F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def v41_matrix_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as a matrix A: sums of the rows of A, of 2 A, of A + A, A * A, A / 2, min(A, 0), max(A, 0) and A - A, and of the transpose's column."""
    m = quantize.cells(rows(spark, sf_dir))
    zero = m.select("i", "j", F.lit(0.0).alias("x"))
    parts = {"a": m, "scaled": quantize.scaled(m, 2.0), "added": quantize.elementwise(m, m, "add"), "taken": quantize.elementwise(m, m, "subtract"), "product": quantize.elementwise(m, m, "multiply"), "low": quantize.elementwise(m, zero, "min"), "high": quantize.elementwise(m, zero, "max"), "half": quantize.elementwise(m, quantize.elementwise(zero, m, "filled", 2.0), "divide"), "across": quantize.row_sums(quantize.transpose(m))}
    out = None
    for name, part in parts.items():
        one = (part if name == "across" else quantize.row_sums(part)).select(F.lit(name).alias("part"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("x", F.coalesce(F.nullif("x", F.lit(0.0)), F.lit(0.0)))


FUNCTIONS = (a1_three_steps, a2_mini_batch_centroids, a25_pca_checks, a5_soft_centroids, z4_rounded_codes, v41_matrix_operations, j7_assign, a1_one_step, a3_weighted_step, a4_inertia, a1_lloyd, a2_mini_batch, a8_list_statistics, a16_validation, a10_random_sample, a11_stratified_sample, a12_reservoir_sample, a13_coreset, a14_sample_size, a15_importance_sample, a17_online_update, a22_scalar_statistics, a23_dimension_variance, z1_scalar_codes, z2_scalar_restored, z3_rowwise_codes, z1_half_precision, z5_product_codes, z6_code_distances, z7_rotated_product_codes, z8_binary_search, z10_savings, a25_pca, a25_covariance, a26_random_projection, a5_soft_clusters)
QUERIES |= {f.__name__: f for f in FUNCTIONS}

CELLS = f"""{MACRO}, cd as (select a.id as id, b.id as cluster, list_distance(a.v, b.v) as distance, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as place from b as a, b where b.id < 8),
own as (select id, cast(cluster as int) as cluster, distance from cd where place = 1)"""
LONG = ", long as (select id, generate_subscripts(v, 1) - 1 as i, unnest(v) as x from b)"
ORACLES["j7_assign"] = f"{CELLS} select id, cluster, round(distance, 6) as distance from own"
ORACLES["a1_one_step"] = f"{CELLS}{LONG} select cluster, i, round(avg(x), 6) as x from own join long using (id) group by 1, 2"
ORACLES["a3_weighted_step"] = f"{CELLS}{LONG} select cluster, i, round(sum(x * (1 + id % 3)) / sum(1 + id % 3), 6) as x from own join long using (id) group by 1, 2"
ORACLES["a4_inertia"] = f"{CELLS} select round(sum(distance), 4) as inertia, round(sum(distance * distance), 4) as wcss from own"
ORACLES["a8_list_statistics"] = f"{CELLS}, s as (select r.range as cluster, count(own.id) as n from range(10) r left join own on own.cluster = r.range group by 1) select count(*) as lists, cast(sum(n) as bigint) as rows, cast(floor(sum(n) / count(*)) as bigint) as average, max(n) as largest, min(n) as smallest, round(var_pop(n), 4) as variance, round(sum(n) / count(*), 6) as density from s"
ORACLES["a16_validation"] = f"""{CELLS}, s as (select r.range as cluster, count(own.id) as n from range(8) r left join own on own.cluster = r.range group by 1)
select round((select avg(distance * distance) from own), 6) as quantization_error, round(1 - sqrt(var_pop(n)) / avg(n), 6) as balance,
  round((select least(1, min(list_distance(x.v, y.v)) / 10) from b x, b y where x.id < 8 and y.id < x.id), 6) as separability, round((select count(distinct cluster) / 8 from own), 6) as coverage from s"""
ORACLES["a11_stratified_sample"] = f"{CELLS} select cluster, cast(greatest(1, floor(count(*) * 0.1)) as bigint) as n from own group by 1"
ORACLES["a22_scalar_statistics"] = "with x as (select cast(unnest(embedding) as double) as x from embeddings) select round(min(x), 6) as minimum, round(max(x), 6) as maximum, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation, round(avg(case when abs(x) < 0.01 then 1.0 else 0 end), 6) as near_zero from x"
ORACLES["a23_dimension_variance"] = "with x as (select generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings), v as (select i, var_pop(x) as v from x group by 1) select round(sqrt(var_pop(v)) / avg(v), 6) as spread, round(avg(v), 8) as mean from v"
SCALED = "with x as (select vec_id as id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings), s as (select 255.0 / (max(x) - min(x)) as k, min(x) as low from x)"
ORACLES["z1_scalar_codes"] = f"{SCALED} select id, cast(sum(greatest(-128, least(127, trunc(x * k + (-low * k - 128))))) as bigint) as signed, cast(sum(greatest(0, least(255, trunc(x * k + (-low * k))))) as bigint) as unsigned from x, s group by 1"
ORACLES["z2_scalar_restored"] = f"{SCALED}, c as (select id, x, (greatest(-128, least(127, trunc(x * k + (-low * k - 128)))) - (-low * k - 128)) / k as y from x, s), e as (select id, avg((x-y)*(x-y)) as mse, max(abs(x)) as top from c group by 1) select id, round(mse * 1e6, 4) as mse, round(20 * log10(top / sqrt(mse)), 4) as psnr from e"
ORACLES["z3_rowwise_codes"] = "with x as (select vec_id as id, cast(unnest(embedding) as double) as x from embeddings), s as (select id, min(x) as low, 255.0 / (max(x) - min(x)) as k from x group by 1) select id, cast(sum(trunc((x - low) * k)) as bigint) as total, round(any_value(low), 6) as low, round(any_value(k), 4) as scale from x join s using (id) group by 1"
ORACLES["z8_binary_search"] = "with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) > 0 as x from embeddings), d as (select a.vec_id as query_id, b.vec_id as id, count(*) filter (a.x <> b.x) as distance from e a join e b using (i) where a.vec_id < 5 group by 1, 2), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, distance from r where rank <= 10"
ORACLES["z10_savings"] = "select count(*) as n, count(*) * 256.0 as before, count(*) * 64.0 as after, 4.0 as ratio from embeddings"
ORACLES["a25_covariance"] = "with x as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings) select cast(a.i - 1 as int) as i, cast(b.i - 1 as int) as j, round(covar_pop(a.x, b.x), 8) as x from x a join x b using (vec_id) group by 1, 2"
ORACLES["a25_pca_checks"] = "with x as (select generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings), v as (select i, var_pop(x) as v from x group by 1) select round(sum(v), 6) as variance, 1.0 as shares, true as right from v"
ORACLES["a5_soft_centroids"] = f"""{MACRO}, n as (select a.id, b.id as cluster, 1 / (1 + pow(list_distance(a.v, b.v), 2)) as w from b as a, b where b.id < 8), p as (select id, cluster, w / sum(w) over (partition by id) as p from n){LONG}
select cast(cluster as int) as cluster, cast(i as int) as i, round(sum(p * x) / sum(p), 6) as x from p join long using (id) group by 1, 2"""
ORACLES["z4_rounded_codes"] = "with x as (select vec_id as id, cast(unnest(embedding) as double) as x from embeddings), s as (select 255.0 / (max(x) - min(x)) as k, min(x) as low from x) select id, cast(sum(greatest(0, least(255, round((x - low) * k)))) as bigint) as total from x, s group by 1"
_M = f"{MACRO}{LONG}"
_ROWS = {"a": "x", "scaled": "2 * x", "added": "x + x", "taken": "x - x", "product": "x * x", "low": "least(x, 0)", "high": "greatest(x, 0)", "half": "x / 2"}
ORACLES["v41_matrix_operations"] = _M + " union all ".join(f" select '{n}' as part, id as i, coalesce(nullif(round(sum({e}), 6), 0), 0) as x from long group by 2" for n, e in _ROWS.items()) + " union all select 'across', cast(i as bigint), coalesce(nullif(round(sum(x), 6), 0), 0) from long group by 2"
#: Four micro-batches, one after the other.
_BATCHES = "".join(f""", g{b} as (select l.id, c.cluster, row_number() over (partition by l.id order by list_distance(l.v, c.v), c.cluster) as place from b l, c{b} c where l.id % 4 = {b}),
s{b} as (select g.cluster, long.i, avg(long.x) as mean, count(*) as n from g{b} g join long on long.id = g.id where g.place = 1 group by 1, 2),
x{b} as (select c.cluster, unnest(range(64)) as i, unnest(c.v) as x from c{b} c), c{b + 1} as (select x.cluster, list(x.x + (1 - pow(0.95, coalesce(s.n, 0))) * (coalesce(s.mean, x.x) - x.x) order by x.i) as v from x{b} x left join s{b} s on s.cluster = x.cluster and s.i = x.i group by 1)""" for b in range(4))
ORACLES["a17_online_update"] = f"{MACRO}{LONG}, c0 as (select cast(id as int) as cluster, v from b where id < 8){_BATCHES} select cluster, cast(unnest(range(64)) as int) as i, round(unnest(v), 6) as x from c4"
ORACLES["a12_reservoir_sample"] = "select vec_id as id from embeddings order by cast('0x' || substr(md5('1:' || vec_id), 1, 12) as bigint), vec_id limit 100"
_FAR = f"""{MACRO}, p1 as (select min(id) as id from b), d1 as (select b.id, list_distance(b.v, c.v) as d from b, b c where c.id = (select id from p1))""" + "".join(f", p{i} as (select id from d{i - 1} order by d desc, id limit 1), d{i} as (select b.id, least(d{i - 1}.d, list_distance(b.v, c.v)) as d from b join d{i - 1} on d{i - 1}.id = b.id, b c where c.id = (select id from p{i}))" for i in range(2, 7))
ORACLES["a13_coreset"] = _FAR + " " + " union all ".join(f"select id from p{i}" for i in range(1, 7))
ORACLES["a14_sample_size"] = "select count(*) as n, cast(least(count(*), 100) as int) as size, cast(least(4096, greatest(16, round_even(sqrt(count(*)), 0))) as int) as lists from embeddings"
ORACLES["a15_importance_sample"] = f"""with w as (select vec_id as id, 1.0 + label as w, cast('0x' || substr(md5('1:' || vec_id), 1, 12) as bigint) as o from embeddings), t as (select sum(w) as total from w),
e as (select id, w, sum(w) over (order by o, id) as e from w) select id, cast(floor(e / total * 50 + {float(np.random.default_rng(1).random())!r}) - floor((e - w) / total * 50 + {float(np.random.default_rng(1).random())!r}) as int) as draws from e, t where floor(e / total * 50 + {float(np.random.default_rng(1).random())!r}) > floor((e - w) / total * 50 + {float(np.random.default_rng(1).random())!r})"""
#: A float's step in half precision is 2^(exponent - 10), 2^-24 at least.
ORACLES["z1_half_precision"] = "with x as (select vec_id as id, cast(unnest(embedding) as double) as x from embeddings), s as (select id, x, case when x = 0 then 1 else pow(2, greatest(-24, floor(log2(abs(x))) - 10)) end as step from x) select id, round(avg(pow(x - round_even(x / step, 0) * step, 2)) * 1e9, 3) as mse from s group by 1"
ORACLES["z6_code_distances"] = "select 0.0 as difference, 5 * count(*) as pairs from embeddings"
_PROJECTED = ", ".join(f"({i}, {j}, {float(x)!r})" for (i, j), x in np.ndenumerate(quantize.random_projection(64, 16).matrix))
ORACLES["a26_random_projection"] = f"{MACRO}{LONG}, m as (select * from (values {_PROJECTED}) as t(k, i, y)), p as (select id, k, sum(x * y) as p from long join m using (i) group by 1, 2), q as (select id, sum(p * p) as q from p group by 1) select round(avg(q / (n * n)), 6) as ratio from q join b using (id)"
ORACLES["a10_random_sample"] = "select vec_id as id from embeddings where cast('0x' || substr(md5('1:' || vec_id), 1, 12) as bigint) < 0.2 * pow(2, 48)"


def _moving(steps: int, of: str, share: str) -> str:
    """Steps of centroids c0 to c<steps> towards the means of the rows that `of` picks (with {n}), by the share (with {n})."""
    out = f"{MACRO}{LONG}, c0 as (select cast(id as int) as cluster, v from b where id < 8)"
    for n in range(steps):
        out += f""", g{n} as (select l.id, c.cluster, row_number() over (partition by l.id order by list_distance(l.v, c.v), c.cluster) as place from b l, c{n} c where {of.format(n=n)}),
s{n} as (select g.cluster, long.i, avg(long.x) as mean from g{n} g join long on long.id = g.id where g.place = 1 group by 1, 2), x{n} as (select c.cluster, unnest(range(64)) as i, unnest(c.v) as x from c{n} c),
c{n + 1} as (select x.cluster, list(x.x + {share.format(n=n)} * (coalesce(s.mean, x.x) - x.x) order by x.i) as v from x{n} x left join s{n} s on s.cluster = x.cluster and s.i = x.i group by 1)"""
    return out + f" select cluster, cast(unnest(range(64)) as int) as i, round(unnest(v), 6) as x from c{steps}"


ORACLES["a1_three_steps"] = _moving(3, "true", "1")
ORACLES["a2_mini_batch_centroids"] = _moving(3, "cast('0x' || substr(md5((1 + {n}) || ':' || l.id), 1, 12) as bigint) < 0.5 * pow(2, 48)", "1.0 / ({n} + 1)")
