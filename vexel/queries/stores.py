"""Store lifecycle, sources, tiers and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel import sources, streaming
from vexel.functions import vectors as V
from vexel.operators import store as S
from vexel.operators.shared import scratch
from vexel.queries.searching import rows

QUERIES: dict = {}
ORACLES: dict = {}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id as text, vector, metadata as JSON."""
    return rows(spark, sf_dir).select(F.col("id").cast("string").alias("id"), V.doubles("vector").alias("vector"), F.to_json(F.struct(F.col("label").cast("string").alias("label"))).alias("metadata"))


def _digest(df: DataFrame) -> DataFrame:
    return df.select("id", F.size("vector").alias("n"), F.round(V.total(V.doubles("vector")), 6).alias("total"), F.get_json_object("metadata", "$.label").alias("label"))


DIGEST_SQL = "select cast(vec_id as varchar) as id, len(embedding) as n, round(list_sum(cast(embedding as double[])), 6) as total, cast(label as varchar) as label from embeddings"


def s1_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table = vectors(spark, sf_dir).withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    sources.write_json(table, path)
    return _digest(sources.read_json(spark, path, lines=True))


def s3_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sources.write_csv(vectors(spark, sf_dir), path, 64, ["label"], gzip=True)
    return _digest(sources.read_csv(spark, path))


def s4_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}.parquet"
    vectors(spark, sf_dir).write.parquet(path)
    return _digest(sources.read(spark, path))


def s11_base64_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored from base64 of the rows' JSON."""
    coded = vectors(spark, sf_dir).select(sources.base64_row(["id", "vector", "metadata"]).alias("row"))
    back = coded.select(F.from_json(F.unbase64("row").cast("string"), "id string, vector array<double>, metadata string").alias("x")).select("x.*")
    return _digest(back)


def s13_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("label = 4").select("id")


def s14_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lookup(rows(spark, sf_dir), [30, 10, 999_999_999, 20]).select("id", "position")


def s15_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_prefix(vectors(spark, sf_dir), "12").select("id")


def s16_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contains(rows(spark, sf_dir), spark.range(0, 14_000, 7))


def s20_query_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query given as JSON, as found by its first components."""
    q = sources.parse_queries(spark, '[{"id": "a", "vector": [1, 2.5, 3]}, {"vector": [4, 5, 6]}]')
    return q.select("query_id", F.size("query").alias("n"), V.total("query").alias("total"))


def s21_result_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vexel.operators import knn
    from vexel.queries.searching import asked

    table = rows(spark, sf_dir)
    r = sources.result_table(knn.search(table, asked(table, 3), 5, "cosine"))
    return r.select("query_id", "rank", "id", F.coalesce(F.nullif(F.round("distance", 6), F.lit(0.0)), F.lit(0.0)).alias("distance"), F.round("score", 6).alias("score"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row with its label raised by 100, as ids shifted by a large number for every tenth."""
    return rows(spark, sf_dir).where("id % 5 = 0").select(F.when(F.col("id") % 10 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("id"), "vector", (F.col("label") + 100).alias("label"))


def m1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.upsert(rows(spark, sf_dir), _changes(spark, sf_dir)).select("id", "label")


def m2_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels change where the change isn't null."""
    new = _changes(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("label")).alias("label"))
    return S.update(rows(spark, sf_dir), new, ["label"]).select("id", "label")


def m3_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.delete(rows(spark, sf_dir), _changes(spark, sf_dir)).select("id")


def m5_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compact(S.mark_deleted(rows(spark, sf_dir), _changes(spark, sf_dir))).select("id")


def m4_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after loading rows of which some are bad and some known, and the versions."""
    table = vectors(spark, sf_dir)
    kept = S.Store(spark, scratch(spark), 64)
    kept.load(table.where("cast(id as long) % 2 = 0"))
    bad = table.withColumn("vector", F.when(F.col("id").cast("long") % 7 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    counts = kept.load(bad)
    return kept.read().agg(F.count("*").alias("rows")).select("rows", *(F.lit(counts[c]).cast("long").alias(c) for c in ("inserted", "known", "errors")))


def s18_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restore the newest version equals the first."""
    table = vectors(spark, sf_dir)
    kept = S.Store(spark, scratch(spark), 64)
    first = kept.write(table)
    kept.write(table.where("cast(id as long) < 10"))
    kept.restore(first)
    return _digest(kept.read())


def m1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what is wrong with them, of a table with errors made in it."""
    i = F.col("id")
    v = V.doubles("vector")
    bad = rows(spark, sf_dir).select(F.when(i % 17 == 0, "").otherwise(i.cast("string")).alias("id"), F.when(i % 13 == 0, F.lit(None)).when(i % 11 == 0, F.slice(v, 1, 10)).when(i % 7 == 0, F.transform(v, lambda x: x * float("nan"))).otherwise(v).alias("vector"))
    return bad.select(F.coalesce(S.problem(64), F.lit("good")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored items: id, size, priority, last_access, accesses, created."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), (F.floor(F.col("p_retailprice")).cast("long") * F.col("p_size") * 400).alias("size"), F.when(F.col("p_size") > 40, "high").otherwise("normal").alias("priority"), (F.col("p_partkey") * 7919 % 10007).alias("last_access"), (F.col("p_partkey") % 97).alias("accesses"), F.col("p_partkey").alias("created"))


def m6_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tiers(items(spark, sf_dir), 8_000_000).select("id", "tier")


def a32_tier_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.tier_statistics(S.tiers(items(spark, sf_dir), 8_000_000))
    return s.select("tier", "items", "bytes", F.round("average", 4).alias("average"))


def _evict(policy: str):
    return lambda spark, sf_dir: S.evict(items(spark, sf_dir), 300_000_000, policy).select("id", F.col("freed").cast("long").alias("freed"))


for _p, _order in (("lru", "last_access"), ("lfu", "accesses"), ("fifo", "created")):
    QUERIES[f"m9_evict_{_p}"] = _evict(_p)
    ORACLES[f"m9_evict_{_p}"] = f"""with i as (select p_partkey as id, cast(floor(p_retailprice) as bigint) * p_size * 400 as size, p_partkey * 7919 % 10007 as last_access, p_partkey % 97 as accesses, p_partkey as created from part),
r as (select id, size, sum(size) over (order by {_order}, id) as freed from i) select id, cast(freed as bigint) as freed from r where freed - size < 300000000"""


def m12_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.tiers(items(spark, sf_dir), 8_000_000)
    data = items(spark, sf_dir).where("id % 50 != 0").select("id")
    return S.integrity(t, data, {"memory": 1_000_000, "ssd": 10**15, "archive": 10**15})


def a31_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statistics(rows(spark, sf_dir))


def a42_magnitude_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.magnitude_histogram(rows(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 16)), 0.0, 1.0, 20)


def m13_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by range, modulo and hour partition."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(S.partition_of(F.col("o_totalprice"), "range", 4, [1e5, 2e5, 3e5]).alias("by_range"), S.partition_of(F.col("o_orderkey"), "modulo", 3).cast("int").alias("by_modulo"), S.partition_of(F.col("o_orderdate"), "hour", 4).alias("by_hour")).agg(F.count("*").alias("n"))


def r3_hourly_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into hourly counts with a week's retention."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_trunc("second", "ts").alias("ts"), F.col("event_type").alias("key"))
    source, out, state = scratch(spark), scratch(spark), scratch(spark)
    e.write.parquet(source)
    counts = streaming.hourly(streaming.read_stream(spark, source, "event_id long, ts timestamp, key string", 1000))
    counts.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{out}/*").groupBy("hour", "key").agg(F.max("n").alias("n"))
    return found.select(F.col("hour").cast("string").alias("hour"), F.col("key").alias("event_type"), "n")


def s7_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest beside an export says."""
    path = scratch(spark)
    sources.write_json(vectors(spark, sf_dir), path, vectors=False)
    return spark.read.schema("version int, dimensions int, count long").json(f"{path}.manifest")


def r1_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed file by file into hourly counts equal those of the batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_trunc("second", "ts").alias("ts"), F.col("event_type").alias("key"))
    source, out, state = scratch(spark), scratch(spark), scratch(spark)
    e.repartition(3).write.parquet(source)
    stream = streaming.read_stream(spark, source, "event_id long, ts timestamp, key string", 10)
    counts = streaming.hourly(stream, "2000 hours")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{out}/*").groupBy("hour", "key").agg(F.max("n").alias("n"))
    return found.select(F.col("hour").cast("string").alias("hour"), "key", "n")


def _write_array(table: DataFrame, path: str) -> None:
    """One file with one JSON array, row by row; its last object is empty."""
    line = lambda text: table.sparkSession.createDataFrame([(text,)], "value string")
    body = table.select(F.concat(F.to_json(F.struct("id", "vector")), F.lit(",")).alias("value"))
    line("[").union(body).union(line("{}]")).coalesce(1).write.text(path)


def s1_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds one array, without extension, of which some rows have no id, no vector, or a short one: good rows and errors."""
    i = F.col("id").cast("long")
    made = vectors(spark, sf_dir).select(F.when(i % 17 != 0, F.col("id")).alias("id"), F.when(i % 13 == 0, F.lit(None)).when(i % 11 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"))
    path = scratch(spark)
    _write_array(made, path)
    good, errors = sources.import_rows(sources.read(spark, path), 64)
    return good.agg(F.lit("good").alias("error"), F.count("*").alias("n")).unionByName(errors)


def s6_sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text formats, read from folders whose names say nothing."""
    table, out = vectors(spark, sf_dir), None
    paths = {"csv": scratch(spark), "jsonl": scratch(spark), "json": scratch(spark)}
    sources.write_csv(table, paths["csv"], 64, ["label"])
    table.select(F.to_json(F.struct("id", "vector")).alias("value")).write.text(paths["jsonl"])
    _write_array(table, paths["json"])
    for kind, path in paths.items():
        found = sources.format_of(path, sources.first_character(spark, path))
        row = sources.read(spark, path).agg(F.lit(kind).alias("written"), F.lit(found).alias("found"), F.count("*").alias("n"), F.round(F.sum(V.total("vector")), 4).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def s20_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from a file of lines, bare or named, searched."""
    from vexel.operators import knn

    table = rows(spark, sf_dir)
    path = scratch(spark)
    asked = table.where("id < 20")
    asked.select(F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("q"), "id").alias("id"), "vector"))).otherwise(F.to_json("vector")).alias("value")).coalesce(1).write.text(path)
    q = sources.read_queries(spark, path)
    near = knn.search(table, q, 1)
    return near.select(F.col("query_id").startswith("q").alias("named"), "id", "rank")


def m8_migration_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items moved by decisions, written by tier and read again: how many of each tier, and how many moved there."""
    t = S.tiers(items(spark, sf_dir), 8_000_000)
    decisions = t.select("id", F.when(F.col("id") % 5 == 0, "promote").when(F.col("id") % 7 == 0, "demote").otherwise("keep").alias("decision"))
    path = scratch(spark)
    S.write_by_tier(S.migrated(t, decisions), path)
    return spark.read.parquet(path).groupBy("tier").agg(F.count("*").alias("items"), F.count_if("moved").alias("moved"))


def n9_verified_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(S.copy_verified(vectors(spark, sf_dir), scratch(spark)))


def r4_online_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids after all vectors came as a stream in one batch: half of the way to the batch's means."""
    from vexel.queries.searching import fixed_centroids

    source, state = scratch(spark), scratch(spark)
    rows(spark, sf_dir).select("id", "vector").write.parquet(source)
    online = streaming.OnlineCentroids(fixed_centroids(spark, sf_dir))
    streaming.each_batch(streaming.read_stream(spark, source, "id long, vector array<float>", 1000), online, state).awaitTermination()
    from vexel.operators import kmeans

    return kmeans.centroid_table(rows(spark, sf_dir), online.centroids).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


FUNCTIONS = (r3_hourly_buckets, s7_manifest, s1_json_array, s6_sniffed_formats, s20_query_batch, m8_migration_cycle, n9_verified_copy, r4_online_centroids, s1_json_round_trip, s3_csv_round_trip, s4_parquet_round_trip, s11_base64_rows, s13_filtered_scan, s14_lookup, s15_prefix_scan, s16_contains, s20_query_input, s21_result_output, m1_upsert, m2_update, m3_delete, m5_compact, m4_bulk_load, s18_snapshot, m1_validation, m6_tiers, a32_tier_statistics, m12_integrity, a31_statistics, a42_magnitude_histogram, m13_partitions, r1_stream_batches)
QUERIES |= {f.__name__: f for f in FUNCTIONS}
for _n in ("s1_json_round_trip", "s3_csv_round_trip", "s4_parquet_round_trip", "s11_base64_rows", "s18_snapshot"):
    ORACLES[_n] = DIGEST_SQL
ORACLES["s13_filtered_scan"] = "select vec_id as id from embeddings where label = 4"
ORACLES["s14_lookup"] = "select vec_id as id, position from embeddings join (values (30, 0), (10, 1), (999999999, 2), (20, 3)) as a(k, position) on k = vec_id"
ORACLES["s15_prefix_scan"] = "select cast(vec_id as varchar) as id from embeddings where starts_with(cast(vec_id as varchar), '12')"
ORACLES["s16_contains"] = "select range as id, vec_id is not null as found from range(0, 14000, 7) left join embeddings on vec_id = range"
ORACLES["s20_query_input"] = "select * from (values ('a', 3, 6.5), ('1', 3, 15.0)) as t(query_id, n, total)"
ORACLES["s21_result_output"] = """with b as (select vec_id as id, cast(embedding as double[]) as v from embeddings), d as (select a.id as query_id, b.id, 1 - list_cosine_similarity(a.v, b.v) as distance from b as a, b where a.id < 3),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance, round(1 - distance, 6) as score from r where rank <= 5"""
CH = "with c as (select case when vec_id % 10 = 0 then vec_id + 1000000 else vec_id end as id, label + 100 as label from embeddings where vec_id % 5 = 0)"
ORACLES["m1_upsert"] = f"{CH} select vec_id as id, label from embeddings where vec_id not in (select id from c) union all select id, label from c"
ORACLES["m2_update"] = f"{CH} select vec_id as id, coalesce(case when c.id % 3 <> 0 then c.label end, e.label) as label from embeddings e left join c on c.id = e.vec_id"
ORACLES["m3_delete"] = f"{CH} select vec_id as id from embeddings where vec_id not in (select id from c)"
ORACLES["m5_compact"] = ORACLES["m3_delete"]
ORACLES["m4_bulk_load"] = "select count(*) filter (vec_id % 2 = 0 or vec_id % 7 <> 0) as rows, count(*) filter (vec_id % 2 <> 0 and vec_id % 7 <> 0) as inserted, count(*) filter (vec_id % 2 = 0 and vec_id % 7 <> 0) as known, count(*) filter (vec_id % 7 = 0) as errors from embeddings"
ORACLES["m1_validation"] = "select case when vec_id % 17 = 0 then 'empty_id' when vec_id % 13 = 0 then 'missing_vector' when vec_id % 11 = 0 then 'wrong_dimension' when vec_id % 7 = 0 then 'not_finite' else 'good' end as problem, count(*) as n from embeddings group by 1"
ITEMS = """with i as (select p_partkey as id, cast(floor(p_retailprice) as bigint) * p_size * 400 as size, case when p_size > 40 then 'high' else 'normal' end as priority from part),
t as (select *, case when priority = 'high' and size <= 8000000 then 'memory' when size > 10485760 then 'archive' when size > 1048576 then 'ssd' when size <= 8000000 then 'memory' else 'ssd' end as tier from i)"""
ORACLES["m6_tiers"] = f"{ITEMS} select id, tier from t"
ORACLES["a32_tier_statistics"] = f"{ITEMS} select tier, count(*) as items, cast(sum(size) as bigint) as bytes, round(avg(size), 4) as average from t group by 1"
ORACLES["m12_integrity"] = f"""{ITEMS} select 'missing_data' as "check", 'error' as severity, count(*) filter (id % 50 = 0) as failures from t union all select 'orphan_data', 'warning', 0
union all select 'over_limit', 'warning', count(*) from (select tier, sum(size) as s from t group by 1) where tier = 'memory' and s > 1000000"""
ORACLES["a31_statistics"] = "select count(*) as rows, count(distinct vec_id) as ids, count(distinct len(embedding)) as dimensions, cast(sum(4 * len(embedding)) as bigint) as bytes, count(*) filter (embedding is null) as missing from embeddings"
ORACLES["a42_magnitude_histogram"] = "with x as (select sqrt(list_sum(list_transform(cast(embedding[1:16] as double[]), lambda y: y*y))) as m from embeddings) select cast(case when m < 0 then 0 when m >= 1 then 21 else floor(m * 20) + 1 end as bigint) as bin, count(*) as n from x group by 1"
ORACLES["m13_partitions"] = "select cast(o_totalprice >= 1e5 as int) + cast(o_totalprice >= 2e5 as int) + cast(o_totalprice >= 3e5 as int) as by_range, o_orderkey % 3 as by_modulo, cast(floor(hour(o_orderdate) * 4 / 24) as int) as by_hour, count(*) as n from orders group by 1, 2, 3"
ORACLES["r1_stream_batches"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type as key, count(*) as n from events group by 1, 2"
ORACLES["s1_json_array"] = "select error, count(*) as n from (select case when vec_id % 17 = 0 then 'no id' when vec_id % 13 = 0 then 'no vector' when vec_id % 11 = 0 then 'wrong dimension' else 'good' end as error from embeddings union all select 'no id') group by 1"
ORACLES["s6_sniffed_formats"] = "with t as (select count(*) as n, round(sum(list_sum(cast(embedding as double[]))), 4) as total from embeddings) select kind as written, kind as found, n + cast(kind = 'json' as int) as n, total from t, (values ('csv'), ('jsonl'), ('json')) as k(kind)"
ORACLES["s20_query_batch"] = "select vec_id % 2 = 0 as named, vec_id as id, 1 as rank from embeddings where vec_id < 20"
ORACLES["m8_migration_cycle"] = f"""{ITEMS}, d as (select *, case when id % 5 = 0 then case tier when 'archive' then 'ssd' when 'ssd' then 'memory' else tier end when id % 7 = 0 then case tier when 'memory' then 'ssd' when 'ssd' then 'archive' else tier end else tier end as new from t)
select new as tier, count(*) as items, count(*) filter (new <> tier) as moved from d group by 1"""
ORACLES["n9_verified_copy"] = DIGEST_SQL
ORACLES["r4_online_centroids"] = """with b as (select vec_id as id, cast(embedding as double[]) as v from embeddings), cd as (select a.id as id, b.id as cluster, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as place from b as a, b where b.id < 8),
long as (select id, generate_subscripts(v, 1) - 1 as i, unnest(v) as x from b), m as (select cluster, i, avg(x) as mean from cd join long using (id) where place = 1 group by 1, 2)
select cast(m.cluster as int) as cluster, m.i, round((mean + long.x) / 2, 6) as x from m join long on long.id = m.cluster and long.i = m.i"""
ORACLES["r3_hourly_buckets"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n from events group by 1, 2"
ORACLES["s7_manifest"] = "select 1 as version, 64 as dimensions, count(*) as count from embeddings"
