"""Recommendations P1 to P10 and fusion: customers are users, parts are items, lineitem joined with orders the interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators import knn
from vexel.operators import recommend as R
from vexel.operators.shared import written

QUERIES: dict = {}
ORACLES: dict = {}

SQL = """with inter as (select o_custkey as user_id, l_partkey as item_id, l_quantity > 25 as strong from lineitem join orders on o_orderkey = l_orderkey),
items as (select p_partkey as item_id, p_brand as brand, p_type as category, p_retailprice as price, [p_brand, p_type] as attributes from part),
prof as (select user_id, category, sum(case when strong then 1.0 else 0.5 end) as weight from inter join items using (item_id) group by 1, 2)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_quantity") > 25).alias("strong"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.array("p_brand", "p_type").alias("attributes"))


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select("user_id", "item_id").distinct()


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions with brand and category of their items, null for unknown ones; written, as they are read several times."""
    return written(interactions(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "brand", "category", F.lit(True).alias("known")), "item_id", "left"))


def neighbours(spark: SparkSession, sf_dir: str, inter: DataFrame | None = None) -> DataFrame:
    """Each user's five nearest by how often they took items of each brand."""
    inter = inter if inter is not None else interactions(spark, sf_dir)
    return R.nearest_users(R.user_vectors(inter, items(spark, sf_dir), "brand"), 5)


def p1_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    inter = described(spark, sf_dir)
    found = R.by_users(neighbours(spark, sf_dir, inter), inter, 3)
    return found.select("user_id", "rank", "item_id", F.round("score", 6).alias("score"))


def p2_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar items by the embeddings as the items' vectors, ten to each."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vector"))
    near = R.nearest_users(e, 10).select(F.col("user_id").alias("item_id"), "other", (1.0 - F.col("distance")).alias("similarity"))
    return R.by_items(near, taken(spark, sf_dir), 3).select("user_id", "rank", "item_id", F.round("score", 6).alias("score"))


def a44_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile(interactions(spark, sf_dir), items(spark, sf_dir))


def a44_attribute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.attribute_profile(interactions(spark, sf_dir), items(spark, sf_dir))
    return p.select("user_id", "attribute", F.round("weight", 6).alias("weight"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select("item_id", "category", F.when(F.col("brand").endswith("1"), 1.0).otherwise(0.2).alias("attribute"), R.price_band(F.col("price"), 1000, 1500).alias("price"), (F.pmod("item_id", F.lit(10)) / 10.0).alias("quality"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile(interactions(spark, sf_dir), items(spark, sf_dir))


def p3_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.by_content(profiles(spark, sf_dir), _scored(spark, sf_dir), each=5)
    return R.best(found.withColumn("score", F.round("score", 9)), 5).select("user_id", "rank", "item_id", F.round("score", 6).alias("score"))


def p4_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and neighbours' scores merged, popularity added, categories varied: the five best of each user.

    Of a category's items only the five best above the content's bound, and those the neighbours took, can be among these.
    """
    inter = described(spark, sf_dir)
    near = R.by_users(neighbours(spark, sf_dir, inter), inter, 50)
    counts = inter.groupBy("item_id").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    own = R.content_score(F.lit(0.0), F.col("attribute"), F.col("price"), F.col("quality"))
    known = written(_scored(spark, sf_dir).join(counts, "item_id", "left").crossJoin(F.broadcast(top)).select("item_id", "category", own.alias("own"), (0.1 * F.coalesce("n", F.lit(0)) / F.col("top")).alias("boost")))
    found = R.hybrid(near, R.profile(inter.where("known"), known), known, 5)
    return found.select("user_id", "rank", "item_id", F.round("score", 5).alias("score"))


def p5_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir).select(F.lit(1).alias("user_id"), "item_id", "category", "price", (F.pmod("item_id", F.lit(100)) / 100.0).alias("score"))
    s = R.realtime(base, {"hour": 20, "device": "mobile", "small": 1200, "leisure": ["ECONOMY"], "viewed": ["STANDARD"], "cart": ["PROMO"]})
    return s.select("item_id", F.round("score", 6).alias("score"))


def p6_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.popular(interactions(spark, sf_dir), 10)


def p6_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.cold_start(items(spark, sf_dir), ["STANDARD", "PROMO"], 1000, 1300, ["Brand#11", "Brand#12"])
    return s.select("item_id", F.round("score", 6).alias("score"))


def p7_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the items' vectors; parts' brand and type as their attributes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), V.doubles("embedding").alias("vector"))
    table = e.join(items(spark, sf_dir).select("item_id", "attributes"), "item_id")
    asked = table.where("item_id <= 5").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query"), "attributes")
    found = R.similar_items(table, asked, 5)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"), F.array_join("shared", ",").alias("shared"))


def p8_potential_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.profile(interactions(spark, sf_dir), items(spark, sf_dir))
    return R.potential_users(p, "PROMO", 0.3).select("user_id", F.round("score", 6).alias("score"))


def p9_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.cold_start(items(spark, sf_dir), ["STANDARD", "PROMO"], 1000, 1300, ["Brand#11"])
    return R.explain(s).groupBy("explanation").agg(F.count("*").alias("n"))


def p10_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(R.price_band(F.col("price"), 1000, 1500).alias("band")).agg(F.count("*").alias("n"))


def l19_late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two searches, weighted and added by id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    one, two = (knn.search(e, asked, 10, m).select("query_id", "id", V.similarity("distance", m).alias("score")) for m in ("cosine", "manhattan"))
    return R.fuse([(one, 0.7), (two, 0.3)], ["query_id", "id"]).select("query_id", "id", F.round("score", 6).alias("score"))


def t12_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir).select((F.col("item_id") % 20).alias("user_id"), "item_id", (F.pmod(F.col("item_id") * 7919, F.lit(1000)) / 1000.0).alias("score"))
    return R.diversify(base, items(spark, sf_dir)).select("user_id", "item_id", F.round("score", 6).alias("score"))


FUNCTIONS = (p1_by_users, p2_by_items, a44_profile, a44_attribute_profile, p3_by_content, p4_hybrid, p5_realtime, p6_popular, p6_cold_start, p7_similar_items, p8_potential_users, p9_explanations, p10_price_band, l19_late_fusion, t12_diversity)
QUERIES |= {f.__name__: f for f in FUNCTIONS}

#: Each user's nearest five by cosine over counts of brands.
P1 = """, cnt as (select user_id, brand, count(*)::double as n from inter join items using (item_id) group by 1, 2), nrm as (select user_id, sum(n * n) as q from cnt group by 1),
pair as (select a.user_id, b.user_id as other, sum(a.n * b.n) as dot from cnt a join cnt b on a.brand = b.brand and a.user_id <> b.user_id group by 1, 2),
rk as (select p.user_id, p.other, 1 - dot / (sqrt(x.q) * sqrt(y.q)) as distance, row_number() over (partition by p.user_id order by 1 - dot / (sqrt(x.q) * sqrt(y.q)), p.other) as k from pair p join nrm x on x.user_id = p.user_id join nrm y on y.user_id = p.other),
s as (select n.user_id, l.item_id, sum(1 - n.distance) as score from rk n join (select distinct user_id as other, item_id from inter) l using (other) where k <= 5 group by 1, 2), u as (select * from s anti join inter using (user_id, item_id)), near as (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank from u)"""
ORACLES["p1_by_users"] = f"{SQL}{P1} select user_id, rank, item_id, round(score, 6) as score from near where rank <= 3"
ORACLES["p2_by_items"] = f"""{SQL}, e as (select vec_id as id, cast(embedding as double[]) as v, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings),
d as (select a.id as item_id, b.id as other, list_inner_product(a.v, b.v) / (a.n * b.n) as similarity from e a, e b where a.id <> b.id), k as (select *, row_number() over (partition by item_id order by 1 - similarity, other) as k from d),
s as (select t.user_id, k.other as item_id, sum(similarity) as score from (select distinct user_id, item_id from inter) t join k using (item_id) where k <= 10 group by 1, 2),
u as (select * from s anti join inter using (user_id, item_id)), b as (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank from u) select user_id, rank, item_id, round(score, 6) as score from b where rank <= 3"""
ORACLES["a44_profile"] = f"{SQL} select user_id, category, cast(weight as double) as weight from prof"
ORACLES["a44_attribute_profile"] = f"{SQL}, l as (select item_id, unnest(attributes) as attribute from items) select user_id, attribute, round(count(*) * 0.3, 6) as weight from inter join l using (item_id) group by 1, 2"
P3 = """, sh as (select user_id, category, weight / max(weight) over (partition by user_id) as share from prof),
co as (select user_id, item_id, least(1, 0.4 * share + 0.2 * (case when ends_with(brand, '1') then 1.0 else 0.2 end) + 0.2 * (case when price between 1000 and 1500 then 1.0 when price between 500 and 2250 then 0.5 else 0 end) + 0.2 * (item_id % 10 / 10.0)) as score from sh join items using (category)),
cs as (select * from co where round(score, 9) > 0.5)"""
ORACLES["p3_by_content"] = f"{SQL}{P3}, b as (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank from cs) select user_id, rank, item_id, round(score, 6) as score from b where rank <= 5"
ORACLES["p5_realtime"] = f"{SQL} select item_id, round((item_id % 100 / 100.0) * case when category = 'ECONOMY' then 1.2 else 1 end * case when price < 1200 then 1.1 else 1 end * case when category = 'STANDARD' then 1.3 else 1 end * case when category = 'PROMO' then 1.5 else 1 end, 6) as score from items"
ORACLES["p6_popular"] = f"{SQL}, c as (select item_id, count(*) as n from inter group by 1), r as (select *, row_number() over (order by n desc, item_id) as rank from c) select rank, item_id, n from r where rank <= 10"
COLD = "case when category in ('STANDARD', 'PROMO') then 0.5 else 0 end + case when price between 1000 and 1300 then 0.3 else 0 end + case when brand in (%s) then 0.2 else 0 end"
_TWO, _ONE = COLD % "'Brand#11', 'Brand#12'", COLD % "'Brand#11'"
ORACLES["p6_cold_start"] = f"{SQL} select item_id, round({_TWO}, 6) as score from items"
ORACLES["p8_potential_users"] = f"{SQL}, s as (select user_id, sum(case when category = 'PROMO' then weight else 0 end) / sum(weight) as score from prof group by 1) select user_id, round(score, 6) as score from s where score > 0.3"
ORACLES["p9_explanations"] = f"{SQL}, s as (select {_ONE} as score from items) select 'This item ' || case when score >= 0.8 then 'strongly matches' when score >= 0.5 then 'matches' else 'may suit' end || ' your interests' as explanation, count(*) as n from s group by 1"
ORACLES["p10_price_band"] = f"{SQL} select case when price between 1000 and 1500 then 1.0 when price between 500 and 2250 then 0.5 else 0 end as band, count(*) as n from items group by 1"
ORACLES["t12_diversity"] = f"{SQL}, s as (select item_id % 20 as user_id, item_id, category, item_id * 7919 % 1000 / 1000.0 as score from items), r as (select *, row_number() over (partition by user_id, category order by score desc, item_id) - 1 as before from s) select user_id, item_id, round(score * greatest(0, 1 - 0.3 * before * 0.1), 6) as score from r"
ORACLES["p4_hybrid"] = f"""{SQL}{P1}{P3}, mx as (select user_id, item_id, sum(s) as score from (select user_id, item_id, 0.6 * score as s from cs union all select user_id, item_id, 0.4 * score from near where rank <= 50) group by 1, 2),
pc as (select item_id, count(*) as n from inter group by 1), bo as (select user_id, item_id, category, round(score + 0.1 * coalesce(n, 0) / (select max(n) from pc), 9) as score from mx join items using (item_id) left join pc using (item_id)),
dv as (select user_id, item_id, score * greatest(0, 1 - 0.03 * (row_number() over (partition by user_id, category order by score desc, item_id) - 1)) as score from bo),
b as (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank from dv) select user_id, rank, item_id, round(score, 5) as score from b where rank <= 5"""
_E = "e as (select vec_id as id, cast(embedding as double[]) as v, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings)"
ORACLES["p7_similar_items"] = f"""{SQL}, {_E}, t as (select * from e join items on item_id = id), d as (select a.id as query_id, b.id, 1 - list_inner_product(a.v, b.v) / (a.n * b.n) as distance, array_to_string(list_sort(list_intersect(a.attributes, b.attributes)), ',') as shared from t a, t b where a.id <= 5),
r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, rank, id, coalesce(nullif(round(distance, 6), 0), 0) as distance, shared from r where rank <= 5"""
ORACLES["l19_late_fusion"] = f"""with {_E}, d as (select a.id as query_id, b.id, 1 - list_inner_product(a.v, b.v) / (a.n * b.n) as c, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) as m from e a, e b where a.id < 5),
r as (select *, row_number() over (partition by query_id order by c, id) as r1, row_number() over (partition by query_id order by m, id) as r2 from d)
select query_id, id, round(case when r1 <= 10 then 0.7 * (1 - c) else 0 end + case when r2 <= 10 then 0.3 / (1 + m) else 0 end, 6) as score from r where r1 <= 10 or r2 <= 10"""
