"""Filters F1 to F24 over embeddings (metadata made from id and label), events.props, and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import filters as L
from vexel.functions import vectors as V

QUERIES: dict = {}
ORACLES: dict = {}

#: Ids divisible by 11 have no value; those divisible by 13 no readable metadata.
META_SQL = """
with m as (select vec_id, cast(embedding as double[]) as v, case when vec_id % 13 = 0 then null else 'c' || label end as category,
  case when vec_id % 13 = 0 or vec_id % 11 = 0 then null else cast(vec_id % 120 as varchar) end as val from embeddings),
x as (select vec_id, category, val, sqrt(list_sum(list_transform(v, lambda y: y*y))) as norm, len(list_filter(v, lambda y: y <> 0)) / len(v) as density, v[3] as third from m)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = F.when(F.col("vec_id") % 11 != 0, (F.col("vec_id") % 120).cast("string"))
    meta = F.when(F.col("vec_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("c"), "label").alias("category"), value.alias("val"))))
    return e.select("vec_id", V.doubles("embedding").alias("vector"), meta.alias("metadata"))


def register(name: str, tree: object, sql: str, mode: str = "text") -> None:
    QUERIES[name] = lambda spark, sf_dir: rows(spark, sf_dir).where(L.compile_filter(tree, mode=mode)).select("vec_id")
    ORACLES[name] = f"{META_SQL} select vec_id from x where {sql}"


register("f1_equals", L.Where("category", "equals", "c3"), "category = 'c3'")
register("f1_not_equals", L.Where("val", "not_equals", "7"), "val <> '7'")
register("f2_less_as_text", L.Where("val", "lt", "5"), "val < '5'")
register("f2_range_as_text", L.Every((L.Where("val", "ge", "10"), L.Where("val", "le", "30"))), "val >= '10' and val <= '30'")
register("f2_greater_typed", L.Where("val", "gt", 50), "try_cast(val as double) > 50", "typed")
register("f3_contains", L.Where("val", "contains", "1"), "contains(val, '1')")
register("f3_not_contains", L.Where("val", "not_contains", "1"), "not contains(val, '1')")
register("f4_starts_with", L.Where("category", "starts_with", "c1"), "starts_with(category, 'c1')")
register("f4_ends_with", L.Where("val", "ends_with", "9"), "ends_with(val, '9')")
register("f5_in", L.Where("category", "in", "c1, c2,,c5"), "category in ('c1', 'c2', 'c5')")
register("f5_not_in", L.Where("val", "not_in", "1,2,3"), "val not in ('1', '2', '3')")
register("f6_regex", L.Where("val", "regex", "^[1-3][05]$"), "regexp_matches(val, '^[1-3][05]$')")
register("f6_regex_invalid", L.Where("val", "regex", "(["), "false")
register("f7_magnitude_range", L.VectorRange("magnitude", 0.95, 1.05), "norm between 0.95 and 1.05")
register("f8_density_range", L.VectorRange("density", 0.9, 1.0), "density between 0.9 and 1.0")
register("f9_component_range", L.VectorRange("dimension", 0.0, 0.2, 2), "third between 0.0 and 0.2")
register("f9_component_beyond", L.VectorRange("dimension", 5.0, 6.0, 999), "true")
register("f10_custom", L.Custom(lambda v: F.array_max(v) > 0.3), "vec_id in (select vec_id from m where list_max(v) > 0.3)")
register("f11_and_or", L.Some((L.Every((L.Where("category", "equals", "c1"), L.Where("val", "lt", "5"))), L.Where("category", "equals", "c2"))), "(category = 'c1' and val < '5') or category = 'c2'")
register("f11_not_missing_holds", L.Not((L.Where("val", "equals", "7"), L.Where("category", "equals", "c1"))), "not coalesce(val = '7', false)")
register("f11_empty_trees", L.Every((L.Every(), L.Not(), L.Not((L.Some(),)))), "true")
register("f12_model", L.Model(lambda v: 1 / (1 + F.exp(-5 * v[0])), 0.6), "vec_id in (select vec_id from m where 1 / (1 + exp(-5 * v[1])) >= 0.6)")
register("f13_rule", L.Some((L.Rule("magnitude", 2.0, 0.52), L.Rule("density", 3.0, 0.5), L.Rule("dimension", 0.4, 0.5, 4), L.Rule(None, confidence=0.4))), "norm >= 1.04 or density >= 1.5 or vec_id in (select vec_id from m where v[5] >= 0.2)")
register("f23_parsed", L.parse("category:c4"), "category = 'c4'")


def f24_filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metrics(rows(spark, sf_dir), L.compile_filter(L.Where("category", "in", "c1,c2")))


def f22_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return L.without(r, r.where("vec_id % 3 = 0"), "vec_id").select("vec_id")


def f15_loose_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows by each loose comparison on events.props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))
    kinds = {"same": ("k", "equals", 7), "other": ("k", "not_equals", 7), "both_null": ("none", "equals", None), "missing_other": ("none", "not_equals", "x"), "holds": ("k", "contains", "1"), "above": ("k", "gt", 50), "below": ("k", "lt", 5), "listed": ("k", "in", [1, 2, 3])}
    return e.agg(*(F.count_if(L.loose(F.col(c), op, v)).alias(name) for name, (c, op, v) in kinds.items()))


QUERIES |= {f.__name__: f for f in (f24_filter_metrics, f22_without_ids, f15_loose_comparisons)}
ORACLES["f24_filter_metrics"] = f"{META_SQL} select count(*) as evaluated, count(*) filter (category in ('c1', 'c2')) as passed, count(*) filter (category in ('c1', 'c2')) / count(*) as pass_rate from x"
ORACLES["f22_without_ids"] = "select vec_id from embeddings where vec_id % 3 <> 0"
ORACLES["f15_loose_comparisons"] = """
with e as (select json_extract_string(props, '$.k') as k from events)
select count(*) filter (k = '7') as same, count(*) filter (k is distinct from '7') as other, count(*) as both_null, count(*) as missing_other, count(*) filter (contains(k, '1')) as holds,
  count(*) filter (try_cast(k as double) > 50) as above, count(*) filter (try_cast(k as double) < 5) as below, count(*) filter (k in ('1', '2', '3')) as listed from e"""
