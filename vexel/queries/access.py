"""Access analytics A35 to A41, M7, M11 and R6 over events: key = event_type or user, size from value, as of the last event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.operators import access as A

QUERIES: dict = {}
ORACLES: dict = {}

SQL = """with log as (select cast(user_id as varchar) as key, event_type, user_id, event_id, ts, cast(abs(value) * 100000 as bigint) as size, epoch_us(ts) / 1e6 as t from events),
n as (select max(t) as now from log),
k as (select key, count(*) as accesses, min(t) as first, max(t) as last, max(size) as size from log group by 1),
g as (select key, greatest((now - first) / 3600, 1) as age, greatest((now - last) / 3600, 0) as hours, accesses, size, last, now from k, n),
temps as (select key, accesses, size, hours, accesses / age as rate, 0.5 * exp(-hours / 24) + 0.3 * least(accesses / age / 10, 1) + 0.2 / (1 + size / (10.0 * 1024 * 1024)) as temperature from g)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), "event_type", "user_id", "event_id", "ts", F.round(F.abs("value") * 100000).cast("long").alias("size"))


def now(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0])


def temps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.temperatures(log(spark, sf_dir), now(spark, sf_dir))


def r(c: str, n: int = 6) -> Column:
    return F.round(c, n).alias(c)


def a35_hot_and_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hot_and_cold(log(spark, sf_dir))


def a35_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events closer than ten minutes."""
    return A.runs(log(spark, sf_dir), 600.0, 3).groupBy("length").agg(F.count("*").alias("runs"))


def a35_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reuse(log(spark, sf_dir), 3600.0).select("accesses", "reused", r("share"))


def a35_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = log(spark, sf_dir).withColumn("key", F.col("event_type"))
    return A.transitions(typed, "user_id", 0.0).select("prev", "key", "n", r("share"))


def a36_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.related(log(spark, sf_dir).withColumn("key", F.col("event_type")), "user_id", 2)


def a37_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temps(spark, sf_dir).select("key", "accesses", r("temperature"))


def a38_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rates(log(spark, sf_dir), now(spark, sf_dir))


def a39_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scores(log(spark, sf_dir), now(spark, sf_dir)).select("key", r("score"))


def a40_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.patterns(log(spark, sf_dir), now(spark, sf_dir))
    return p.select("key", r("frequency"), r("recency"), r("regularity"), r("burstiness"))


def a41_tracker_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tracker_statistics(temps(spark, sf_dir)).select("keys", r("average"), "hot", "cold")


def t11_hottest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hottest(temps(spark, sf_dir), 10).select("key", r("temperature"))


def t11_migration_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.migration_candidates(temps(spark, sf_dir), 10).select("key", r("distance"))


def m7_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.migrations(temps(spark, sf_dir), 0.4, 0.3).select("key", "decision")


def m11_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = log(spark, sf_dir).withColumn("key", F.col("event_type"))
    return A.prefetch(typed, "user_id", 2, 0.1).select("prev", "key", r("share"))


def r6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps below an hour: how many of each size."""
    s = log(spark, sf_dir).groupBy("key", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.groupBy("n").agg(F.count("*").alias("sessions"))


def m11_prefetch_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = log(spark, sf_dir).withColumn("key", F.col("event_type"))
    return A.prefetch_next(typed, "user_id", 7200.0, 2)


def m11_prefetch_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the orders' numbers by customer, as streams."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    steps = o.select((F.col("o_custkey") % 7).alias("stream"), (F.col("o_orderkey") % 5).alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"))
    return A.prefetch_sequence(steps, 2).groupBy("stream", "key", "step", "next").agg(F.count("*").alias("n"))


def m11_prefetch_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prefetch_frequent(log(spark, sf_dir), 10)


FUNCTIONS = (m11_prefetch_by_time, m11_prefetch_sequence, m11_prefetch_frequent, a35_hot_and_cold, a35_runs, a35_reuse, a35_transitions, a36_related, a37_temperature, a38_rates, a39_scores, a40_patterns, a41_tracker_statistics, t11_hottest, t11_migration_candidates, m7_migrations, m11_prefetch, r6_sessions)
QUERIES |= {f.__name__: f for f in FUNCTIONS}

ORACLES["a35_hot_and_cold"] = f"{SQL}, o as (select accesses, row_number() over (order by accesses desc) as p, count(*) over () as n from k), e as (select max(accesses) as edge from o where p >= greatest(1, floor(n * 0.2))) select key, accesses, case when accesses >= edge then 'hot' when accesses <= 2 then 'cold' else 'warm' end as heat from k, e"
GAPS = f"{SQL}, w as (select *, t - lag(t) over (partition by key order by ts, event_id) as gap from log)"
ORACLES["a35_runs"] = f"{GAPS}, m as (select key, sum(case when gap < 600 then 0 else 1 end) over (partition by key order by ts, event_id) as run from w), c as (select key, run, count(*) as length from m group by 1, 2 having count(*) >= 3) select length, count(*) as runs from c group by 1"
ORACLES["a35_reuse"] = f"{GAPS} select count(*) as accesses, count(*) filter (gap <= 3600) as reused, round(count(*) filter (gap <= 3600) / count(*), 6) as share from w"
TRANS = f"{SQL}, w as (select event_type as key, lag(event_type) over (partition by user_id order by ts, event_id) as prev from log), c as (select prev, key, count(*) as n from w where prev is not null group by 1, 2), s as (select *, n / sum(n) over (partition by prev) as share from c)"
ORACLES["a35_transitions"] = f"{TRANS} select prev, key, n, round(share, 6) as share from s"
ORACLES["a36_related"] = f"{TRANS}, q as (select *, row_number() over (partition by prev order by n desc, key) as rank from s) select prev, rank, key, n from q where rank <= 2"
ORACLES["m11_prefetch"] = f"{TRANS}, q as (select *, row_number() over (partition by prev order by share desc, key) as rank from s where share > 0.1) select prev, key, round(share, 6) as share from q where rank <= 2"
ORACLES["a37_temperature"] = f"{SQL} select key, accesses, round(temperature, 6) as temperature from temps"
ORACLES["a38_rates"] = f"{SQL}, h as (select key, (epoch_us(date_trunc('hour', (select max(ts) from events))) - epoch_us(date_trunc('hour', ts))) / 3.6e9 as back from log) select key, count(*) filter (back < 1) as last_hour, count(*) filter (back < 24) as last_day, count(*) filter (back < 168) as last_week from h group by 1"
ORACLES["a39_scores"] = f"{SQL} select key, round(0.5 * accesses / age + 0.3 / greatest(hours, 1) + 0.2 / greatest(size / (1024.0 * 1024), 1), 6) as score from g"
ORACLES["a40_patterns"] = f"{GAPS}, s as (select key, count(*) as n, coalesce(avg(gap), 0) as mean, coalesce(stddev_pop(gap), 0) as sd from w group by 1) select key, round(n / age, 6) as frequency, round(exp(-(now - last) / 86400), 6) as recency, round(case when mean > 0 then 1 / (1 + sd / mean) else 0 end, 6) as regularity, round(case when sd + mean > 0 then (sd - mean) / (sd + mean) else 0 end, 6) as burstiness from s join g using (key)"
ORACLES["a41_tracker_statistics"] = f"{SQL} select count(*) as keys, round(avg(temperature), 6) as average, count(*) filter (temperature > 0.7) as hot, count(*) filter (temperature < 0.3) as cold from temps"
ORACLES["t11_hottest"] = f"{SQL} select key, round(temperature, 6) as temperature from temps order by temps.temperature desc, key limit 10"
ORACLES["t11_migration_candidates"] = f"{SQL} select key, round(abs(temperature - 0.5), 6) as distance from temps order by abs(temperature - 0.5) desc, key limit 10"
ORACLES["m7_migrations"] = f"{SQL} select key, case when hours < 1 then 'keep' when temperature > 0.4 then 'promote' when temperature < 0.3 then 'demote' else 'keep' end as decision from temps"
ORACLES["r6_sessions"] = f"{GAPS}, m as (select key, sum(case when gap < 3600 then 0 else 1 end) over (partition by key order by ts, event_id) as run from w), c as (select key, run, count(*) as n from m group by 1, 2) select n, count(*) as sessions from c group by 1"
ORACLES["m11_prefetch_by_time"] = f"""{SQL}, w as (select event_type as prev, t, lead(event_type, 1) over v as k1, lead(t, 1) over v as t1, lead(event_type, 2) over v as k2, lead(t, 2) over v as t2, lead(event_type, 3) over v as k3, lead(t, 3) over v as t3 from log window v as (partition by user_id order by ts, event_id)),
l as (select prev, k1 as key, t1 - t as gap from w union all select prev, k2, t2 - t from w union all select prev, k3, t3 - t from w), c as (select prev, key, count(*) as n from l where gap <= 7200 and key <> prev group by 1, 2),
q as (select *, row_number() over (partition by prev order by n desc, key) as r from c) select prev, key, n from q where r <= 2"""
ORACLES["m11_prefetch_sequence"] = """with s as (select o_custkey % 7 as stream, o_orderkey % 5 as key, o_orderdate as ts, o_orderkey as event_id from orders), g as (select *, key - lag(key) over (partition by stream order by ts, event_id) as stride from s),
m as (select *, case when stride = lag(stride) over (partition by stream order by ts, event_id) then 0 else 1 end as new from g), r as (select *, sum(new) over (partition by stream order by ts, event_id rows unbounded preceding) as run from m),
e as (select stream, run, count(*) as length, arg_max(key, (ts, event_id)) as key, any_value(stride) as stride from r where stride <> 0 group by 1, 2 having count(*) >= 2),
x as (select stream, key, unnest([1, 2]) as step, stride from e) select stream, key, step, key + step * stride as next, count(*) as n from x group by 1, 2, 3, 4"""
ORACLES["m11_prefetch_frequent"] = f"{SQL}, c as (select key, count(*) as n from log group by 1), q as (select row_number() over (order by n desc, key) as rank, key, n from c) select * from q where rank <= 10"
