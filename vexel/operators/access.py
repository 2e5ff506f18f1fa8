"""Analytics of an access log (key, ts, and size in bytes): temperature, rates, patterns, sequences, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(t: Column | str) -> Column:
    """Seconds since 1970; times without zone are taken in the session's."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp")) / 1e6


def _key_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("accesses"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("size").alias("size"))


def temperature_of(hours: Column, rate: Column, size: Column) -> Column:
    """From hours since the last access, accesses an hour, and size in bytes."""
    return 0.5 * F.exp(-hours / 24.0) + 0.3 * F.least(rate / 10.0, F.lit(1.0)) + 0.2 / (1.0 + size / (10.0 * 1024 * 1024))


def temperatures(log: DataFrame, as_of: Column) -> DataFrame:
    """key, accesses, size, hours, rate, temperature at a moment. An age below an hour counts as one."""
    s = _key_stats(log)
    age = F.greatest((seconds(as_of) - seconds("first")) / 3600.0, F.lit(1.0))
    hours = F.greatest((seconds(as_of) - seconds("last")) / 3600.0, F.lit(0.0))
    s = s.select("key", "accesses", "size", hours.alias("hours"), (F.col("accesses") / age).alias("rate"))
    return s.withColumn("temperature", temperature_of(F.col("hours"), F.col("rate"), F.col("size")))


def rates(log: DataFrame, as_of: Column) -> DataFrame:
    """key, last_hour, last_day, last_week: accesses in whole hour buckets."""
    hour = F.date_trunc("hour", "ts")
    back = (seconds(F.date_trunc("hour", as_of)) - seconds(hour)) / 3600.0
    buckets = log.groupBy("key", back.alias("back")).agg(F.count("*").alias("n"))
    within = lambda h: F.sum(F.when((F.col("back") >= 0) & (F.col("back") < h), F.col("n")).otherwise(0))
    return buckets.groupBy("key").agg(within(1).alias("last_hour"), within(24).alias("last_day"), within(168).alias("last_week"))


def scores(log: DataFrame, as_of: Column) -> DataFrame:
    """key, score: half the accesses an hour, 0.3 over hours since the last, 0.2 over megabytes (each at least 1)."""
    s = _key_stats(log)
    age = F.greatest((seconds(as_of) - seconds("first")) / 3600.0, F.lit(1.0))
    since = F.greatest((seconds(as_of) - seconds("last")) / 3600.0, F.lit(1.0))
    mega = F.greatest(F.col("size") / (1024.0 * 1024.0), F.lit(1.0))
    return s.select("key", (0.5 * F.col("accesses") / age + 0.3 / since + 0.2 / mega).alias("score"))


def patterns(log: DataFrame, as_of: Column) -> DataFrame:
    """key, frequency (an hour), recency (0 to 1), regularity, burstiness from the gaps between accesses."""
    gap = seconds("ts") - seconds(F.lag("ts").over(Window.partitionBy("key").orderBy("ts")))
    s = log.withColumn("gap", gap).groupBy("key").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    age = F.greatest((seconds(as_of) - seconds("first")) / 3600.0, F.lit(1.0))
    mean, sd = F.coalesce("mean", F.lit(0.0)), F.coalesce("sd", F.lit(0.0))
    return s.select("key", (F.col("n") / age).alias("frequency"), F.exp(-(seconds(as_of) - seconds("last")) / 86400.0).alias("recency"), F.when(mean > 0, 1.0 / (1.0 + sd / mean)).otherwise(0.0).alias("regularity"), F.when(sd + mean > 0, (sd - mean) / (sd + mean)).otherwise(0.0).alias("burstiness"))


def hot_and_cold(log: DataFrame, hot_share: float = 0.2, cold: int = 2) -> DataFrame:
    """key, accesses, heat: hot from the count on that the top share of keys reaches, cold up to `cold` accesses, else warm."""
    counts = log.groupBy("key").agg(F.count("*").alias("accesses"))
    # The count at the share's edge, from the histogram of counts: small, whatever the number of keys.
    histogram = counts.groupBy("accesses").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("accesses")))
    edges = histogram.withColumns({"upto": upto, "keys": F.sum("n").over(Window.partitionBy())})
    edge = edges.where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("keys") * hot_share))).agg(F.max("accesses").alias("edge"))
    return counts.crossJoin(F.broadcast(edge)).select("key", "accesses", F.when(F.col("accesses") >= F.col("edge"), "hot").when(F.col("accesses") <= cold, "cold").otherwise("warm").alias("heat"))


def runs(log: DataFrame, gap: float = 0.1, least: int = 3) -> DataFrame:
    """key, run, length, started: runs of accesses closer together than the gap (seconds), of at least so many."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    new = F.when((seconds("ts") - seconds(F.lag("ts").over(w))) < gap, 0).otherwise(1)
    marked = log.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "run").agg(F.count("*").alias("length"), F.min("ts").alias("started")).where(F.col("length") >= least)


def reuse(log: DataFrame, within: float = 60.0) -> DataFrame:
    """accesses, reused, share: accesses whose key was accessed within so many seconds before."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    near = F.coalesce((seconds("ts") - seconds(F.lag("ts").over(w))) <= within, F.lit(False))
    return log.select(near.alias("near")).agg(F.count("*").alias("accesses"), F.count_if("near").alias("reused")).withColumn("share", F.col("reused") / F.nullif(F.col("accesses"), F.lit(0)))


def transitions(log: DataFrame, by: str, least: float = 0.0) -> DataFrame:
    """prev, key, n, share: how often an access to one key follows another within a sequence (column `by`), of all that follow it."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    pairs = log.withColumn("prev", F.lag("key").over(w)).where("prev is not null").groupBy("prev", "key").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("prev"))
    return pairs.withColumn("share", share).where(F.col("share") > least)


def related(log: DataFrame, by: str, top: int = 3) -> DataFrame:
    """prev, rank, key, n: the most frequent followers of each key."""
    w = Window.partitionBy("prev").orderBy(F.desc("n"), "key")
    return transitions(log, by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("prev", "rank", "key", "n")


def tracker_statistics(temps: DataFrame, hot: float = 0.7, cold: float = 0.3) -> DataFrame:
    """keys, average temperature, hot and cold keys."""
    return temps.agg(F.count("*").alias("keys"), F.avg("temperature").alias("average"), F.count_if(F.col("temperature") > hot).alias("hot"), F.count_if(F.col("temperature") < cold).alias("cold"))


def hottest(temps: DataFrame, n: int) -> DataFrame:
    return temps.orderBy(F.desc("temperature"), "key").limit(n)


def migration_candidates(temps: DataFrame, n: int) -> DataFrame:
    """Those whose temperature is farthest from the middle."""
    return temps.withColumn("distance", F.abs(F.col("temperature") - 0.5)).orderBy(F.desc("distance"), "key").limit(n)


def migrations(temps: DataFrame, promote: float = 0.7, demote: float = 0.3) -> DataFrame:
    """key, temperature, decision: promote, demote or keep; keys accessed within the last hour stay."""
    t = F.col("temperature")
    moved = F.when(F.col("hours") < 1, "keep").when(t > promote, "promote").when(t < demote, "demote").otherwise("keep")
    return temps.select("key", "temperature", moved.alias("decision"))


def prefetch(log: DataFrame, by: str, top: int = 3, least: float = 0.2) -> DataFrame:
    """prev, key, share: what to fetch after a key, by transitions above the share."""
    w = Window.partitionBy("prev").orderBy(F.desc("share"), "key")
    return transitions(log, by, least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("prev", "key", "share")


def prefetch_next(log: DataFrame, by: str, within: float = 3600.0, top: int = 3) -> DataFrame:
    """prev, key, n by time: the keys accessed most often within so many seconds after a key, in the same sequence, next but itself."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    steps = log.select("key", "ts", *(F.lead(F.struct("key", "ts"), i).over(w).alias(f"n{i}") for i in range(1, 4)))
    later = steps.select("key", "ts", F.explode(F.array("n1", "n2", "n3")).alias("x")).where((seconds("x.ts") - seconds("ts") <= within) & (F.col("x.key") != F.col("key")))
    counts = later.select(F.col("key").alias("prev"), F.col("x.key").alias("key")).groupBy("prev", "key").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "key"))).where(F.col("r") <= top).drop("r")


def prefetch_sequence(log: DataFrame, ahead: int = 3, least: int = 3) -> DataFrame:
    """key, step, next: for keys that end a run of at least `least` accesses with one stride between numbers, the keys that would follow."""
    w = Window.partitionBy("stream").orderBy("ts", "event_id")
    gaps = log.withColumn("stride", F.col("key") - F.lag("key").over(w)).withColumn("new", F.when(F.col("stride") == F.lag("stride").over(w), 0).otherwise(1))
    runs = gaps.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("stride != 0")
    ends = runs.groupBy("stream", "run").agg(F.count("*").alias("length"), F.max_by("key", F.struct("ts", "event_id")).alias("key"), F.first("stride").alias("stride")).where(F.col("length") >= least - 1)
    return ends.select("stream", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.col("key") + i * F.col("stride"))).alias("step", "next")).withColumn("step", F.col("step") + 1)


def prefetch_frequent(log: DataFrame, top: int) -> DataFrame:
    """rank, key, n: the keys accessed most."""
    counts = log.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "key"))).select("rank", "key", "n")
