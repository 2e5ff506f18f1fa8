"""URL filters: a temporal list join with DataFrame operations only.

Lists are dated events: (list_name, domain, on_date, action), action `add` or `remove`. Each add holds from its date until
the next event of its list and domain (on one date removes come last), which gives validity intervals. A capture is
evaluated against the entries that were active on the day of its fetch: those of its host and of every parent domain.
The most specific domain decides; on one domain `allow` lists win over others, then the first name.

What decides depends on host and date alone, so each pair of them is decided once, whatever its number of captures. The join
is on the domain, the date is compared within: few intervals (counted first) are broadcast; else pairs are dealt by (domain,
salt) over `salts` tasks, and the intervals copied to each salt. Captures then take their pair's decision: few decisions are
broadcast, and captures don't move; else both are shuffled by host and date.

Captures without host or fetch date, or whose host no active entry names, are not blocked; list_name and domain are null.
Events with a null field or another action are ignored; repeated events count once. Repeated captures come out each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.session import small, written

BROADCAST_ROWS, SALTS = 500_000, 32


def host_of(url: Column) -> Column:
    """The lower-case host of a URL with scheme, without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, down to the last label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """list_name, domain, valid_from, valid_to (exclusive, null: open)."""
    sound = events.select("list_name", F.lower("domain").alias("domain"), F.col("on_date").cast("date").alias("valid_from"), "action")
    sound = sound.dropna().where(F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("list_name", "domain").orderBy("valid_from", "action")
    found = sound.withColumn("valid_to", F.lead("valid_from").over(order)).where("action = 'add'").drop("action")
    return found.where("valid_to is null or valid_to > valid_from")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on", broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """The captures with host, blocked, list_name and domain (what decided)."""
    own = [c for c in captures.columns if c not in ("host", "blocked", "list_name", "domain")]
    held = captures.select(F.struct(*own).alias("__row"), host_of(F.col(url)).alias("__host"), F.col(fetched).cast("date").alias("__on"))
    entries = intervals(events)
    pairs = held.select("__host", "__on").dropna().distinct()
    asked = pairs.withColumn("__domain", F.explode(domains_of(F.col("__host"))))
    if entries.limit(broadcast_rows + 1).count() <= broadcast_rows:
        entries = F.broadcast(entries)
        on = F.col("__domain") == F.col("domain")
    else:
        entries = entries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.withColumn("__s", F.pmod(F.xxhash64("__host", "__on"), F.lit(salts)).cast("int"))
        on = (F.col("__domain") == F.col("domain")) & (F.col("__s") == F.col("__salt"))
    active = (F.col("__on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__on") < F.col("valid_to")))
    met = asked.join(entries, on & active)
    # The least of these decides: more labels first, then allow lists, then the name.
    rank = F.struct((-F.size(F.split("domain", r"\."))).alias("labels"), F.when(F.col("list_name") == "allow", 0).otherwise(1).alias("kind"), "list_name", "domain")
    decided = written(met.groupBy("__host", "__on").agg(F.min(rank).alias("__best")), "decisions")
    found = held.join(small(decided, broadcast_rows), ["__host", "__on"], "left")
    return found.select("__row.*", F.col("__host").alias("host"), F.coalesce(F.col("__best.kind") == 1, F.lit(False)).alias("blocked"), F.col("__best.list_name").alias("list_name"), F.col("__best.domain").alias("domain"))
