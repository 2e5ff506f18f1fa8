"""A vector store as a table: validation, upsert, update, delete, bulk load, lookups, tiers, eviction, snapshots, checks.

The canonical columns are id, vector and any others. Every operation gives a new table; `Store` keeps versions as Parquet
folders, each written in full before it becomes current, so a failed load leaves the store as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators.running import running_total


def problem(dimension: int, id_col: str = "id", vector: str = "vector") -> Column:
    """What is wrong with a row: empty_id, missing_vector, wrong_dimension, not_finite; null if nothing."""
    v = V.doubles(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    text = F.col(id_col).cast("string")
    return F.when(text.isNull() | (F.trim(text) == ""), "empty_id").when(F.col(vector).isNull(), "missing_vector").when(F.size(vector) != dimension, "wrong_dimension").when(F.coalesce(bad, F.lit(True)), "not_finite")


def split(rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with column problem."""
    checked = rows.withColumn("problem", problem(dimension))
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def latest(rows: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Of each id the row that comes last by the order column; of equally late ones the one whose columns, as text, hash lowest."""
    w = Window.partitionBy(id_col).orderBy(F.desc(order), F.xxhash64(*rows.columns))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(table: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """New rows replace those with their id."""
    return table.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def update(table: DataFrame, changes: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Columns take the changes' values where these aren't null."""
    fresh = changes.select(id_col, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(fresh, id_col, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return table.join(ids.select(id_col).distinct(), id_col, "left_anti")


def mark_deleted(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Sets column deleted; compact() drops such rows."""
    gone = ids.select(id_col).distinct().withColumn("__gone", F.lit(True))
    return table.join(gone, id_col, "left").withColumn("deleted", F.coalesce("__gone", F.lit(False))).drop("__gone")


def compact(table: DataFrame) -> DataFrame:
    return table.where("not deleted").drop("deleted")


def lookup(table: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """The rows of the ids, in the order asked (column position); unknown ids have none."""
    asked = table.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{id_col} {table.schema[id_col].dataType.simpleString()}, position int")
    return table.join(F.broadcast(asked) if len(ids) <= 100_000 else asked, id_col).orderBy("position")


def with_prefix(table: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    return table.where(F.col(id_col).startswith(prefix))


def contains(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids with column found."""
    known = table.select(id_col).distinct().withColumn("__f", F.lit(True))
    return ids.join(known, id_col, "left").select(id_col, F.coalesce("__f", F.lit(False)).alias("found"))


def page(table: DataFrame, where: Column | None, order: str, offset: int, limit: int) -> DataFrame:
    """Filter, then order, then skip, then take."""
    rows = table.where(where) if where is not None else table
    return rows.orderBy(order).offset(offset).limit(limit)


def tier(size: Column, priority: Column, memory_limit: int) -> Column:
    """Where an item goes first: by priority if it fits into memory, else by size."""
    mega = 1024 * 1024
    return F.when(priority.isin("high", "critical") & (size <= memory_limit), "memory").when(size > 10 * mega, "archive").when(size > mega, "ssd").when(size <= memory_limit, "memory").otherwise("ssd")


def tiers(items: DataFrame, memory_limit: int) -> DataFrame:
    return items.withColumn("tier", tier(F.col("size"), F.col("priority"), memory_limit))


def tier_statistics(items: DataFrame) -> DataFrame:
    """tier, items, bytes, average."""
    return items.groupBy("tier").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"), F.avg("size").alias("average"))


NEXT_UP, NEXT_DOWN = {"archive": "ssd", "ssd": "memory"}, {"memory": "ssd", "ssd": "archive"}


def migrated(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """The items with their tier after one cycle: promote and demote (by id) move it by one step; moved says which ones."""
    step = lambda table: F.coalesce(*(F.when(F.col("tier") == a, b) for a, b in table.items()), F.col("tier"))
    joined = items.join(decisions.select("id", "decision"), "id", "left")
    new = F.when(F.col("decision") == "promote", step(NEXT_UP)).when(F.col("decision") == "demote", step(NEXT_DOWN)).otherwise(F.col("tier"))
    return joined.withColumn("__new", new).withColumn("moved", F.col("__new") != F.col("tier")).withColumn("tier", F.col("__new")).drop("__new", "decision")


def write_by_tier(items: DataFrame, path: str) -> None:
    """One folder for each tier."""
    items.repartition("tier").write.partitionBy("tier").parquet(path)


def fingerprint(table: DataFrame) -> DataFrame:
    """rows, total: the count and a sum of the rows' hashes, which doesn't depend on their order."""
    return table.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")).alias("total"))


def copy_verified(table: DataFrame, path: str) -> DataFrame:
    """Writes the table to another place and reads it again; raises if count or hashes differ."""
    table.write.parquet(path)
    again = table.sparkSession.read.parquet(path)
    if fingerprint(table).first() != fingerprint(again).first():
        raise ValueError(f"the copy in {path} differs")
    return again


def statistics(table: DataFrame) -> DataFrame:
    """rows, ids, dimensions (distinct), bytes (4 a component), missing vectors."""
    return table.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct(F.size("vector")).alias("dimensions"), F.sum(4 * F.size("vector")).alias("bytes"), F.count_if(F.col("vector").isNull()).alias("missing"))


def magnitude_histogram(table: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins; 0 and bins + 1 outside), n of the vectors' magnitudes."""
    return table.select(F.width_bucket(V.magnitude("vector"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def evict(items: DataFrame, need: int, policy: str = "lru", seed: int = 1) -> DataFrame:
    """The items to drop, in order, until they free `need` bytes: least recent, least used, oldest, or by seeded hash."""
    orders = {"lru": F.col("last_access"), "lfu": F.col("accesses"), "fifo": F.col("created"), "random": F.xxhash64("id", F.lit(seed))}
    if policy not in orders:
        raise ValueError(f"no policy {policy!r}")
    ranked = running_total(items.select("id", "size", orders[policy].cast("double").alias("o")), "o", "id", "size", "freed")
    return ranked.where(F.col("freed") - F.col("size") < need).select("id", "size", "freed")


def integrity(items: DataFrame, data: DataFrame, limits: dict[str, int]) -> DataFrame:
    """check, severity, failures: items without data, data without item, tiers above their limit."""
    over = items.groupBy("tier").agg(F.sum("size").alias("bytes"))
    limit = F.create_map(*(x for t, n in limits.items() for x in (F.lit(t), F.lit(n))))
    checks = [("missing_data", "error", items.join(data, "id", "left_anti")), ("orphan_data", "warning", data.join(items, "id", "left_anti")), ("over_limit", "warning", over.where(F.col("bytes") > F.get(F.array(limit[F.col("tier")]), F.lit(0))))]
    return reduce(DataFrame.unionByName, (bad.agg(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.count("*").alias("failures")) for n, s, bad in checks))


def partition_of(key: Column, kind: str, n: int, bounds: list | None = None) -> Column:
    """A partition's number: hash, modulo, range (by upper bounds) or hour of the day."""
    if kind == "hash":
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    if kind == "modulo":
        return F.pmod(key, F.lit(n)).cast("int")
    if kind == "hour":
        return F.floor(F.hour(key) * n / 24).cast("int")
    if kind == "range":
        return reduce(lambda c, b: c + F.when(key >= b, 1).otherwise(0), bounds or [], F.lit(0))
    raise ValueError(f"no partitioning {kind!r}")


@dataclass
class Store:
    """Versions of one table in a folder that all executors share."""

    spark: SparkSession
    path: str
    dimension: int
    counts: dict[str, int] = field(default_factory=dict)

    def versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1] if version is None else version}") if found else None

    def write(self, table: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def load(self, rows: DataFrame, strict: bool = False, skip_duplicates: bool = False) -> dict[str, int]:
        """Adds rows: bad ones are counted (or, with strict, refuse the load); known ids are replaced or skipped."""
        good, bad = split(rows, self.dimension)
        refused = bad.count()
        if strict and refused:
            raise ValueError(f"{refused} rows can't be loaded")
        order = Window.partitionBy("id").orderBy(F.xxhash64(*good.columns))
        good = good.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
        table = self.read()
        known = good.join(table.select("id"), "id", "left_semi").count() if table is not None else 0
        if table is not None:
            good = good.join(table.select("id"), "id", "left_anti") if skip_duplicates else good
            good = upsert(table, good)
        self.write(good)
        self.counts = {"inserted": good.count() - (table.count() if table is not None else 0), "known": known, "errors": refused}
        return self.counts

    def restore(self, version: int) -> int:
        """Makes an earlier version the newest."""
        return self.write(self.read(version))
