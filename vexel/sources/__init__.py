"""Readers and writers of vector tables: JSON, JSON lines, CSV, Parquet."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


EXTENSIONS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".parquet": "parquet", ".bin": "parquet", ".h5": "hdf5", ".hdf5": "hdf5"}


def format_of(path: str, first: str = "", default: str = "parquet") -> str:
    """By extension (a final .gz aside), else by the first character: [ JSON, { JSON lines, letters or digits CSV."""
    m = re.search(r"(\.[a-z0-9]+?)(\.gz)?/?$", path.lower())
    if m and m[1] in EXTENSIONS:
        return EXTENSIONS[m[1]]
    start = first.lstrip()[:1]
    return {"[": "json", "{": "jsonl"}.get(start, "csv" if start.isalnum() or start == '"' else default)


def read_json(spark: SparkSession, path: str, id_field: str = "id", vector_field: str = "vector", metadata_field: str = "metadata", lines: bool = False) -> DataFrame:
    """id, vector, metadata (JSON string) from an array of objects, or one object a line. Unreadable rows have a null id."""
    schema = T.StructType([T.StructField(id_field, T.StringType()), T.StructField(vector_field, T.ArrayType(T.DoubleType())), T.StructField(metadata_field, T.MapType(T.StringType(), T.StringType()))])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.col(id_field).alias("id"), F.col(vector_field).alias("vector"), F.to_json(metadata_field).alias("metadata"))


def read_csv(spark: SparkSession, path: str, id_col: str = "id", prefix: str = "dim_") -> DataFrame:
    """id, vector of the columns dim_0, dim_1, …, and the other columns as metadata (JSON string)."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    dims = sorted((c for c in rows.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)), key=lambda c: int(c[len(prefix) :]))
    rest = [c for c in rows.columns if c not in dims and c != id_col]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(F.col(id_col).alias("id"), F.array(*(F.col(c).try_cast("double") for c in dims)).alias("vector"), meta.alias("metadata"))


def first_character(spark: SparkSession, path: str) -> str:
    """The first character that isn't white space, from the start of one file."""
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    return head["c"] if head else ""


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """By extension, else by the first character."""
    kind = format_of(path, default="")
    if not kind:
        kind = format_of(path, first_character(spark, path))
    if kind == "hdf5":
        raise ValueError("HDF5 isn't supported")
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_csv(spark, path, **options) if kind == "csv" else read_json(spark, path, lines=kind == "jsonl", **options)  # type: ignore[arg-type]


def import_rows(rows: DataFrame, dimension: int, check_dimension: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows of an import, and error, n: how many rows have no id, no vector, or one of another dimension."""
    wrong = (F.size("vector") != dimension) if check_dimension else F.lit(False)
    error = F.when(F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == ""), "no id").when(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull()), "no vector").when(wrong, "wrong dimension")
    marked = rows.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def write_json(rows: DataFrame, path: str, vectors: bool = True, metadata: bool = True, gzip: bool = False) -> dict[str, object]:
    """One object a line; returns the manifest: version, dimensions, count."""
    keep = [c for c in rows.columns if (vectors or c != "vector") and (metadata or c != "metadata")]
    rows.select(*keep).write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)
    size = rows.select(F.max(F.size("vector")).alias("d"), F.count("*").alias("n")).first()
    manifest = {"version": 1, "dimensions": size["d"], "count": size["n"]}
    rows.sparkSession.createDataFrame([(1, size["d"], size["n"])], "version int, dimensions int, count long").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.manifest")
    return manifest


def read_queries(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """query_id, query from a file: a bare array or an object with vector and id a line, or one JSON value for the whole file.

    Queries without id are named by their order of reading.
    """
    rows = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    bare, named = F.from_json("value", "array<double>"), F.from_json("value", "id string, vector array<double>")
    numbered = rows.withColumn("__n", F.monotonically_increasing_id()).select("__n", bare.alias("bare"), named.alias("named"))
    vector = F.when(F.size("named.vector") > 0, F.col("named.vector")).otherwise(F.col("bare"))
    return numbered.select(F.coalesce("named.id", F.col("__n").cast("string")).alias("query_id"), vector.alias("query")).where("query is not null")


def write_csv(rows: DataFrame, path: str, dimension: int, keys: list[str] | None = None, gzip: bool = False) -> None:
    """id, dim_0 …, and the metadata's keys in order."""
    meta = [F.get_json_object("metadata", f"$['{k}']").alias(k) for k in sorted(keys or [])]
    dims = [F.col("vector")[i].alias(f"dim_{i}") for i in range(dimension)]
    rows.select("id", *dims, *meta).write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, header=True)


def parse_queries(spark: SparkSession, text: str) -> DataFrame:
    """query_id, query from inline JSON: one array of numbers, an array of arrays, or objects with vector and id."""
    found = json.loads(text)
    if isinstance(found, dict) or (found and not isinstance(found[0], (list, dict))):
        found = [found]
    rows = [(str(x.get("id", i)), [float(v) for v in x["vector"]]) if isinstance(x, dict) else (str(i), [float(v) for v in x]) for i, x in enumerate(found)]
    return spark.createDataFrame(rows, "query_id string, query array<double>")


def result_table(ranked: DataFrame) -> DataFrame:
    """rank, id, distance, score (1 - distance) in order."""
    return ranked.select("query_id", "rank", "id", "distance", (1.0 - F.col("distance")).alias("score")).orderBy("query_id", "rank")


def base64_row(columns: list[str]) -> Column:
    """A row as base64 of its JSON."""
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


__all__ = ["format_of", "first_character", "import_rows", "read", "read_queries", "read_csv", "read_json", "write_csv", "write_json", "parse_queries", "result_table", "base64_row"]
