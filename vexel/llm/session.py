"""The session's shared folder, scratch tables in it, and helpers that every operator uses."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs in one process, a temporary one, set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vexel-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: the plan before it is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, wherever the shared one lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Arrow batches have at most so many bytes, whatever the texts' lengths.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The table, for a session whose Arrow batches are no larger than BATCH_BYTES, since workers hold some copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if _bytes(conf.get(key, str(64 << 20))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def _bytes(text: str) -> int:
    """Bytes from a setting such as 67108864b, 64m or 1g."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return (F.crc32(F.col(doc_id).cast("string")) % modulus == remainder).alias("held_out")


def small(df: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
