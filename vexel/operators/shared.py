"""The session's shared folder, and tables in it that cut the plan of a loop."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only where all runs in one process, that may be a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vexel-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow batches have at most so many bytes, whatever the texts' lengths.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame | None = None) -> DataFrame | None:
    """The table, for a session whose Arrow batches are no larger than BATCH_BYTES, since workers hold some copies of a batch."""
    spark = df.sparkSession if df is not None else SparkSession.getActiveSession()
    if spark is not None:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key, "64m").strip().lower()).groups()
        if not 0 < int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    return df
