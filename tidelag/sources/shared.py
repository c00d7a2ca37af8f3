"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``; a folder of our own only in local mode, where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete those of the tables that are staged: nothing reads them any more."""
    for table in tables:
        if (at := getattr(table, "staged_at", None)) is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
