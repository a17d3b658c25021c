"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: an own temporary folder if all runs in one process, as in tests; on a
    cluster, whose executors would each write to a disk of their own, an error."""
    base = spark.conf.get(_CHECKPOINT, None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark_")
        spark.conf.set(_CHECKPOINT, base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
