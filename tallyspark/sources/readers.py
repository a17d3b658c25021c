"""Readers and writers of result tables. Everything goes through Spark's own readers, so any store it reaches will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path, schema: str | StructType) -> DataFrame:
    """JSON lines; a bad line fails the read, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines without the bad ones; a missing file is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_array(spark: SparkSession, path, schema: str | StructType) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_glob(spark: SparkSession, pattern: str, schema: str | StructType, dataset: str | None = None) -> DataFrame:
    """All files of a pattern, with `key` from the file's name (metrics_KEY.json), of one dataset if given."""
    t = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)
    t = t.withColumn("key", F.regexp_extract(F.col("_metadata.file_name"), r"^(?:metrics_|predictions_)?(.*?)\.jsonl?$", 1))
    return t if dataset is None else t.filter(F.col("dataset") == dataset)


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file of a pattern that was changed last."""
    t = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return t.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()["p"]


def thresholds(spark: SparkSession, path: str, model: str, strict: bool = False) -> dict[str, float]:
    """A model's thresholds; without any, the defaults, or an error if strict."""
    t = read_lenient(spark, path, "model string, tau_e double, tau_d double").filter(F.col("model") == model).limit(1).collect()
    if not t and strict:
        raise KeyError(model)
    row = t[0].asDict() if t else {}
    return {"tau_e": 1.5 if row.get("tau_e") is None else row["tau_e"], "tau_d": 0.3 if row.get("tau_d") is None else row["tau_d"]}


def todo(problems: DataFrame, done: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems whose key isn't done yet."""
    return problems.join(done.select(key).distinct(), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows; files of a failed task are never seen."""
    rows.write.mode("append").json(path)


def overwrite(rows: DataFrame, path: str) -> None:
    """K02 K11 S19."""
    rows.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame) -> str:
    """A table of one row as indented JSON text."""
    return json.dumps(json.loads(metrics.toJSON().first()), indent=2)


def upsert(old: DataFrame, new: DataFrame, key: list[str], merge: bool = True) -> DataFrame:
    """Rows of new replace those of old with their key; with merge, columns that are NULL in new stay as they were."""
    if not merge:
        return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    a, b = old.alias("a"), new.alias("b")
    t = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, d in (("b", new), ("a", old)) if c in d.columns]).alias(c)
    return t.select(*[pick(c) for c in [*key, *rest]])


def scatter_rows(rows: DataFrame, d1: str = "d1") -> DataFrame:
    """Rows with a known number of disputes, flags as integers."""
    flags = [c for c, t in rows.dtypes if t == "boolean"]
    return rows.filter(F.col(d1) >= 0).withColumns({c: F.col(c).cast("int") for c in flags})


def run_id(model: str, dataset: str, mode: str):
    """MODEL_DATASET_MODE_TIMESTAMP, the model without its owner."""
    return F.concat_ws("_", F.lit(model.rsplit("/", 1)[-1]), F.lit(dataset), F.lit(mode), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
