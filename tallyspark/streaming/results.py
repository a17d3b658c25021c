"""Result lines as a stream (K01, K07): the last line of each (problem, method) counts, reports follow each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import last_wins
from ..sources.readers import upsert

SCHEMA = "problem_id long, method string, correct boolean, total_tokens long, ts timestamp"


def result_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def latest_results(stream: DataFrame, folder: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps folder/<batch> as the table of latest results. A batch that is run again writes its own folder again, from the
    one before, so that each line counts once; publish(table, batch) may derive reports."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = last_wins(rows.filter("problem_id is not null"), ["problem_id", "method"], "ts")
        old = spark.read.schema(new.schema).parquet(f"{folder}/{number - 1}") if number else spark.createDataFrame([], new.schema)
        later = last_wins(old.unionByName(new), ["problem_id", "method"], "ts")
        later.write.mode("overwrite").parquet(f"{folder}/{number}")
        if publish:
            publish(spark.read.parquet(f"{folder}/{number}"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extra, not a parity feature: accuracy by event-time window and method; lines later than delay are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


__all__ = ["latest_results", "result_stream", "upsert", "windowed_counts"]
