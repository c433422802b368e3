"""The rollup as a stream over a file source: the same aggregate with a watermark and tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.nulls import clean


def stream_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and sum of squares by key and window; state older than the watermark is dropped."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    v = clean(value)
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sum_sq")]
    return timed.groupBy(F.window("__ts", window).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), *keys, "n", "sum", "sum_sq")


def run_once(out: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there, then stop; complete windows are appended."""
    out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
