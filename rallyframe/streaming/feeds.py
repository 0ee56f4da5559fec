"""Structured Streaming forms: micro-batches over files, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import upsert


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder; which were read is in the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduped(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark; state is dropped beyond it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def price_buckets(stream: DataFrame, keys: list[str], time: str, price: str, width: str = "15 minutes", delay: str | None = "30 minutes") -> DataFrame:
    """Open, close, low, high and count per key and time bucket. ``delay`` None:
    the stream has its watermark already."""
    marked = stream.withWatermark(time, delay) if delay else stream
    return (marked.groupBy(*keys, F.window(time, width).alias("_w"))
            .agg(F.min_by(price, time).alias("open"), F.max_by(price, time).alias("close"), F.min(price).alias("low"), F.max(price).alias("high"), F.count(price).alias("n"))
            .select(*keys, F.col("_w.start").alias("bucket"), "open", "close", "low", "high", "n"))


def before_start(stream: DataFrame, time: str, start: str) -> DataFrame:
    """Quotes from before the match; those with no known start count as before."""
    return stream.where(F.col(start).isNull() | (F.col(time) < F.col(start)))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop, as a scheduled tick does."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts that an upsert target is split into by its keys' hash.
BUCKETS = 64


def upsert_target(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a table kept by ``run_upserts``."""
    return spark.read.parquet(target).drop("_bucket")


def run_upserts(stream: DataFrame, target: str, keys: list[str], version: str, tie: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Merge each micro-batch into a parquet table by key. The table lies in
    ``buckets`` partitions by the hash of its keys; a batch reads and replaces
    only those that it touches. A batch that is replayed after a failure changes
    nothing, as the newest row wins."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = T.StructType([*stream.schema.fields, T.StructField("_bucket", T.IntegerType())])

    def merge(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("_bucket", bucket).persist()
        try:
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
            if not touched:
                return
            try:
                current = spark.read.schema(schema).parquet(target).where(F.col("_bucket").isin(touched))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                current = spark.createDataFrame([], schema)
            merged = upsert(current, fresh.unionByName(current), keys, version, tie)
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(target)
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
