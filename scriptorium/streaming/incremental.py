"""Micro-batch incrementality with Structured Streaming: batches of new metadata are merged into the
record table once each, and progress is its own stream of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.operators import records as R
from scriptorium.sources import sinks
from scriptorium.sources.metadata import exists


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, at most so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, batch by batch, resumable at the checkpoint."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(out: str, transform: Callable[[DataFrame], DataFrame], key: str = "arxiv_id") -> Callable[[DataFrame, int], None]:
    """Each batch goes to its own partition of out; a batch that is run again replaces itself. Readers
    take the latest batch of each key (latest), which is the idempotent merge without rewriting old data."""

    def process(batch: DataFrame, batch_id: int) -> None:
        sinks.append_batch(transform(batch), out, batch_id)

    return process


def latest(spark: SparkSession, out: str, key: str = "arxiv_id") -> DataFrame | None:
    """The merged view of all batches: the newest record of each key; of records in parts, those of the key's
    newest batch."""
    from pyspark.sql import functions as F

    if not exists(spark, out):
        return None
    d = spark.read.parquet(out)
    if "part_no" in d.columns:
        newest = d.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_batch"))
        d = d.join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_batch"))).drop("_key", "_batch")
        return R.latest_records(d, F.struct(key, "part_no"), F.col("batch")).drop("batch")
    return R.latest_records(d, F.col(key), F.col("batch")).drop("batch")


def status_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of a progress log per paper and status in hourly windows, late rows up to the watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark("logged_at", delay).groupBy(F.window("logged_at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("n"))
