"""Continuous versions of operators (BG-*): file streams drained with ``availableNow``, equal to their batch versions.

Watermarks are an addition of this engine: with them, state of closed hours goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import new_path


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is there; the table that it leaves."""
    spark = stream.sparkSession
    top = new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{top}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def as_stream(table: DataFrame, files: int = 4) -> DataFrame:
    """A table written as files and read again as a stream of them, one at a time."""
    spark = table.sparkSession
    path = f"{new_path(spark, 'stream')}/in"
    table.repartition(files).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_data_size(versions: DataFrame) -> DataFrame:
    """CT-19, BG-2 over a stream of versions."""
    return versions.where("status = 'Normal'").groupBy().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def stream_hourly(events: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """BG-4 over a stream: what comes in each hour; an hour is closed once the watermark has passed it."""
    timed = events.withColumn("t", F.timestamp_seconds(at)).withWatermark("t", delay)
    return timed.groupBy(F.window("t", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).select(F.unix_seconds("window.start").alias("hour"), "n", "size")


def stream_states(reports: DataFrame) -> DataFrame:
    """EC-7, BG-6 over a stream of storage reports: the last state of each storage."""
    return reports.groupBy("group_id", "storage_id").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("reports"))


def tee(batch: DataFrame, relay: Callable[[DataFrame], None], store: Callable[[DataFrame], None]) -> None:
    """SNK-7: one micro-batch to two places, computed once."""
    batch.persist()
    try:
        relay(batch)
        store(batch)
    finally:
        batch.unpersist()


def collect_garbage(versions: DataFrame, references: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BG-1, one round: what stays of the catalog, and the fragments to unlink."""
    from ..operators.catalog import next_deleted

    gone = next_deleted(versions, references).select("id")
    return versions.join(gone, "id", "left_anti"), fragments.join(gone.withColumnRenamed("id", "address_id"), "address_id", "left_semi")
