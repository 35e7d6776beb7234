"""The append log as a table of payload rows (file_no, ptr, size, bytes) (SRC-7, SRC-8, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.address import byte_range


def write_log(payload: DataFrame, path: str) -> None:
    """SNK-1: appended, a folder for each log file, so that reads of a file prune the others."""
    payload.write.mode("append").partitionBy("storage_id", "file_no").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def punch(payload: DataFrame, freed: DataFrame, stripe: int = 8192) -> DataFrame:
    """SNK-2: the log without rows all of whose stripes are free; ``freed`` is (storage_id, stripe_id)."""
    stripes = payload.select("storage_id", "ptr", F.explode(F.expr(f"sequence(ptr div {stripe}, (ptr + size - 1) div {stripe})")).alias("stripe_id"))
    used = stripes.join(freed, ["storage_id", "stripe_id"], "left_anti").select("storage_id", "ptr").distinct()
    return payload.join(used, ["storage_id", "ptr"], "left_semi")


def read_fragments(fragments: DataFrame, payload: DataFrame) -> DataFrame:
    """SRC-7, 8: each fragment's bytes; what the log does not have reads as zeros."""
    body = payload.select("storage_id", "ptr", F.col("bytes").alias("__bytes"))
    joined = fragments.join(body, ["storage_id", "ptr"], "left")
    held = F.substring(F.coalesce("__bytes", F.lit(b"")), F.lit(1), F.col("size").cast("int"))
    digits = F.hex(held)
    return joined.withColumn("bytes", F.unhex(F.rpad(digits, (F.col("size") * 2).cast("int"), "0"))).drop("__bytes")


def read_range(fragments: DataFrame, payload: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes [start, end) of each address, in order."""
    part = byte_range(fragments, F.lit(start), F.lit(end))
    whole = fragments.select("address_id", "idx", "storage_id", F.col("ptr").alias("f_ptr"), F.col("size").alias("f_size"))
    body = payload.select("storage_id", F.col("ptr").alias("f_ptr"), "bytes")
    rows = part.join(whole, ["address_id", "idx"]).join(body, ["storage_id", "f_ptr"])
    piece = F.hex(F.substring("bytes", (F.col("ptr") - F.col("f_ptr") + 1).cast("int"), F.col("size").cast("int")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("h")))), lambda x: x["h"])
    return rows.groupBy("address_id").agg(F.unhex(F.array_join(listed, "")).alias("bytes"))
