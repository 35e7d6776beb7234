"""Watched keys: a stream of puts and deletes as the table that they add up to (SRC-9, SRC-10, SRC-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import latest


def snapshot(events: DataFrame, prefix: str = "", revision: int | None = None) -> DataFrame:
    """SRC-10: the keys under ``prefix`` after all events, or those up to a revision: (key, value, revision)."""
    rows = events.where(F.col("key").startswith(prefix))
    rows = rows if revision is None else rows.where(F.col("revision") <= revision)
    return latest(rows, ["key"], "revision").where("op = 'put'").select("key", "value", "revision")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: policy files, whole: (path, policy)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("policy"))
