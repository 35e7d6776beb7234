"""Metering, limits, offline analytics and metrics (CT-20, BG-3, BG-4, AN-*, TM-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_offsets

GIB = 1 << 30


def overlap(start: Column, end: Column) -> Column:
    """Seconds that a version lives within [start, end); none below 0. Versions alive have no time of deletion."""
    return F.greatest(F.lit(0), F.least(F.coalesce(F.col("deleted_at"), end), end) - F.greatest(F.col("last_modified"), start))


def compute_usage(versions: DataFrame, start: int, end: int) -> DataFrame:
    """CT-20: GiB-seconds of [start, end): byte-seconds summed, then divided by 1024 three times, each rounded down."""
    rows = versions.where((F.col("last_modified") < end) & ((F.col("status") == "Normal") | (F.col("deleted_at") >= start)))
    total = rows.agg(F.coalesce(F.sum(overlap(F.lit(start), F.lit(end)).cast("decimal(38,0)") * F.col("size")), F.lit(0)).alias("s"))
    return total.selectExpr("cast(s div 1024 div 1024 div 1024 as bigint) as usage")


def usage_by_interval(versions: DataFrame, start: int, end: int, step: int = 3600) -> DataFrame:
    """BG-4: CT-20 for each interval of ``step`` seconds.

    A version is counted only in the intervals that it lives in, so rows grow with
    lifetimes and not with versions times intervals.
    """
    last = F.least(F.coalesce(F.col("deleted_at"), F.lit(end)), F.lit(end))
    first = F.greatest(F.col("last_modified"), F.lit(start))
    rows = versions.where((F.col("status") == "Normal") | F.col("deleted_at").isNotNull()).select("size", first.alias("a"), last.alias("b")).where("a < b")
    hours = rows.withColumn("i", F.explode(F.expr(f"sequence((a - {start}) div {step}, (b - 1 - {start}) div {step})")))
    begin = F.lit(start) + F.col("i") * step
    seconds = F.least(F.col("b"), begin + step) - F.greatest(F.col("a"), begin)
    return hours.groupBy((F.lit(start) + F.col("i") * step).alias("hour")).agg(F.sum(seconds * F.col("size")).alias("byte_seconds")).selectExpr("hour", "byte_seconds div 1024 div 1024 div 1024 as usage")


def check_limits(writes: DataFrame, cap: int, warn_at: float = 0.8, by: str = "bucket", order: str = "id") -> DataFrame:
    """BG-3: the bytes stored after each write, whether it is refused, and whether it deserves a warning."""
    placed = with_offsets(writes, [by, order], "size", by=[by], rank="__rank", offset="__before")
    after = placed.withColumn("stored", F.col("__before") + F.col("size")).drop("__rank", "__before")
    return after.withColumn("refused", F.col("stored") > cap).withColumn("warned", (F.col("stored") <= cap) & (F.col("stored") > int(cap * warn_at)))


def by_pointer(log: DataFrame) -> DataFrame:
    """AN-1."""
    return log.groupBy("ptr").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def histogram(log: DataFrame, value: Column) -> DataFrame:
    """AN-2: how often each value occurs."""
    return log.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def fragment_ages(log: DataFrame, order: str = "seq") -> DataFrame:
    """AN-3: for each use of a fragment, the events since its first use and since its last one."""
    w = Window.partitionBy("ptr").orderBy(order)
    return log.select("ptr", order, (F.col(order) - F.first(order).over(w)).alias("age"), (F.col(order) - F.lag(order).over(w)).alias("updated_age"))


def summary(log: DataFrame, lowest: int = 5) -> DataFrame:
    """AN-4: how many fragments are used how often: the ``lowest`` counts, and the rest together as -1."""
    uses = log.groupBy("ptr").agg(F.count(F.lit(1)).alias("uses")).groupBy("uses").agg(F.count(F.lit(1)).alias("fragments"))
    low = [r["uses"] for r in uses.orderBy("uses").limit(lowest).collect()]  # ``lowest`` numbers
    return uses.groupBy(F.when(F.col("uses").isin(low), F.col("uses") - 1).otherwise(-1).alias("deduplicated")).agg(F.sum("fragments").alias("fragments"))


def top(log: DataFrame, value: Column, n: int = 20) -> DataFrame:
    """AN-5: the ``n`` most frequent values; of equals the smaller first."""
    return histogram(log, value).orderBy(F.desc("n"), "value").limit(n)


def pair_timings(events: DataFrame) -> DataFrame:
    """AN-6: enter and the leave that follows it on the same line of execution, summed up for each place."""
    w = Window.partitionBy("line").orderBy("at", "id")
    pairs = events.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_at", F.lead("at").over(w)).where("kind = 'enter' and next_kind = 'leave'")
    took = F.col("next_at") - F.col("at")
    return pairs.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min(took).alias("least"), F.max(took).alias("most"), F.sum(took).alias("total"))


def metrics(samples: DataFrame) -> DataFrame:
    """TM-1: counters summed, gauges at their last value, by metric and label."""
    last = F.max_by("value", F.struct("at", "id"))
    return samples.groupBy("metric", "label", "kind").agg(F.sum("value").alias("s"), last.alias("l")).select("metric", "label", F.when(F.col("kind") == "counter", F.col("s")).otherwise(F.col("l")).alias("value"))
