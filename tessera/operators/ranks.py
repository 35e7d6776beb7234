"""Ranks and running sums over whole tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize


def with_offsets(df: DataFrame, order: list, size: str | None = None, by: list[str] | None = None, parts: int | None = None, rank: str = "rank", offset: str = "offset") -> DataFrame:
    """``df`` with ``rank`` and ``offset``: the rows and the sum of ``size`` before each row in ``order``.

    Rows are dealt by ranges; each partition's totals give the others' beginnings.  With
    ``by`` (the leading columns of ``order``), both start anew for each group.  A group
    may span any number of partitions, and so may rows alike in all of ``order``, whose
    ranks among themselves are arbitrary; a hot one is no heavier than others.  An entry
    of ``order`` is a name or a Column (such as ``F.desc(name)``).
    """
    by = by or []
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # The place in the input splits what the order cannot tell apart.
    marked = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(n, *keys, "__tie").withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "offsets")  # partition numbers must not change when a lost task runs again
    total = F.lit(0).cast("long") if size is None else F.sum(size)
    totals = dealt.groupBy("__part", *by).agg(total.alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    # One row for each partition, and for each group that a partition holds.
    before = (Window.partitionBy(*by) if by else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("__part").alias("__at"), *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows0"))
    inside = Window.partitionBy("__part", *by).orderBy(*keys[len(by) :], "__tie")
    local = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    local = local.withColumn("__offset", F.lit(0).cast("long") if size is None else F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    same = [F.col("__part") == F.col("__at"), *(F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by))]
    kept = [c for c in df.columns if c not in (rank, offset)]
    return local.join(base, same, "left").select(*kept, (F.col("__rank") + F.col("__rows0")).cast("long").alias(rank), (F.col("__offset") + F.col("__bytes0")).alias(offset))
