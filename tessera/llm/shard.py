"""Sharding by global prefix sums (operator 8).

Rows are range-partitioned by id; each partition's total size and row count go to
the driver (one pair of numbers for each partition), and their running sums give
every row its global offset.  The line of bytes is cut at equal targets, so shards
are contiguous in id order and differ by one row's size at most.

Defined cases: a null text has no bytes, an empty one neither; a null id sorts
first; rows of one id are ordered by the checksum and size of their text, and
rows equal in all three are interchangeable, so that any number of them is split
over tasks like others; an empty table gives no shards; a text longer than a shard's
target is a shard's alone, and shards beside it may be empty.  Of the columns to
keep, those named like a new one (size, text_crc32, shard, slot) are replaced by it;
a column that is not kept plays no part, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_offsets

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard_of(total: int, shards: int) -> Column:
    """The shard in which the middle of a row lies, from its ``offset`` and ``size``; 64-bit integers throughout."""
    # Twice the middle is 2 * offset + size.
    return F.expr(f"int(least({shards - 1}L, ((2L * offset + size) * {shards}L) div (2L * {total}L)))")


def assign_shards(df: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default: the id) with size, text_crc32, shard and slot (the row's place in its shard)."""
    names = ["size", "text_crc32", "shard", "slot"]
    keep = [c for c in ([id] if keep is None else keep) if c.lower() not in names]
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    # The table's own columns go as one, so that their names meet none of ours.
    sized = df.select(F.struct(F.lit(0), *keep).alias("own"), F.col(id).alias("id"), (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = with_offsets(sized, ["id", "text_crc32", "size"], "size", parts=parts)
    total = placed.agg(F.sum("size")).first()[0] or 1
    sharded = placed.withColumn("shard", shard_of(total, shards))
    first = sharded.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return sharded.join(F.broadcast(first), "shard").select(*(F.col("own").getField(c).alias(c) for c in keep), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
