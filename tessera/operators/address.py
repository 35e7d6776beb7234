"""Addresses: ordered runs of fragments, as rows (address_id, idx, ptr, size) or arrays (AD-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

PAGE = 8192


def data_size(fragments: DataFrame) -> DataFrame:
    """AD-1, 2: bytes and number of fragments of each address."""
    return fragments.groupBy("address_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """AD-3: the fragments of ``right`` follow those of ``left`` in each address."""
    n = left.groupBy("address_id").agg(F.count(F.lit(1)).alias("n"))
    moved = right.join(n, "address_id", "left").withColumn("idx", F.col("idx") + F.coalesce("n", F.lit(0))).drop("n")
    return left.unionByName(moved)


def sub_fragment(ptr: Column, size: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """AD-4: the part [start, end) of a fragment; nothing where start is not before end."""
    stop = F.least(end, size)
    some = start < stop
    return F.when(some, ptr + start), F.when(some, stop - start)


def with_offsets(fragments: DataFrame) -> DataFrame:
    """Each fragment's place in its address (AN-7): ``offset`` bytes stand before it."""
    w = Window.partitionBy("address_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return fragments.withColumn("offset", F.sum("size").over(w) - F.col("size"))


def byte_range(fragments: DataFrame, start: Column, end: Column) -> DataFrame:
    """AD-5, 15: the fragments of bytes [start, end) of each address; ``start`` and ``end`` may be columns of it."""
    rows = with_offsets(fragments).withColumn("__from", F.greatest(start, F.col("offset"))).withColumn("__to", F.least(end, F.col("offset") + F.col("size")))
    return rows.where("__from < __to").select("address_id", "idx", (F.col("ptr") + F.col("__from") - F.col("offset")).alias("ptr"), (F.col("__to") - F.col("__from")).alias("size"))


def split_chunks(fragments: DataFrame, chunk: int) -> DataFrame:
    """AD-6: fragments cut where chunks of ``chunk`` bytes of the storage line begin."""
    rows = fragments.where("size > 0").withColumn("chunk", F.explode(F.expr(f"sequence(ptr div {chunk}, (ptr + size - 1) div {chunk})")))
    begin = F.greatest(F.col("ptr"), F.col("chunk") * chunk)
    end = F.least(F.col("ptr") + F.col("size"), (F.col("chunk") + 1) * chunk)
    return rows.select("address_id", "idx", "chunk", begin.alias("ptr"), (end - begin).alias("size"))


def group_to_storage(ptr: str, chunk: int, shards: int) -> tuple[Column, Column]:
    """AD-8: the storage and the place in it of an offset of an erasure-coded group."""
    stripe = chunk * shards
    return F.expr(f"({ptr} % {stripe}) div {chunk}"), F.expr(f"({ptr} div {stripe}) * {chunk} + {ptr} % {chunk}")


def storage_to_group(storage: str, ptr: str, chunk: int, shards: int) -> Column:
    """AD-8: the way back."""
    return F.expr(f"({ptr} div {chunk}) * {chunk * shards} + {storage} * {chunk} + {ptr} % {chunk}")


def pack_pointer(group: str, storage: str, offset: str) -> Column:
    """AD-7: a round-robin pointer as 32 hexadecimal digits: group and storage 32 bits each, offset 64."""
    return F.expr(f"lower(concat(lpad(hex({group}), 8, '0'), lpad(hex({storage}), 8, '0'), lpad(hex({offset}), 16, '0')))")


def unpack_pointer(pointer: str) -> tuple[Column, Column, Column]:
    """AD-7, 9: group, storage and offset of a packed pointer."""
    return tuple(F.expr(f"cast(conv(substring({pointer}, {a}, {n}), 16, 10) as bigint)") for a, n in ((1, 8), (9, 8), (17, 16)))


def by_storage(fragments: DataFrame) -> DataFrame:
    """AD-10: what each storage holds of an address: fragments, bytes, and the first place in the output that it fills."""
    return with_offsets(fragments).groupBy("address_id", "storage_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("offset").alias("first_offset"))


def straddling(fragments: DataFrame, storage_bytes: int) -> DataFrame:
    """AD-10: fragments that would lie on two storages of ``storage_bytes`` each: an error."""
    return fragments.where(F.expr(f"size > 0 and ptr div {storage_bytes} <> (ptr + size - 1) div {storage_bytes}"))


def offsets_to_fragments(offsets: DataFrame, total: str = "total") -> DataFrame:
    """AD-11: sizes from offsets: up to the next one, the last up to the total."""
    w = Window.partitionBy("address_id").orderBy("offset")
    return offsets.withColumn("size", F.coalesce(F.lead("offset").over(w), F.col(total)) - F.col("offset"))


def as_text(group: Column, ptr: Column, size: Column) -> Column:
    """AD-13."""
    return F.format_string("[group %d, pointer %016x, size %x]", group, ptr, size)


def parse_range(header: Column, size: Column) -> tuple[Column, Column]:
    """AD-14: ``bytes=a-b``, ``a-`` or ``-n`` as [start, end), clamped to the object; null where it is none."""
    a, b = F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 1), F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 2)
    first, last = a.try_cast("bigint"), b.try_cast("bigint")
    start = F.when(a != "", first).when(b != "", F.greatest(size - last, F.lit(0)))
    end = F.when((a != "") & (b != ""), F.least(last + 1, size)).when((a != "") | (b != ""), size)
    return start, end


def allocate(writes: DataFrame, align: int = PAGE, by: str = "storage_id", order: str = "seq") -> DataFrame:
    """SNK-3: append-log offsets: the running sum of sizes, each rounded up to ``align``."""
    padded = F.expr(f"((size + {align - 1}) div {align}) * {align}")
    return ranks.with_offsets(writes.withColumn("__padded", padded), [by, order], "__padded", by=[by], rank="__rank").drop("__padded", "__rank")


def files_of(allocations: DataFrame, file_bytes: int) -> DataFrame:
    """SNK-1: what of each allocation lies in which file of ``file_bytes``."""
    rows = allocations.where("size > 0").withColumn("file_no", F.explode(F.expr(f"sequence(offset div {file_bytes}, (offset + size - 1) div {file_bytes})")))
    begin = F.greatest(F.col("offset"), F.col("file_no") * file_bytes)
    end = F.least(F.col("offset") + F.col("size"), (F.col("file_no") + 1) * file_bytes)
    return rows.withColumn("file_offset", begin - F.col("file_no") * file_bytes).withColumn("file_size", end - begin)
