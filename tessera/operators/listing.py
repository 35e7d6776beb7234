"""Listings: folding by delimiter, pages and markers (LS-*), and multipart completion (MP-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PART_BYTES = 5 << 20


def collapse(names: DataFrame, prefix: str = "", delimiter: str = "/", keys: list[str] | None = None) -> DataFrame:
    """LS-1: entries of a listing: a name, or the part up to the first delimiter after the prefix, once.

    Columns: ``keys``, entry, is_prefix and n (names behind the entry).
    """
    keys = keys or []
    rows = names.where(F.col("name").startswith(prefix))
    at = F.locate(delimiter, F.col("name"), len(prefix) + 1)
    entry = F.when(at > 0, F.substring(F.col("name"), F.lit(1), at + len(delimiter) - 1)).otherwise(F.col("name"))
    return rows.select(*keys, entry.alias("entry"), (at > 0).alias("is_prefix")).groupBy(*keys, "entry", "is_prefix").agg(F.count(F.lit(1)).alias("n"))


def page(entries: DataFrame, max_keys: int, keys: list[str], order: str = "entry") -> DataFrame:
    """LS-2, 3, 7: the first ``max_keys`` entries of each listing, whether more follow, and the marker to go on from."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = entries.withColumn("rank", F.row_number().over(w))
    cut = numbered.where(F.col("rank") <= max_keys + 1)  # Spark keeps only this many rows of a group before it sorts on
    truncated = (F.max("rank").over(Window.partitionBy(*keys)) > max_keys) & F.lit(max_keys > 0)
    marked = cut.withColumn("truncated", truncated).where(F.col("rank") <= max_keys)
    return marked.withColumn("next_token", F.when(F.col("truncated") & (F.col("rank") == max_keys), F.col(order)))


def lower_bound(start_after: Column, token: Column) -> Column:
    """LS-4: the larger of both; a missing one does not count."""
    return F.greatest(start_after, token)


def mark_latest(versions: DataFrame) -> DataFrame:
    """LS-5: whether a version is the newest of its name."""
    w = Window.partitionBy("bucket_id", "name").orderBy(F.desc("id"))
    return versions.withColumn("is_latest", F.row_number().over(w) == 1)


def multipart_etag(parts: DataFrame, compat: str = "s3") -> DataFrame:
    """MP-1: md5 over the parts' digests in order, a hyphen, and their number.

    ``compat="reference"`` keeps only the low half of each digest byte, as a decoder
    that loses the high one does.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part_id", "etag"))), lambda x: x["etag"])
    digits = F.array_join(listed, "")
    if compat == "reference":
        digits = F.regexp_replace(digits, "(.)(.)", "0$2")
    return parts.groupBy("upload_id").agg(F.concat(F.md5(F.unhex(digits)), F.lit("-"), F.count(F.lit(1)).cast("string")).alias("etag"), F.sum("size").cast("long").alias("size"))


def validate_completion(wanted: DataFrame, parts: DataFrame, min_part_bytes: int = MIN_PART_BYTES) -> DataFrame:
    """MP-2: an error code for each part named in a completion, null where it is right.

    A part must exist, have the etag named, stand at its place in 1 … k, and reach the
    least size unless its number is that of the parts stored.
    """
    place = F.row_number().over(Window.partitionBy("upload_id").orderBy("part_id"))
    stored = parts.withColumn("stored", F.count(F.lit(1)).over(Window.partitionBy("upload_id")))
    both = wanted.withColumn("place", place).join(stored.select("upload_id", "part_id", F.col("etag").alias("own"), "size", "stored"), ["upload_id", "part_id"], "left")
    code = (
        F.when(F.col("own").isNull(), "InvalidPart")
        .when(F.col("own") != F.col("etag"), "InvalidPart")
        .when(F.col("place") != F.col("part_id"), "InvalidPartOrder")
        .when((F.col("size") < min_part_bytes) & (F.col("part_id") != F.col("stored")), "EntityTooSmall")
    )
    return both.select("upload_id", "part_id", code.alias("code"))
