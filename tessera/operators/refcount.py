"""Reference counts of stripes and the space they free (RC-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_offsets

STRIPE = 8192


def fan_out(fragments: DataFrame, stripe: int = STRIPE, keep: list[str] | None = None) -> DataFrame:
    """RC-1: a row for each stripe that a fragment overlaps; an empty fragment overlaps none."""
    keep = ["storage_id"] if keep is None else keep
    return fragments.where("size > 0").select(*keep, F.explode(F.expr(f"sequence(ptr div {stripe}, (ptr + size - 1) div {stripe})")).alias("stripe_id"))


def stripe_counts(fragments: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """RC-1: how many fragments overlap each stripe, summed within tasks first."""
    return fan_out(fragments, stripe).groupBy("storage_id", "stripe_id").agg(F.count(F.lit(1)).alias("refs"))


_KEY = ["storage_id", "stripe_id"]


def link(counts: DataFrame, wanted: DataFrame, upstream: bool = True) -> tuple[DataFrame, DataFrame]:
    """RC-2, 7: the counts with ``wanted`` added, and what is refused: with ``upstream``, stripes not counted yet."""
    both = wanted.withColumnRenamed("refs", "add").join(counts, _KEY, "full")
    after = both.where(F.col("refs").isNotNull() if upstream else F.lit(True)).select(*_KEY, (F.coalesce("refs", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("refs"))
    refused = both.where(F.col("refs").isNull() & F.lit(upstream)).select(*_KEY, F.col("add").alias("refs"))
    return after, refused


def unlink(counts: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RC-3: the counts that stay, the stripes set free, and drops of stripes that nobody counts (an error)."""
    both = dropped.withColumnRenamed("refs", "sub").join(counts, _KEY, "full")
    left = F.col("refs") - F.coalesce("sub", F.lit(0))
    known = both.where(F.col("refs").isNotNull()).select(*_KEY, left.alias("refs"))
    return known.where("refs > 0"), known.where("refs <= 0").select(*_KEY), both.where(F.col("refs").isNull()).select(*_KEY, F.col("sub").alias("refs"))


def runs(stripes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RC-4: consecutive stripes as runs: the first and how many."""
    by = ["storage_id"] if by is None else by
    ranked = with_offsets(stripes.select(*by, "stripe_id"), [*by, "stripe_id"], by=by, rank="__rank", offset="__none")
    return ranked.groupBy(*by, (F.col("stripe_id") - F.col("__rank")).alias("__island")).agg(F.min("stripe_id").alias("first_stripe"), F.count(F.lit(1)).alias("n")).drop("__island")


def freed_bytes(freed_runs: DataFrame, offsets: DataFrame, stripe: int = STRIPE, data: int | None = None) -> DataFrame:
    """RC-5, 8: the bytes that each storage's runs free, none beyond its write offset.

    Of an erasure-coded group only its ``data`` first storages count: parity frees nothing of an object's.
    """
    freed_runs = freed_runs if data is None else freed_runs.where(F.col("storage_id") < data)
    size = F.greatest(F.lit(0), F.least((F.col("first_stripe") + F.col("n")) * stripe, F.col("write_offset")) - F.col("first_stripe") * stripe)
    return freed_runs.join(F.broadcast(offsets), "storage_id").groupBy("storage_id").agg(F.sum(size).alias("freed"))


def rejected_fragments(fragments: DataFrame, refused: DataFrame, stripe: int = STRIPE, compat: str = "s3") -> DataFrame:
    """RC-6: fragments any of whose stripes is refused.

    ``compat="reference"`` (RC-12) compares stripe numbers alone, so a stripe refused on
    one storage refuses those of its number on others.
    """
    on = ["stripe_id"] if compat == "reference" else _KEY
    overlaps = fan_out(fragments, stripe, ["storage_id", "address_id", "idx"])
    hit = overlaps.join(refused.select(*on).distinct(), on, "left_semi").select("address_id", "idx").distinct()
    return fragments.join(hit, ["address_id", "idx"], "left_semi")


def get_counts(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """RC-9: the counts asked for; 0 where there is none."""
    return ids.join(counts, _KEY, "left").select(*_KEY, F.coalesce("refs", F.lit(0)).alias("refs"))


def audit_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """RC-11: (offset, size) whose increments and decrements do not match, from a service's log."""
    # Fixed value: the form of a line that counts.
    form = r"(incrementing|decrementing) refcount at offset=(\d+), size=(\d+)"
    read = lines.select(*(F.regexp_extract(line, form, k).alias(n) for k, n in ((1, "action"), (2, "offset"), (3, "size")))).where("action <> ''")
    sums = read.groupBy(F.col("offset").cast("bigint").alias("offset"), F.col("size").cast("bigint").alias("size")).agg(
        F.count(F.when(F.col("action") == "incrementing", 1)).alias("increments"), F.count(F.when(F.col("action") == "decrementing", 1)).alias("decrements")
    )
    return sums.where("increments <> decrements")
