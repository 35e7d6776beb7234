"""The catalog: buckets, object versions, uploads, users and keys as tables (CT-*).

Tables come in and go out as DataFrames; a procedure that changes a table returns
its next state.  Times are whole seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL, DELETED, COLLECTED = "Normal", "Deleted", "Collected"
# What a bucket name may not begin with, may not end with, and may not look like (an IPv4 address).
RESERVED_PREFIXES = ("xn--", "sthree-")
RESERVED_SUFFIXES = ("-s3alias", "--ol-s3")
IPV4_FORM = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def latest(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row with the largest ``order`` for each key: one shuffle with partial maxima, no join back."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def bucket_id(buckets: DataFrame, name: Column | str) -> DataFrame:
    """CT-1: the newest bucket of a name that is not deleted."""
    return buckets.where((F.col("name") == name) & (F.col("status") != DELETED)).agg(F.max("id").alias("id"))


def bucket_info(buckets: DataFrame) -> DataFrame:
    """CT-2: id, name and versioning of normal buckets."""
    return buckets.where(F.col("status") == NORMAL).select("id", "name", "versioning")


def create_buckets(buckets: DataFrame, names: DataFrame) -> DataFrame:
    """CT-3: ``names`` (name, id) that no normal bucket has yet, as new rows; ``created`` tells refused ones."""
    normal = buckets.where(F.col("status") == NORMAL).select("name", F.lit(True).alias("taken")).distinct()
    return names.join(normal, "name", "left").select("id", "name", F.col("taken").isNull().alias("created"))


def delete_bucket(buckets: DataFrame, name: Column | str) -> DataFrame:
    """CT-4: the normal bucket of a name becomes Deleted; no time of deletion is set."""
    return buckets.withColumn("status", F.when((F.col("name") == name) & (F.col("status") == NORMAL), DELETED).otherwise(F.col("status")))


def clear_deleted_buckets(buckets: DataFrame, versions: DataFrame) -> DataFrame:
    """CT-7: what is left once deleted buckets without objects go."""
    used = versions.select(F.col("bucket_id").alias("id")).distinct()
    gone = buckets.where(F.col("status") == DELETED).join(used, "id", "left_anti").select("id")
    return buckets.join(gone, "id", "left_anti")


def get_object(versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """CT-9: the version that a read of each (bucket, name) meets.

    Without versioning the newest normal row; else the newest row that is not both
    deleted and loose, which may be a delete marker.
    """
    seen = versions.join(buckets.select(F.col("id").alias("bucket_id"), "versioning"), "bucket_id") if buckets is not None else versions
    visible = F.when(F.col("versioning") == "Disabled", F.col("status") == NORMAL).otherwise(~((F.col("status") == DELETED) & ~F.col("sticky")))
    return latest(seen.where(visible).select(*versions.columns), ["bucket_id", "name"])


def get_object_by_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """CT-10: for each (bucket_id, name, version) asked for, its newest row."""
    return latest(versions.join(wanted, ["bucket_id", "name", "version"], "left_semi"), ["bucket_id", "name", "version"])


def null_version(versions: DataFrame) -> DataFrame:
    """CT-13: the loose normal row of each name, which a delete without a version hits."""
    return versions.where((F.col("status") == NORMAL) & ~F.col("sticky"))


def list_objects(versions: DataFrame, prefix: str | None = None, after: str | None = None, like: bool = False) -> DataFrame:
    """CT-15, 16, 17: the newest row of each name over all states, if it is normal.

    ``prefix`` is a plain prefix, so it reaches the scan; with ``like`` its ``%`` and
    ``_`` are wildcards.  Names up to ``after``, and those that begin with it, are left out.
    """
    rows = versions
    if prefix:
        rows = rows.where(F.col("name").like(prefix + "%") if like else F.col("name").startswith(prefix))
    if after is not None:
        rows = rows.where((F.col("name") > after) & ~F.col("name").startswith(after))
    return latest(rows, ["bucket_id", "name"]).where(F.col("status") == NORMAL)


def list_versions(versions: DataFrame, prefix: str = "", key_marker: str | None = None, id_marker: int | None = None, limit: int | None = None, paged: bool = False) -> DataFrame:
    """CT-18: normal or sticky rows by name, newest first.

    A resume keeps ids from ``id_marker`` on, and names from ``key_marker`` where both
    are given; with ``paged`` it is a true page: what follows (key_marker, id_marker).
    """
    rows = versions.where(((F.col("status") == NORMAL) | F.col("sticky")) & F.col("name").startswith(prefix))
    if paged and key_marker is not None:
        rows = rows.where((F.col("name") > key_marker) | ((F.col("name") == key_marker) & (F.col("id") < (id_marker if id_marker is not None else -1))))
    elif id_marker is not None:
        rows = rows.where(F.col("id") >= id_marker)
        if key_marker is not None:
            rows = rows.where(F.col("name") >= key_marker)
    rows = rows.orderBy("name", F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def data_size(versions: DataFrame) -> DataFrame:
    """CT-19: bytes of normal rows; 0 for none."""
    return versions.where(F.col("status") == NORMAL).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


def next_deleted(versions: DataFrame, references: DataFrame) -> DataFrame:
    """CT-21: deleted loose rows that nobody reads, in order of id."""
    return versions.where((F.col("status") == DELETED) & ~F.col("sticky")).join(references.select("id"), "id", "left_anti")


def fold_references(changes: DataFrame) -> DataFrame:
    """CT-22: counts after +1 and -1 changes; objects at 0 or below have no row."""
    return changes.groupBy("object_id").agg(F.sum("delta").cast("long").alias("refs")).where("refs > 0")


_STATE = T.StructType(
    [
        T.StructField("bucket_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("sticky", T.BooleanType()),
        T.StructField("marker", T.BooleanType()),
        T.StructField("size", T.LongType()),
    ]
)


def fold_commands(commands: DataFrame) -> DataFrame:
    """CT-8, 11: the version table after puts and deletes in order of ``id``, for each (bucket_id, name).

    ``commands`` has bucket_id, name, id, op ('put' or 'delete'), size and versioning.
    Disabled: a put retires the current row; a delete marks it.  Enabled: each put is
    a sticky row; a delete adds an empty row and marks it deleted and sticky.
    Suspended: a put retires the current row only if it is loose; a delete first adds
    an empty row if the current one is sticky, then marks the newest.
    """

    names = ["bucket_id", "name", "id", "op", "size", "versioning"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Names come one after the other, so only one name's rows are held.
        key, rows, done = None, [], []
        for pdf in batches:
            for c in pdf.itertuples(index=False):
                if (c.bucket_id, c.name) != key:
                    done += rows
                    key, rows = (c.bucket_id, c.name), []
                _apply(rows, c)
            if done:
                yield pd.DataFrame(done, columns=_STATE.names)
                done = []
        if rows:
            yield pd.DataFrame(rows, columns=_STATE.names)

    ordered = commands.select(*names).repartition("bucket_id", "name").sortWithinPartitions("bucket_id", "name", "id")
    return ordered.mapInPandas(run, _STATE)


def _apply(rows: list[dict], c) -> None:
    """One command on the rows of its name, oldest first."""
    current = next((r for r in reversed(rows) if r["status"] == NORMAL), None)
    fresh = {"bucket_id": c.bucket_id, "name": c.name, "id": c.id, "status": NORMAL, "sticky": c.versioning == "Enabled", "marker": False, "size": c.size}
    if c.op == "put":
        if current is not None and (c.versioning == "Disabled" or (c.versioning == "Suspended" and not current["sticky"])):
            current["status"] = DELETED
        rows.append(fresh)
    elif c.versioning == "Enabled" or (c.versioning == "Suspended" and current is not None and current["sticky"]):
        rows.append(fresh | {"status": DELETED, "sticky": True, "marker": True, "size": 0})
    elif current is not None:
        current["status"] = DELETED


def put_disabled(commands: DataFrame) -> DataFrame:
    """CT-8 without versioning, in closed form: a row stays normal if it is its name's last put and no delete follows."""
    w = Window.partitionBy("bucket_id", "name").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    later = F.count(F.lit(1)).over(w)
    return commands.withColumn("later", later).where("op = 'put'").withColumn("status", F.when(F.col("later") == 0, NORMAL).otherwise(DELETED)).drop("later")


def put_parts(parts: DataFrame) -> DataFrame:
    """CT-31: of all writes of a part, the last by ``seq``."""
    return latest(parts, ["upload_id", "part_id"], "seq").drop("seq")


def live_uploads(uploads: DataFrame) -> DataFrame:
    """CT-33: uploads that nobody has erased."""
    return uploads.where(F.col("erased_since").isNull())


def clean_deleted(uploads: DataFrame, parts: DataFrame, now: int, age: int) -> tuple[DataFrame, DataFrame]:
    """CT-35: uploads and parts without those erased more than ``age`` seconds ago."""
    gone = uploads.where(F.col("erased_since") + age < now).select("upload_id")
    return uploads.join(gone, "upload_id", "left_anti"), parts.join(gone, "upload_id", "left_anti")


def query_key(keys: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """CT-40: live keys with their users."""
    live = keys.where(F.col("expires").isNull() | (F.col("expires") >= now))
    return live.join(users, live["username"] == users["name"]).select("access_key", "username", "arn", "super_user", "expires")


def remove_expired_keys(keys: DataFrame, at: int) -> DataFrame:
    """CT-41: keys without those that expire up to ``at``."""
    return keys.where(F.col("expires").isNull() | (F.col("expires") > at))


def valid_bucket_name(name: Column) -> Column:
    """CT-42: 3 to 63 of a-z, 0-9, dot and hyphen, a letter or digit at either end, no two marks in a row, nothing reserved."""
    shape = F.length(name).between(3, 63) & name.rlike("^[a-z0-9][a-z0-9.-]*[a-z0-9]$") & ~name.rlike("[.-][.-]") & ~name.rlike(IPV4_FORM)
    for x in RESERVED_PREFIXES:
        shape &= ~name.startswith(x)
    for x in RESERVED_SUFFIXES:
        shape &= ~name.endswith(x)
    return shape


def deletable_buckets(buckets: DataFrame, versions: DataFrame) -> DataFrame:
    """CT-44: normal buckets whose listing is empty."""
    full = list_objects(versions).select(F.col("bucket_id").alias("id")).distinct()
    return buckets.where(F.col("status") == NORMAL).join(full, "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys (REL-21)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def put_objects(batches: Iterator[DataFrame], state: DataFrame) -> DataFrame:
    """The catalog after several batches of new versions: appended in turn."""
    for batch in batches:
        state = state.unionByName(batch)
    return state
