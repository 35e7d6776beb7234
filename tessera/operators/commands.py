"""Request commands as batch operators over the catalog (S3-*, IAM-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks, refcount
from .address import parse_range
from .catalog import DELETED, NORMAL, deletable_buckets, get_object, latest, list_objects, valid_bucket_name
from .listing import mark_latest, multipart_etag, page, validate_completion

# Keys of one multi-delete, the largest number of a part, and the type of an object that names none.
MAX_DELETE, MAX_PART, DEFAULT_MIME = 1000, 10_000, "binary/octet-stream"


def get_status(requests: DataFrame, versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """S3-1, 12: (id, status, object) of reads (id, bucket_id, name, version): 200, 404, or 405 for a version that is deleted or absent."""
    own = versions.select("bucket_id", "name", "version", F.col("status").alias("state"), F.col("id").alias("object"))
    by_version = requests.where("version is not null").join(latest(own, ["bucket_id", "name", "version"], "object"), ["bucket_id", "name", "version"], "left")
    found = F.col("object").isNotNull()
    exact = by_version.select("id", F.when(found & (F.col("state") != DELETED), 200).otherwise(405).alias("status"), F.when(found & (F.col("state") != DELETED), F.col("object")).alias("object"))
    now = get_object(versions, buckets).select("bucket_id", "name", F.col("id").alias("object"), F.col("status").alias("state"))
    newest = requests.where("version is null").join(now, ["bucket_id", "name"], "left")
    seen = found & (F.col("state") != DELETED)
    return exact.unionByName(newest.select("id", F.when(seen, 200).otherwise(404).alias("status"), F.when(seen, F.col("object")).alias("object")))


def complete_uploads(wanted: DataFrame, parts: DataFrame, min_part_bytes: int) -> DataFrame:
    """S3-5: each completion: its first error, or the etag and size of all stored parts together."""
    errors = validate_completion(wanted, parts, min_part_bytes).where("code is not null").groupBy("upload_id").agg(F.min_by("code", "part_id").alias("error"))
    done = wanted.select("upload_id").distinct().join(errors, "upload_id", "left").join(multipart_etag(parts), "upload_id", "left")
    ok = F.col("error").isNull()
    return done.select("upload_id", "error", F.when(ok, F.col("etag")).alias("etag"), F.when(ok, F.col("size")).alias("size"))


def list_version_rows(versions: DataFrame) -> DataFrame:
    """S3-10: Version and DeleteMarker rows, the newest of each name marked."""
    rows = mark_latest(versions.where((F.col("status") == "Normal") | F.col("sticky")))
    return rows.select("bucket_id", "name", "id", F.when(F.col("status") == DELETED, "DeleteMarker").otherwise("Version").alias("kind"), "is_latest")


def delete_objects(batches: DataFrame, versions: DataFrame) -> DataFrame:
    """S3-18: what becomes of each key of multi-deletes (batch, seq, bucket_id, name); a batch of over 1000 keys is refused whole."""
    from pyspark.sql import Window

    sized = batches.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("batch")))
    known = versions.select("bucket_id", "name", F.lit(True).alias("known")).distinct()
    both = sized.join(known, ["bucket_id", "name"], "left")
    return both.select("batch", "seq", F.when(F.col("n") > MAX_DELETE, "MalformedXML").when(F.col("known").isNull(), "NoSuchKey").otherwise("Deleted").alias("result"))


def copy_objects(copies: DataFrame, versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """S3-16: copies (id, bucket_id, name, if_match) of current objects whose version tag fits; data is linked, not moved."""
    now = get_object(versions, buckets).where(F.col("status") != DELETED).select("bucket_id", "name", F.col("id").alias("linked"), F.col("version").alias("etag"), "size")
    both = copies.join(now, ["bucket_id", "name"], "left")
    code = F.when(F.col("linked").isNull(), "NoSuchKey").when(F.col("if_match").isNotNull() & (F.col("if_match") != F.col("etag")), "PreconditionFailed").otherwise("OK")
    return both.select("id", code.alias("code"), F.when(code == "OK", F.col("linked")).alias("linked"), F.when(code == "OK", F.col("size")).alias("size"))


def iam_action(action: Column) -> Column:
    """IAM-1 … 8: the id of a form's action; users have one colon, all others two."""
    users, others = ("CreateUser", "DeleteUser"), ("CreateAccessKey", "DeleteAccessKey", "PutUserPolicy", "GetUserPolicy", "DeleteUserPolicy", "ListUserPolicies")
    return F.when(action.isin(*users), F.concat(F.lit("iam:"), action)).when(action.isin(*others), F.concat(F.lit("iam::"), action))


def with_mime(mime: Column) -> Column:
    """S3-2: the type of an object, or the default."""
    return F.coalesce(F.nullif(mime, F.lit("")), F.lit(DEFAULT_MIME))


def list_page(versions: DataFrame, prefix: str = "", delimiter: str | None = None, max_keys: int = 1000, after: str | None = None) -> DataFrame:
    """A page of each bucket's listing, whole: current names after ``after``, folded by the delimiter, cut after ``max_keys``.

    Columns: bucket_id, entry, is_prefix, id and size (of objects), rank, truncated, and
    on the last row of a page that is cut, ``next``, the entry to go on from.
    """
    rows = list_objects(versions, prefix or None, after or None)
    name = F.col("name")
    at = F.locate(delimiter, name, len(prefix) + 1) if delimiter else F.lit(0)
    folded = at > 0
    entry = F.when(folded, F.substring(name, F.lit(1), at + len(delimiter or "") - 1)).otherwise(name)
    entries = rows.groupBy("bucket_id", entry.alias("entry"), folded.alias("is_prefix")).agg(F.max(F.when(~folded, F.col("id"))).alias("id"), F.max(F.when(~folded, F.col("size"))).alias("size"))
    return page(entries, max_keys, ["bucket_id"]).withColumnRenamed("next_token", "next")


def list_objects_v2(versions: DataFrame, prefix: str = "", delimiter: str | None = None, max_keys: int = 1000, start_after: str | None = None, token: str | None = None) -> DataFrame:
    """S3-8: a page after the larger of start-after and the continuation token; its ``next`` is the next token."""
    after = max((x for x in (start_after, token) if x), default=None)
    return list_page(versions, prefix, delimiter, max_keys, after)


def list_objects_v1(versions: DataFrame, prefix: str = "", delimiter: str | None = None, max_keys: int = 1000, marker: str | None = None) -> DataFrame:
    """S3-9: a page after the marker; only with a delimiter does it name the next one."""
    found = list_page(versions, prefix, delimiter, max_keys, marker)
    return found if delimiter else found.withColumn("next", F.lit(None).cast("string"))


def get_ranges(requests: DataFrame, versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """S3-1: reads (id, bucket_id, name, version, range): status, object, [start, end) and Content-Range.

    206 with a range, 416 for one that holds no byte, 501 for several at once, 400 for
    what is no range; a read that finds nothing has its own status.
    """
    found = get_status(requests, versions, buckets).withColumnRenamed("status", "found")
    size = versions.select(F.col("id").alias("object"), "size")
    both = requests.select("id", "range").join(found, "id").join(size, "object", "left")
    start, end = parse_range(F.col("range"), F.col("size"))
    both = both.withColumn("start", start).withColumn("end", end)
    asked = (F.col("found") == 200) & F.col("range").isNotNull()
    code = F.when(F.col("range").contains(","), 501).when(F.col("start").isNull(), 400).when(F.col("start") >= F.col("end"), 416).otherwise(206)
    both = both.withColumn("status", F.when(asked, code).otherwise(F.col("found")))
    part, whole = F.col("status") == 206, F.col("status") == 200
    shown = F.concat(F.lit("bytes "), F.col("start").cast("string"), F.lit("-"), (F.col("end") - 1).cast("string"), F.lit("/"), F.col("size").cast("string"))
    return both.select("id", "status", F.when(part | whole, F.col("object")).alias("object"), F.when(part, F.col("start")).when(whole, F.lit(0)).alias("start"), F.when(part, F.col("end")).when(whole, F.col("size")).alias("end"), F.when(part, shown).alias("content_range"))


def head(requests: DataFrame, versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """S3-12: what a read would find, without its bytes: status, size, version and time of each request."""
    seen = versions.select(F.col("id").alias("object"), "size", "version", "last_modified")
    return get_status(requests, versions, buckets).join(seen, "object", "left").select("id", "status", "object", "size", "version", "last_modified")


def create_buckets(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """S3-14: (seq, name): what becomes of each, in turn; a name must be valid and not in use."""
    used = buckets.where(F.col("status") == NORMAL).select("name", F.lit(True).alias("used"))
    both = asked.join(used, "name", "left")
    first = asked.groupBy("name").agg(F.min("seq").alias("first"))
    code = F.when(~valid_bucket_name(F.col("name")), "InvalidBucketName").when(F.col("used") | (F.col("seq") > F.col("first")), "BucketAlreadyExists").otherwise("OK")
    return both.join(first, "name").select("seq", "name", code.alias("code"))


def delete_buckets(asked: DataFrame, buckets: DataFrame, versions: DataFrame) -> DataFrame:
    """S3-13, 15: (seq, name): whether a bucket is there, and is empty and goes."""
    known = buckets.where(F.col("status") == NORMAL).select("name", F.col("id").alias("bucket_id"))
    empty = deletable_buckets(buckets, versions).select("name", F.lit(True).alias("empty"))
    both = asked.join(known, "name", "left").join(empty, "name", "left")
    return both.select("seq", "name", F.when(F.col("bucket_id").isNull(), "NoSuchBucket").when(F.col("empty"), "OK").otherwise("BucketNotEmpty").alias("code"))


def put_objects(puts: DataFrame, fragments: DataFrame, buckets: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3-2, CT-43: puts (address_id, bucket) with their fragments: those that the catalog takes, those it refuses, and the counts after both.

    Storage counts a put's stripes before the catalog is asked; where the bucket is not
    there, what was counted is taken back.
    """
    live = buckets.where(F.col("status") == NORMAL).select(F.col("name").alias("bucket"), F.lit(True).alias("live"))
    both = puts.join(live, "bucket", "left")
    taken, refused = both.where("live").drop("live"), both.where("live IS NULL").drop("live")
    linked, _ = refcount.link(counts, refcount.stripe_counts(fragments.join(puts.select("address_id"), "address_id", "left_semi")), upstream=False)
    after, _, _ = refcount.unlink(linked, refcount.stripe_counts(fragments.join(refused.select("address_id"), "address_id", "left_semi")))
    return taken, refused, after


def upload_parts(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3-3: writes (upload_id, part_id, seq, …): those in force, and those to unlink: replaced ones, and those of no valid number."""
    valid = F.col("part_id").between(1, MAX_PART)
    top = writes.where(valid).groupBy("upload_id", "part_id").agg(F.max("seq").alias("top"))
    both = writes.join(top, ["upload_id", "part_id"], "left")
    kept = F.coalesce(F.col("seq") == F.col("top"), F.lit(False))
    return both.where(kept).drop("top"), both.where(~kept).drop("top")


def abort_uploads(aborted: DataFrame, uploads: DataFrame, parts: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """S3-6: uploads with the aborted ones marked as erased, and the parts to unlink, of live uploads only."""
    hit = uploads.join(aborted.select("upload_id").distinct(), "upload_id", "left_semi").where("erased_since IS NULL").select("upload_id", F.lit(now).cast("long").alias("__now"))
    after = uploads.join(hit, "upload_id", "left").withColumn("erased_since", F.coalesce("erased_since", "__now")).drop("__now")
    return after, parts.join(hit.select("upload_id"), "upload_id", "left_semi")


def list_uploads(buckets: DataFrame, uploads: DataFrame) -> DataFrame:
    """S3-7: each bucket's live uploads (upload_id, bucket, key) in order of id; a bucket without any is not found."""
    live = uploads.where("erased_since IS NULL").select("bucket", "upload_id", "key")
    both = buckets.select(F.col("name").alias("bucket")).join(live, "bucket", "left")
    return both.select("bucket", F.when(F.col("upload_id").isNull(), 404).otherwise(200).alias("status"), "upload_id", "key")


def documents_after(commands: DataFrame, owners: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """S3-19 … 26: each owner's document after puts and deletes (seq, name, op, document): status 200, or 404 without one.

    A put is stored as it is; with ``allowed`` (versioning), others are refused.
    """
    valid = commands if allowed is None else commands.where((F.col("op") == "delete") | F.col("document").isin(allowed))
    last = valid.groupBy("name").agg(F.max_by("op", "seq").alias("op"), F.max_by("document", "seq").alias("document"))
    both = owners.select("name").join(last, "name", "left")
    held = F.when(F.col("op") == "put", F.col("document"))
    return both.select("name", F.when(held.isNotNull(), 200).otherwise(404).alias("status"), held.alias("document"))


def iam_after(commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IAM-1 … 8: users, access keys and policies after commands (seq, action, user, item, document).

    Deleting a user takes their keys and policies along; a key or policy needs its user
    to be there, and lives from its last put until it is deleted.
    """
    users = commands.where(F.col("action").isin("CreateUser", "DeleteUser")).groupBy("user").agg(F.max_by("action", "seq").alias("last"), F.max("seq").alias("since")).where("last = 'CreateUser'").select("user", "since")
    # Since when a user has been there without a break: the first creation after the last deletion.
    gone = commands.where("action = 'DeleteUser'").groupBy("user").agg(F.max("seq").alias("gone"))
    made = commands.where("action = 'CreateUser'").select("user", F.col("seq").alias("made")).join(gone, "user", "left").where("gone IS NULL OR made > gone").groupBy("user").agg(F.min("made").alias("made"))
    live = users.select("user").join(made, "user")

    def items(put: str, drop: str) -> DataFrame:
        own = commands.where(F.col("action").isin(put, drop)).join(live, "user").where("seq > made")
        return own.groupBy("user", "item").agg(F.max_by("action", "seq").alias("last"), F.max_by("document", "seq").alias("document")).where(F.col("last") == put).select("user", "item", "document")

    return live.select("user"), items("CreateAccessKey", "DeleteAccessKey").drop("document"), items("PutUserPolicy", "DeleteUserPolicy")


def ready(buckets: DataFrame, used: DataFrame) -> DataFrame:
    """ADM-2: the readiness document: whether the catalog lists its buckets and storage tells its space."""
    both = buckets.agg((F.count(F.lit(1)) >= 0).alias("a")).join(F.broadcast(used.agg((F.count(F.lit(1)) >= 0).alias("b"))))
    return both.select(F.format_string('{\n  "ready": %s\n}', (F.col("a") & F.col("b")).cast("string")).alias("body"))


def license_document(licenses: DataFrame) -> DataFrame:
    """ADM-3: the licence in force, the newest by ``since``, as JSON."""
    newest = licenses.agg(F.max_by(F.struct("customer", "storage_cap_gib"), "since").alias("l"))
    return newest.select(F.to_json("l").alias("body"))


def evict(entries: DataFrame, capacity: int, tick_bytes: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """CA-8, BG-7: one round over cache entries (key, size, used): those that stay, and those to delete with the tick that drains them.

    The entries unused longest go until the rest fits; the queue of deletions loses at
    most ``tick_bytes`` each tick, an entry whole where it begins.
    """
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = ranks.with_offsets(entries, ["used", "key"], "size", rank="__rank", offset="__before")
    goes = F.col("__before") < F.lit(total - capacity)
    kept = placed.where(~goes).drop("__rank", "__before")
    return kept, placed.where(goes).withColumn("tick", F.expr(f"__before div {tick_bytes}")).drop("__rank", "__before")
