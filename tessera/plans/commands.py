"""Queries of request commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as M
from . import views as V
from .registry import query

_CURRENT = "cur AS (SELECT v.bucket_id, v.name, max(v.id) AS object FROM v_versions v JOIN v_buckets b ON b.id = v.bucket_id WHERE CASE WHEN versioning = 'Disabled' THEN v.status = 'Normal' ELSE NOT (v.status = 'Deleted' AND NOT sticky) END GROUP BY ALL), now_ AS (SELECT cur.*, v.status, v.version, v.size FROM cur JOIN v_versions v ON v.id = cur.object)"


@query(
    "s3_01_get_object",
    V.with_(V.V_BUCKETS, V.V_VERSIONS, _CURRENT)
    + """SELECT r.id, CASE WHEN r.id % 3 = 0 THEN CASE WHEN r.id % 2 = 0 OR r.status = 'Deleted' THEN 405 ELSE 200 END WHEN n.object IS NOT NULL AND n.status <> 'Deleted' THEN 200 ELSE 404 END AS status,
    CASE WHEN r.id % 3 = 0 THEN CASE WHEN r.id % 2 = 1 AND r.status <> 'Deleted' THEN r.id END WHEN n.status <> 'Deleted' THEN n.object END AS object
    FROM v_versions r LEFT JOIN now_ n ON n.bucket_id = r.bucket_id AND n.name = r.name""",
)
def _(spark, d):
    """A read of every version's name; every third names its version, and half of these one that is not there."""
    v = V.versions(spark, d)
    requests = v.selectExpr("id", "bucket_id", "name", "case when id % 6 = 0 then 'none' when id % 3 = 0 then version end as version")
    return M.get_status(requests, v, V.buckets(spark, d))


@query(
    "s3_05_complete",
    V.with_(V.V_PARTS)
    + """, e AS (SELECT upload_id, min(part_id) AS bad FROM v_parts p WHERE (upload_id % 4 = 1 AND part_id = 2) OR (size < 100 AND part_id <> (SELECT max(part_id) FROM v_parts x WHERE x.upload_id = p.upload_id)) GROUP BY ALL)
    SELECT upload_id, CASE WHEN bad IS NULL THEN NULL WHEN upload_id % 4 = 1 AND bad = 2 THEN 'InvalidPart' ELSE 'EntityTooSmall' END AS error,
    CASE WHEN bad IS NULL THEN md5(unhex(string_agg(etag, '' ORDER BY part_id))) || '-' || count(*) END AS etag, CASE WHEN bad IS NULL THEN sum(size)::BIGINT END AS size
    FROM v_parts LEFT JOIN e USING (upload_id) GROUP BY upload_id, bad""",
)
def _(spark, d):
    p = V.parts(spark, d)
    wanted = p.selectExpr("upload_id", "part_id", "if(upload_id % 4 = 1 and part_id = 2, 'x', etag) as etag")
    return M.complete_uploads(wanted, p, 100)


@query("s3_10_list_versions", V.with_(V.V_VERSIONS) + "SELECT bucket_id, name, id, CASE WHEN status = 'Deleted' THEN 'DeleteMarker' ELSE 'Version' END AS kind, id = max(id) OVER (PARTITION BY bucket_id, name) AS is_latest FROM v_versions WHERE status = 'Normal' OR sticky")
def _(spark, d):
    return M.list_version_rows(V.versions(spark, d))


@query("s3_16_copy", V.with_(V.V_BUCKETS, V.V_VERSIONS, _CURRENT) + "SELECT r.id, c AS code, CASE WHEN c = 'OK' THEN object END AS linked, CASE WHEN c = 'OK' THEN size END AS size FROM (SELECT r.id, object, n.size, CASE WHEN object IS NULL OR n.status = 'Deleted' THEN 'NoSuchKey' WHEN r.id % 4 = 0 AND r.version <> n.version THEN 'PreconditionFailed' ELSE 'OK' END AS c FROM v_versions r LEFT JOIN now_ n ON n.bucket_id = r.bucket_id AND n.name = r.name) r")
def _(spark, d):
    v = V.versions(spark, d)
    copies = v.selectExpr("id", "bucket_id", "name", "if(id % 4 = 0, version, null) as if_match")
    return M.copy_objects(copies, v, V.buckets(spark, d))


@query("s3_18_delete_objects", V.with_(V.V_VERSIONS) + ", q AS (SELECT id % 20 * 0 + user_batch AS batch, id AS seq, bucket_id, CASE WHEN id % 9 = 0 THEN 'none' ELSE name END AS name FROM (SELECT *, CASE WHEN id < 1500 THEN 0 ELSE 1 + id // 500 END AS user_batch FROM v_versions)) SELECT batch, seq, CASE WHEN count(*) OVER (PARTITION BY batch) > 1000 THEN 'MalformedXML' WHEN name = 'none' THEN 'NoSuchKey' ELSE 'Deleted' END AS result FROM q")
def _(spark, d):
    v = V.versions(spark, d)
    batches = v.selectExpr("if(id < 1500, 0L, 1 + id div 500) as batch", "id as seq", "bucket_id", "if(id % 9 = 0, 'none', name) as name")
    return M.delete_objects(batches, v)


@query("iam_dispatch", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'iam:CreateUser' WHEN 1 THEN 'iam::PutUserPolicy' WHEN 2 THEN 'iam::DeleteAccessKey' END AS action FROM part")
def _(spark, d):
    asked = F.expr("case p_partkey % 4 when 0 then 'CreateUser' when 1 then 'PutUserPolicy' when 2 then 'DeleteAccessKey' else 'Other' end")
    return V.table(spark, d, "part").select("p_partkey", M.iam_action(asked).alias("action"))


@query("s3_02_default_mime", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'binary/octet-stream' ELSE 'text/plain' END AS mime FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", M.with_mime(F.expr("case p_partkey % 6 when 0 then null when 3 then '' else 'text/plain' end")).alias("mime"))


_LISTED = "cur AS (SELECT bucket_id, name, arg_max(status, id) AS status, max(id) AS id, arg_max(size, id) AS size FROM v_versions GROUP BY ALL), o AS (SELECT * FROM cur WHERE status = 'Normal')"
_ENTRIES = """, e AS (SELECT bucket_id, CASE WHEN strpos(substr(name, 2), '/') > 0 THEN substr(name, 1, 1 + strpos(substr(name, 2), '/')) ELSE name END AS entry, strpos(substr(name, 2), '/') > 0 AS is_prefix, NULL::BIGINT AS id, NULL::BIGINT AS size
    FROM o WHERE starts_with(name, 'u') AND name > 'u2' AND NOT starts_with(name, 'u2') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY entry) AS rank, count(*) OVER (PARTITION BY bucket_id) > 4 AS truncated FROM e)"""


@query("s3_08_list_v2", V.with_(V.V_VERSIONS, _LISTED) + _ENTRIES + " SELECT bucket_id, entry, is_prefix, id, size, rank, truncated, CASE WHEN truncated AND rank = 4 THEN entry END AS next FROM r WHERE rank <= 4")
def _(spark, d):
    """Prefixes of names behind the larger of start-after and token, four a page."""
    return M.list_objects_v2(V.versions(spark, d), "u", "/", 4, start_after="u1", token="u2")


@query(
    "s3_09_list_v1",
    V.with_(V.V_VERSIONS, _LISTED)
    + """, r AS (SELECT bucket_id, name AS entry, FALSE AS is_prefix, id, size, row_number() OVER (PARTITION BY bucket_id ORDER BY name) AS rank, count(*) OVER (PARTITION BY bucket_id) > 9 AS truncated FROM o WHERE name > 'u2' AND NOT starts_with(name, 'u2'))
    SELECT bucket_id, entry, is_prefix, id, size, rank, truncated, NULL::VARCHAR AS next FROM r WHERE rank <= 9""",
)
def _(spark, d):
    """Objects behind a marker, nine a page; without a delimiter no next marker."""
    return M.list_objects_v1(V.versions(spark, d), max_keys=9, marker="u2")


@query("s3_09_list_v1_folded", V.with_(V.V_VERSIONS, _LISTED) + _ENTRIES + " SELECT bucket_id, entry, is_prefix, id, size, rank, truncated, CASE WHEN truncated AND rank = 4 THEN entry END AS next FROM r WHERE rank <= 4")
def _(spark, d):
    return M.list_objects_v1(V.versions(spark, d), "u", "/", 4, marker="u2")


_RANGE_OF = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'bytes=10-99' WHEN 2 THEN 'bytes=-50' WHEN 3 THEN 'bytes=1-2,4-5' WHEN 4 THEN 'bytes=100000000-' ELSE 'all of it' END"


@query(
    "s3_01_ranges",
    V.with_(V.V_BUCKETS, V.V_VERSIONS, _CURRENT)
    + f""", q AS (SELECT r.id, {_RANGE_OF.replace("id %", "r.id %")} AS range, n.object, n.size, n.status FROM v_versions r LEFT JOIN now_ n ON n.bucket_id = r.bucket_id AND n.name = r.name),
    s AS (SELECT *, CASE WHEN object IS NULL OR status = 'Deleted' THEN 404 WHEN range IS NULL THEN 200 WHEN contains(range, ',') THEN 501 WHEN range = 'all of it' THEN 400 WHEN id % 6 = 4 AND size <= 100000000 OR id % 6 = 1 AND size <= 10 OR id % 6 = 2 AND size = 0 THEN 416 ELSE 206 END AS code,
        CASE id % 6 WHEN 1 THEN 10 WHEN 2 THEN greatest(size - 50, 0) WHEN 4 THEN 100000000 ELSE 0 END AS a, CASE id % 6 WHEN 1 THEN least(100, size) ELSE size END AS z FROM q)
    SELECT id, code AS status, CASE WHEN code IN (200, 206) THEN object END AS object, CASE WHEN code IN (200, 206) THEN a END AS start, CASE WHEN code IN (200, 206) THEN z END AS "end",
        CASE WHEN code = 206 THEN 'bytes ' || a || '-' || z - 1 || '/' || size END AS content_range FROM s""",
)
def _(spark, d):
    """A read of every version's name, with ranges of all kinds."""
    v = V.versions(spark, d)
    return M.get_ranges(v.selectExpr("id", "bucket_id", "name", "cast(null as string) as version", f"{_RANGE_OF} as range"), v, V.buckets(spark, d))


@query("s3_12_head", V.with_(V.V_BUCKETS, V.V_VERSIONS, _CURRENT) + "SELECT r.id, CASE WHEN n.object IS NULL OR n.status = 'Deleted' THEN 404 ELSE 200 END AS status, CASE WHEN n.status <> 'Deleted' THEN n.object END AS object, CASE WHEN n.status <> 'Deleted' THEN n.size END AS size, CASE WHEN n.status <> 'Deleted' THEN n.version END AS version, CASE WHEN n.status <> 'Deleted' THEN x.last_modified END AS last_modified FROM v_versions r LEFT JOIN now_ n ON n.bucket_id = r.bucket_id AND n.name = r.name LEFT JOIN v_versions x ON x.id = n.object")
def _(spark, d):
    v = V.versions(spark, d)
    return M.head(v.selectExpr("id", "bucket_id", "name", "cast(null as string) as version"), v, V.buckets(spark, d))


_ASKED = "SELECT c_custkey AS seq, CASE c_custkey % 4 WHEN 0 THEN 'b' || c_nationkey WHEN 1 THEN 'bucket-' || c_nationkey WHEN 2 THEN 'Not.Valid' ELSE 'own-' || c_custkey END AS name FROM customer"


def _asked(spark, d):
    return V.table(spark, d, "customer").selectExpr("c_custkey as seq", "case c_custkey % 4 when 0 then concat('b', c_nationkey) when 1 then concat('bucket-', c_nationkey) when 2 then 'Not.Valid' else concat('own-', c_custkey) end as name")


@query("s3_14_create_bucket", V.with_(V.V_BUCKETS, f"a AS ({_ASKED})") + "SELECT seq, a.name, CASE WHEN a.name = 'Not.Valid' OR length(a.name) < 3 THEN 'InvalidBucketName' WHEN seq > min(seq) OVER (PARTITION BY a.name) OR b.name IS NOT NULL THEN 'BucketAlreadyExists' ELSE 'OK' END AS code FROM a LEFT JOIN v_buckets b ON b.name = a.name AND b.status = 'Normal'")
def _(spark, d):
    return M.create_buckets(_asked(spark, d), V.buckets(spark, d))


@query("s3_15_delete_bucket", V.with_(V.V_BUCKETS, V.V_VERSIONS, _LISTED, f"a AS ({_ASKED})") + "SELECT seq, a.name, CASE WHEN b.id IS NULL THEN 'NoSuchBucket' WHEN b.id IN (SELECT bucket_id FROM o) THEN 'BucketNotEmpty' ELSE 'OK' END AS code FROM a LEFT JOIN v_buckets b ON b.name = a.name AND b.status = 'Normal'")
def _(spark, d):
    return M.delete_buckets(_asked(spark, d), V.buckets(spark, d), V.versions(spark, d))


_FAN = "fan AS (SELECT address_id, storage_id, unnest(range(ptr // 8192, (ptr + size - 1) // 8192 + 1)) AS stripe_id FROM v_fragments WHERE size > 0)"


@query("ct43_put_compensation", V.with_(V.V_FRAGMENTS, V.V_BUCKETS, _FAN) + "SELECT storage_id, stripe_id, count(*) AS refs FROM fan WHERE address_id % 2 = 0 OR 'b' || address_id % 25 IN (SELECT name FROM v_buckets WHERE status = 'Normal') GROUP BY ALL")
def _(spark, d):
    """Half of the addresses are stored; the others are put, and counted only where their bucket is there."""
    f = V.fragments(spark, d)
    counts = M.refcount.stripe_counts(f.where("address_id % 2 = 0"))
    puts = f.where("address_id % 2 = 1").selectExpr("address_id", "concat('b', address_id % 25) as bucket").distinct()
    return M.put_objects(puts, f, V.buckets(spark, d), counts)[2]


_NUMBERED = "writes AS (SELECT upload_id, part_id * 2500 - 2500 AS part_id, etag, 0 AS seq FROM v_parts UNION ALL SELECT upload_id, part_id * 2500 - 2500, md5(etag), 1 FROM v_parts WHERE (upload_id + part_id) % 3 = 0)"


@query("s3_03_upload_part", V.with_(V.V_PARTS, _NUMBERED) + "SELECT *, part_id BETWEEN 1 AND 10000 AND seq = max(seq) OVER (PARTITION BY upload_id, part_id) AS kept FROM writes")
def _(spark, d):
    """Parts written once or twice, some with numbers out of bounds: what stays, and what is unlinked."""
    p = V.parts(spark, d).selectExpr("upload_id", "part_id * 2500 - 2500 as part_id", "etag", "0 as seq", "(upload_id + part_id) % 3 = 0 as again")
    kept, gone = M.upload_parts(p.drop("again").unionByName(p.where("again").selectExpr("upload_id", "part_id", "md5(etag) as etag", "1 as seq")))
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


_UPLOADS = "uploads AS (SELECT DISTINCT conv_id AS upload_id, 'b' || conv_id % 9 AS bucket, 'k' || conv_id AS key, CASE WHEN conv_id % 4 = 0 THEN 1704067200 + conv_id * 10 END AS erased_since FROM conversations)"


def _uploads(spark, d):
    return V.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "concat('b', conv_id % 9) as bucket", "concat('k', conv_id) as key", "if(conv_id % 4 = 0, 1704067200 + conv_id * 10, null) as erased_since").distinct()


@query("s3_06_abort", V.with_(V.V_PARTS, _UPLOADS) + "SELECT upload_id, part_id, etag, size FROM v_parts WHERE upload_id % 3 = 0 AND upload_id % 4 <> 0")
def _(spark, d):
    """Every third upload is aborted; the parts of those that were live are unlinked."""
    u = _uploads(spark, d)
    return M.abort_uploads(u.where("upload_id % 3 = 0"), u, V.parts(spark, d), V.EPOCH_2024)[1]


@query("s3_07_list_uploads", V.with_(V.V_BUCKETS, _UPLOADS) + "SELECT b.name AS bucket, CASE WHEN upload_id IS NULL THEN 404 ELSE 200 END AS status, upload_id, key FROM v_buckets b LEFT JOIN uploads u ON u.bucket = b.name AND erased_since IS NULL")
def _(spark, d):
    return M.list_uploads(V.buckets(spark, d), _uploads(spark, d))


_DOCS = "docs AS (SELECT event_id AS seq, 'b' || user_id % 25 AS name, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE event_id % 3 WHEN 0 THEN 'Enabled' WHEN 1 THEN 'Suspended' ELSE 'Disabled' END AS document FROM events)"


def _docs(spark, d):
    return V.table(spark, d, "events").selectExpr("event_id as seq", "concat('b', user_id % 25) as name", "if(event_type = 'error', 'delete', 'put') as op", "case event_id % 3 when 0 then 'Enabled' when 1 then 'Suspended' else 'Disabled' end as document")


_AFTER = "SELECT b.name, CASE WHEN op = 'put' THEN 200 ELSE 404 END AS status, CASE WHEN op = 'put' THEN document END AS document FROM v_buckets b LEFT JOIN l ON l.name = b.name"


@query("s3_19_bucket_documents", V.with_(V.V_BUCKETS, _DOCS, "l AS (SELECT name, arg_max(op, seq) AS op, arg_max(document, seq) AS document FROM docs GROUP BY name)") + _AFTER)
def _(spark, d):
    """Policies or rules after puts and deletes; puts are stored as they are."""
    return M.documents_after(_docs(spark, d), V.buckets(spark, d))


@query("s3_26_put_versioning", V.with_(V.V_BUCKETS, _DOCS, "l AS (SELECT name, arg_max(op, seq) AS op, arg_max(document, seq) AS document FROM docs WHERE op = 'delete' OR document <> 'Disabled' GROUP BY name)") + _AFTER)
def _(spark, d):
    """Only Enabled and Suspended are taken."""
    return M.documents_after(_docs(spark, d), V.buckets(spark, d), ["Enabled", "Suspended"])


_IAM = """cmd AS (SELECT event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'CreateUser' WHEN 1 THEN 'CreateUser' WHEN 2 THEN 'CreateAccessKey' WHEN 3 THEN 'PutUserPolicy' WHEN 4 THEN 'PutUserPolicy' WHEN 5 THEN 'DeleteAccessKey' WHEN 6 THEN 'DeleteUserPolicy' WHEN 7 THEN 'CreateAccessKey' ELSE CASE WHEN event_type = 'error' THEN 'DeleteUser' ELSE 'PutUserPolicy' END END AS action,
    'u' || user_id % 40 AS "user", 'i' || event_id % 4 AS item, event_type AS document FROM events),
live AS (SELECT "user", min(seq) FILTER (action = 'CreateUser' AND seq > coalesce(gone, -1)) AS made FROM cmd LEFT JOIN (SELECT "user", max(seq) AS gone FROM cmd WHERE action = 'DeleteUser' GROUP BY ALL) USING ("user") GROUP BY "user" HAVING made IS NOT NULL),
own AS (SELECT cmd."user", item, ends_with(action, 'Policy') AS policy, arg_max(action, seq) AS last, arg_max(document, seq) AS document FROM cmd JOIN live ON live."user" = cmd."user" AND seq > made AND NOT ends_with(action, 'User') GROUP BY ALL)"""


def _iam(spark, d):
    return M.iam_after(V.table(spark, d, "events").selectExpr("event_id as seq", "case event_id % 9 when 0 then 'CreateUser' when 1 then 'CreateUser' when 2 then 'CreateAccessKey' when 3 then 'PutUserPolicy' when 4 then 'PutUserPolicy' when 5 then 'DeleteAccessKey' when 6 then 'DeleteUserPolicy' when 7 then 'CreateAccessKey' else if(event_type = 'error', 'DeleteUser', 'PutUserPolicy') end as action", "concat('u', user_id % 40) as user", "concat('i', event_id % 4) as item", "event_type as document"))


@query("iam_01_users", f'WITH {_IAM} SELECT "user" FROM live')
def _(spark, d):
    return _iam(spark, d)[0]


@query("iam_03_keys", f"WITH {_IAM} SELECT \"user\", item FROM own WHERE NOT policy AND last = 'CreateAccessKey'")
def _(spark, d):
    return _iam(spark, d)[1]


@query("iam_05_policies", f"WITH {_IAM} SELECT \"user\", item, document FROM own WHERE policy AND last = 'PutUserPolicy'")
def _(spark, d):
    return _iam(spark, d)[2]


@query("adm02_ready", "SELECT '{' || chr(10) || '  \"ready\": true' || chr(10) || '}' AS body")
def _(spark, d):
    return M.ready(V.buckets(spark, d), M.refcount.stripe_counts(V.fragments(spark, d)))


@query("adm03_license", "SELECT '{\"customer\":\"' || arg_max(c_name, c_custkey) || '\",\"storage_cap_gib\":' || arg_max(c_nationkey, c_custkey) || '}' AS body FROM customer")
def _(spark, d):
    return M.license_document(V.table(spark, d, "customer").selectExpr("c_name as customer", "c_nationkey as storage_cap_gib", "c_custkey as since"))


_CACHED = "c AS (SELECT event_id AS key, floor(value * 1000)::BIGINT AS size, floor(epoch(ts))::BIGINT AS used FROM events), s AS (SELECT *, (sum(size) OVER (ORDER BY used, key))::BIGINT - size AS before, (SELECT sum(size) FROM c)::BIGINT AS total FROM c)"


@query("bg07_evict", f"WITH {_CACHED} SELECT key, size, used, before // 100000 AS tick FROM s WHERE before < total - total // 3")
def _(spark, d):
    """A cache that may keep a third of what it holds: what goes, and with which tick of the deletion queue."""
    e = V.table(spark, d, "events").selectExpr("event_id as key", "cast(floor(value * 1000) as bigint) as size", f"cast({V.epoch('ts')} as bigint) as used")
    return M.evict(e, e.agg(F.expr("sum(size) div 3")).first()[0], 100000)[1]


@query("ca08_kept", f"WITH {_CACHED} SELECT key, size, used FROM s WHERE before >= total - total // 3")
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id as key", "cast(floor(value * 1000) as bigint) as size", f"cast({V.epoch('ts')} as bigint) as used")
    return M.evict(e, e.agg(F.expr("sum(size) div 3")).first()[0])[0]
