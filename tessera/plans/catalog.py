"""Queries of the catalog, listings and multipart uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import listing as L
from . import views as V
from .registry import query

_LATEST = "max(id) OVER (PARTITION BY bucket_id, name) AS top"


@query("ct01_bucket_id", V.with_(V.V_BUCKETS) + "SELECT max(id) AS id FROM v_buckets WHERE name = 'b7' AND status <> 'Deleted'")
def _(spark, d):
    return C.bucket_id(V.buckets(spark, d), F.lit("b7"))


@query("ct02_bucket_info", V.with_(V.V_BUCKETS) + "SELECT id, name, versioning FROM v_buckets WHERE status = 'Normal'")
def _(spark, d):
    return C.bucket_info(V.buckets(spark, d))


@query(
    "ct03_create_buckets",
    V.with_(V.V_BUCKETS) + "SELECT r_regionkey + 100 AS id, 'b' || (r_regionkey * 2) AS name, NOT EXISTS (SELECT 1 FROM v_buckets b WHERE b.name = 'b' || (r_regionkey * 2) AND status = 'Normal') AS created FROM region",
)
def _(spark, d):
    names = V.table(spark, d, "region").selectExpr("r_regionkey + 100 as id", "concat('b', r_regionkey * 2) as name")
    return C.create_buckets(V.buckets(spark, d), names)


@query("ct04_delete_bucket", V.with_(V.V_BUCKETS) + "SELECT id, name, CASE WHEN name = 'b3' AND status = 'Normal' THEN 'Deleted' ELSE status END AS status, versioning, last_modified FROM v_buckets")
def _(spark, d):
    return C.delete_bucket(V.buckets(spark, d), F.lit("b3"))


@query("ct05_check_bucket", V.with_(V.V_REQUESTS, V.V_BUCKETS) + "SELECT bucket, count(*) AS n FROM v_requests r WHERE EXISTS (SELECT 1 FROM v_buckets b WHERE b.name = r.bucket AND b.status = 'Normal') GROUP BY bucket")
def _(spark, d):
    normal = V.buckets(spark, d).where("status = 'Normal'").select(F.col("name").alias("bucket"))
    return V.requests(spark, d).join(normal, "bucket", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("ct06_list_buckets", V.with_(V.V_BUCKETS) + "SELECT name FROM v_buckets WHERE status = 'Normal'")
def _(spark, d):
    return V.buckets(spark, d).where("status = 'Normal'").select("name")


@query("ct07_clear_buckets_anti", V.with_(V.V_BUCKETS, V.V_VERSIONS) + "SELECT * FROM v_buckets b WHERE NOT (status = 'Deleted' AND NOT EXISTS (SELECT 1 FROM v_versions v WHERE v.bucket_id = b.id))")
def _(spark, d):
    return C.clear_deleted_buckets(V.buckets(spark, d), V.versions(spark, d))


_COMMANDS = """commands AS (SELECT bucket_id, name, id, size, CASE WHEN status = 'Deleted' THEN 'delete' ELSE 'put' END AS op FROM v_versions)"""


@query(
    "ct08_put_disabled",
    V.with_(V.V_VERSIONS, _COMMANDS)
    + """SELECT bucket_id, name, id, size, CASE WHEN lead(id) OVER (PARTITION BY bucket_id, name ORDER BY id) IS NULL THEN 'Normal' ELSE 'Deleted' END AS status, op
    FROM commands QUALIFY op = 'put'""",
)
def _(spark, d):
    commands = V.versions(spark, d).selectExpr("bucket_id", "name", "id", "size", "if(status = 'Deleted', 'delete', 'put') as op")
    return C.put_disabled(commands)


@query(
    "ct08_fold_commands",
    V.with_(V.V_VERSIONS, V.V_BUCKETS)
    + """, c AS (SELECT v.bucket_id, v.name, v.id, v.size, v.status = 'Deleted' AS gone, b.versioning = 'Enabled' AS kept, lead(v.id) OVER (PARTITION BY v.bucket_id, v.name ORDER BY v.id) AS later FROM v_versions v JOIN v_buckets b ON b.id = v.bucket_id)
    SELECT bucket_id, name, id, CASE WHEN gone OR (NOT kept AND later IS NOT NULL) THEN 'Deleted' ELSE 'Normal' END AS status, kept AS sticky, gone AS marker, CASE WHEN gone THEN 0 ELSE size END AS size
    FROM c WHERE kept OR NOT gone""",
)
def _(spark, d):
    """Puts and deletes of every name under its bucket's versioning, one after the other."""
    mode = V.buckets(spark, d).selectExpr("id as bucket_id", "versioning")
    commands = V.versions(spark, d).selectExpr("bucket_id", "name", "id", "size", "if(status = 'Deleted', 'delete', 'put') as op").join(F.broadcast(mode), "bucket_id")
    return C.fold_commands(commands)


_GET = "SELECT * EXCLUDE (top) FROM (SELECT *, max(id) OVER (PARTITION BY bucket_id, name) AS top FROM ({rows})) WHERE id = top"


@query("ct09_latest_disabled", V.with_(V.V_VERSIONS) + _GET.format(rows="SELECT * FROM v_versions WHERE status = 'Normal'"))
def _(spark, d):
    return C.latest(V.versions(spark, d).where("status = 'Normal'"), ["bucket_id", "name"])


@query("ct09_latest_versioned", V.with_(V.V_VERSIONS) + _GET.format(rows="SELECT * FROM v_versions WHERE NOT (status = 'Deleted' AND NOT sticky)"))
def _(spark, d):
    return C.latest(V.versions(spark, d).where("not (status = 'Deleted' and not sticky)"), ["bucket_id", "name"])


@query(
    "ct09_get_by_mode",
    V.with_(V.V_BUCKETS, V.V_VERSIONS)
    + _GET.format(rows="SELECT v.* FROM v_versions v JOIN v_buckets b ON b.id = v.bucket_id WHERE CASE WHEN versioning = 'Disabled' THEN v.status = 'Normal' ELSE NOT (v.status = 'Deleted' AND NOT sticky) END"),
)
def _(spark, d):
    return C.get_object(V.versions(spark, d), V.buckets(spark, d))


@query("ct10_get_by_version", V.with_(V.V_VERSIONS) + "SELECT * FROM v_versions")
def _(spark, d):
    """Every version looked up, and as many that are not there."""
    v = V.versions(spark, d)
    wanted = v.select("bucket_id", "name", "version")
    return C.get_object_by_version(v, wanted.unionByName(wanted.withColumn("version", F.concat("version", F.lit("x")))))


@query("ct11_delete_disabled", V.with_(V.V_VERSIONS) + "SELECT id, name, CASE WHEN status = 'Normal' AND name LIKE 'u1/%' THEN 'Deleted' ELSE status END AS status FROM v_versions")
def _(spark, d):
    hit = (F.col("status") == "Normal") & F.col("name").startswith("u1/")
    return V.versions(spark, d).select("id", "name", F.when(hit, "Deleted").otherwise(F.col("status")).alias("status"))


@query("ct12_delete_version", V.with_(V.V_VERSIONS) + "SELECT id, CASE WHEN id % 97 = 0 THEN 'Deleted' ELSE status END AS status, CASE WHEN id % 97 = 0 THEN FALSE ELSE sticky END AS sticky, (id % 97 = 0 AND status = 'Deleted') AS was_marker FROM v_versions")
def _(spark, d):
    hit = F.expr("id % 97 = 0")
    return V.versions(spark, d).select("id", F.when(hit, "Deleted").otherwise(F.col("status")).alias("status"), F.when(hit, False).otherwise(F.col("sticky")).alias("sticky"), (hit & (F.col("status") == "Deleted")).alias("was_marker"))


@query("ct13_null_version", V.with_(V.V_VERSIONS) + "SELECT * FROM v_versions WHERE status = 'Normal' AND NOT sticky")
def _(spark, d):
    return C.null_version(V.versions(spark, d))


@query("ct14_delete_by_id", V.with_(V.V_VERSIONS) + "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM v_versions WHERE id % 13 <> 0")
def _(spark, d):
    v = V.versions(spark, d)
    return v.join(v.where("id % 13 = 0").select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_LIST = "SELECT id, bucket_id, name, size, last_modified FROM (SELECT *, max(id) OVER (PARTITION BY bucket_id, name) AS top FROM v_versions {where}) WHERE id = top AND status = 'Normal'"
_LISTED = ["id", "bucket_id", "name", "size", "last_modified"]


@query("ct15_list", V.with_(V.V_VERSIONS) + _LIST.format(where=""))
def _(spark, d):
    return C.list_objects(V.versions(spark, d)).select(*_LISTED)


@query("ct16_list_prefix_like", V.with_(V.V_VERSIONS) + _LIST.format(where="WHERE name LIKE 'u_0/' || '%'"))
def _(spark, d):
    return C.list_objects(V.versions(spark, d), "u_0/", like=True).select(*_LISTED)


@query("ct16_list_prefix_startswith", V.with_(V.V_VERSIONS) + _LIST.format(where="WHERE starts_with(name, 'u10')"))
def _(spark, d):
    return C.list_objects(V.versions(spark, d), "u10").select(*_LISTED)


@query("ct17_list_after", V.with_(V.V_VERSIONS) + _LIST.format(where="WHERE starts_with(name, 'u1') AND name > 'u12' AND NOT starts_with(name, 'u12')"))
def _(spark, d):
    return C.list_objects(V.versions(spark, d), "u1", after="u12").select(*_LISTED)


@query("ct18_versions", V.with_(V.V_VERSIONS) + "SELECT id, name, status, sticky FROM v_versions WHERE (status = 'Normal' OR sticky) AND starts_with(name, 'u2') AND id >= 100 AND name >= 'u20' ORDER BY name, id DESC LIMIT 1000")
def _(spark, d):
    return C.list_versions(V.versions(spark, d), "u2", "u20", 100, 1000).select("id", "name", "status", "sticky")


@query("ct18_versions_page", V.with_(V.V_VERSIONS) + "SELECT id, name, status, sticky FROM v_versions WHERE (status = 'Normal' OR sticky) AND starts_with(name, 'u2') AND (name > 'u20' OR (name = 'u20' AND id < 5000)) ORDER BY name, id DESC LIMIT 1000")
def _(spark, d):
    return C.list_versions(V.versions(spark, d), "u2", "u20", 5000, 1000, paged=True).select("id", "name", "status", "sticky")


@query("ct19_data_size", V.with_(V.V_VERSIONS) + "SELECT coalesce(sum(size), 0)::BIGINT AS size FROM v_versions WHERE status = 'Normal'")
def _(spark, d):
    return C.data_size(V.versions(spark, d))


@query("ct21_next_deleted", V.with_(V.V_VERSIONS) + "SELECT v.* FROM v_versions v LEFT JOIN (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O') r ON v.id = r.id WHERE status = 'Deleted' AND NOT sticky AND r.id IS NULL")
def _(spark, d):
    refs = V.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return C.next_deleted(V.versions(spark, d), refs)


@query("ct22_refs_fold", "SELECT o_custkey AS object_id, sum(CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END)::BIGINT AS refs FROM orders GROUP BY ALL HAVING refs > 0")
def _(spark, d):
    return C.fold_references(V.table(spark, d, "orders").selectExpr("o_custkey as object_id", "if(o_orderstatus = 'F', -1, 1) as delta"))


@query("ct23_bucket_policy", V.with_(V.V_BUCKETS) + "SELECT name, CASE WHEN name = 'b1' THEN '{\"Version\":\"2012-10-17\"}' END AS policy FROM v_buckets")
def _(spark, d):
    """Set, then read; deleted buckets keep theirs."""
    return V.buckets(spark, d).select("name", F.when(F.col("name") == "b1", F.lit('{"Version":"2012-10-17"}')).alias("policy"))


@query("ct24_bucket_cors", V.with_(V.V_BUCKETS) + "SELECT name, CASE WHEN name = 'b1' THEN '<CORSConfiguration/>' END AS cors FROM v_buckets")
def _(spark, d):
    return V.buckets(spark, d).select("name", F.when(F.col("name") == "b1", F.lit("<CORSConfiguration/>")).alias("cors"))


@query("ct25_bucket_versioning", V.with_(V.V_BUCKETS) + "SELECT name, CASE WHEN name = 'b0' AND status = 'Normal' THEN 'Suspended' ELSE versioning END AS versioning FROM v_buckets")
def _(spark, d):
    return V.buckets(spark, d).select("name", F.expr("if(name = 'b0' and status = 'Normal', 'Suspended', versioning)").alias("versioning"))


@query("ct26_ceiled_time", "SELECT event_id, (round(epoch(ts))::BIGINT + 1) AS ceiled FROM events")
def _(spark, d):
    """The second that the time rounds to, and one more."""
    micros = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    return V.table(spark, d, "events").selectExpr("event_id", f"(({micros}) + 500000) div 1000000 + 1 as ceiled")


@query("ct29_status_migration", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Deleted' WHEN 'P' THEN 'Collected' ELSE 'Normal' END AS status FROM orders")
def _(spark, d):
    code = F.create_map(F.lit("F"), F.lit("Deleted"), F.lit("P"), F.lit("Collected"), F.lit("O"), F.lit("Normal"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), code[F.col("o_orderstatus")].alias("status"))


@query("ct30_create_upload", "SELECT DISTINCT conv_id AS upload_id, 'b' || conv_id % 4 AS bucket, 'k' || conv_id AS key, 'text/plain' AS mime, 0::BIGINT AS complete FROM conversations")
def _(spark, d):
    return V.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "concat('b', conv_id % 4) as bucket", "concat('k', conv_id) as key", "'text/plain' as mime", "0L as complete").distinct()


_WRITES = """writes AS (SELECT upload_id, part_id, etag, size, 0 AS seq FROM v_parts UNION ALL
    SELECT upload_id, part_id, md5(etag), size + 1, 1 FROM v_parts WHERE (upload_id + part_id) % 3 = 0)"""


@query("ct31_part_upsert", V.with_(V.V_PARTS, _WRITES) + "SELECT upload_id, part_id, etag, size FROM writes QUALIFY row_number() OVER (PARTITION BY upload_id, part_id ORDER BY seq DESC) = 1")
def _(spark, d):
    p = V.parts(spark, d)
    again = p.where("(upload_id + part_id) % 3 = 0").selectExpr("upload_id", "part_id", "md5(etag) as etag", "size + 1 as size", "1 as seq")
    return C.put_parts(p.withColumn("seq", F.lit(0)).unionByName(again))


@query("ct32_get_upload_part", V.with_(V.V_PARTS) + "SELECT upload_id, part_id, etag, size FROM v_parts WHERE upload_id = 3 AND part_id = 2")
def _(spark, d):
    return V.parts(spark, d).where("upload_id = 3 and part_id = 2")


_UPLOADS = "uploads AS (SELECT DISTINCT conv_id AS upload_id, CASE WHEN conv_id % 4 = 0 THEN 1704067200 + conv_id * 10 END AS erased_since FROM conversations)"


def _uploads(spark, d):
    return V.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "if(conv_id % 4 = 0, 1704067200 + conv_id * 10, null) as erased_since").distinct()


@query("ct33_live_uploads", f"WITH {_UPLOADS} SELECT * FROM uploads WHERE erased_since IS NULL")
def _(spark, d):
    return C.live_uploads(_uploads(spark, d))


@query("ct34_delete_upload", f"WITH {_UPLOADS} SELECT upload_id, CASE WHEN upload_id % 5 = 1 THEN 1704070000 ELSE erased_since END AS erased_since, upload_id % 5 = 2 AS complete FROM uploads")
def _(spark, d):
    return _uploads(spark, d).selectExpr("upload_id", "if(upload_id % 5 = 1, 1704070000L, erased_since) as erased_since", "upload_id % 5 = 2 as complete")


@query("ct35_clean_deleted", f"WITH {_UPLOADS} SELECT p.conv_id AS upload_id, count(*) AS n FROM conversations p JOIN uploads u ON p.conv_id = u.upload_id WHERE erased_since IS NULL OR erased_since + 300 >= 1704067200 + 1000 GROUP BY ALL")
def _(spark, d):
    _, parts = C.clean_deleted(_uploads(spark, d), V.parts(spark, d), 1704067200 + 1000, 300)
    return parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))


@query("ct37_remove_user", V.with_(V.V_USERS, V.V_KEYS) + "SELECT username, access_key FROM v_keys WHERE username NOT IN (SELECT name FROM v_users WHERE id % 10 = 0)")
def _(spark, d):
    """Users go, and their keys with them."""
    gone = V.users(spark, d).where("id % 10 = 0").select(F.col("name").alias("username"))
    return V.keys(spark, d).join(gone, "username", "left_anti").select("username", "access_key")


@query("ct38_user_policies", "SELECT c_name AS username, 'p' || c_nationkey AS name FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT c_name, 'extra' FROM customer WHERE c_custkey % 9 = 0")
def _(spark, d):
    c = V.table(spark, d, "customer")
    old = c.selectExpr("c_name as username", "concat('p', c_nationkey) as name")
    return old.where("name <> 'p7'").unionByName(c.where("c_custkey % 9 = 0").selectExpr("c_name as username", "'extra' as name"))


@query("ct39_query_user", V.with_(V.V_USERS) + "SELECT * FROM v_users WHERE name = 'Customer#000000042'")
def _(spark, d):
    return V.users(spark, d).where("name = 'Customer#000000042'")


_NOW = V.EPOCH_2024 + 3600 * 500


@query("ct40_query_key", V.with_(V.V_USERS, V.V_KEYS) + f"SELECT access_key, username, arn, super_user, expires FROM v_keys k JOIN v_users u ON k.username = u.name WHERE expires IS NULL OR expires >= {_NOW}")
def _(spark, d):
    return C.query_key(V.keys(spark, d), V.users(spark, d), _NOW)


@query("ct41_live_keys", V.with_(V.V_KEYS) + f"SELECT * FROM v_keys WHERE expires IS NULL OR expires > {_NOW}")
def _(spark, d):
    return C.remove_expired_keys(V.keys(spark, d), _NOW)


_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'b-' || p_partkey WHEN 1 THEN 'B' || p_partkey WHEN 2 THEN 'xn--' || p_partkey WHEN 3 THEN '10.0.0.' || p_partkey % 300 WHEN 4 THEN 'a..' || p_partkey WHEN 5 THEN 'p' || p_partkey || '-s3alias' WHEN 6 THEN 'my.bucket.' || p_partkey ELSE 'x' || p_partkey || '-' END"


@query(
    "ct42_bucket_name",
    f"""SELECT name, length(name) BETWEEN 3 AND 63 AND regexp_matches(name, '^[a-z0-9][a-z0-9.-]*[a-z0-9]$') AND NOT regexp_matches(name, '[.-][.-]')
    AND NOT regexp_matches(name, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}$') AND NOT starts_with(name, 'xn--') AND NOT starts_with(name, 'sthree-')
    AND NOT ends_with(name, '-s3alias') AND NOT ends_with(name, '--ol-s3') AS valid FROM (SELECT {_NAMES} AS name FROM part)""",
)
def _(spark, d):
    return V.table(spark, d, "part").selectExpr(f"{_NAMES} as name").select("name", C.valid_bucket_name(F.col("name")).alias("valid"))


@query("ct44_deletable_buckets", V.with_(V.V_BUCKETS, V.V_VERSIONS) + "SELECT b.* FROM v_buckets b WHERE status = 'Normal' AND id NOT IN (SELECT bucket_id FROM (SELECT bucket_id, name, arg_max(status, id) AS s FROM v_versions GROUP BY ALL) WHERE s = 'Normal')")
def _(spark, d):
    return C.deletable_buckets(V.buckets(spark, d), V.versions(spark, d))


_NAMED = V.with_(V.V_VERSIONS) + "SELECT bucket_id, CASE WHEN strpos(name, '/') > 0 THEN substr(name, 1, strpos(name, '/')) ELSE name END AS entry, strpos(name, '/') > 0 AS is_prefix, count(*) AS n FROM (SELECT DISTINCT bucket_id, name FROM v_versions) GROUP BY ALL"


@query("ls01_collapse", _NAMED)
def _(spark, d):
    names = V.versions(spark, d).select("bucket_id", "name").distinct()
    return L.collapse(names, keys=["bucket_id"])


_PAGE = (
    V.with_(V.V_VERSIONS)
    + """, e AS (SELECT bucket_id, substr(name, 1, strpos(name, '/')) AS entry FROM v_versions GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY entry) AS rank, count(*) OVER (PARTITION BY bucket_id) AS total FROM e)
    """
)


def _pages(spark, d):
    names = V.versions(spark, d).select("bucket_id", "name").distinct()
    return L.page(L.collapse(names, keys=["bucket_id"]), 10, ["bucket_id"])


@query("ls02_page", _PAGE + "SELECT bucket_id, entry, rank, total > 10 AS truncated FROM r WHERE rank <= 10")
def _(spark, d):
    return _pages(spark, d).select("bucket_id", "entry", "rank", "truncated")


@query("ls03_token", _PAGE + "SELECT bucket_id, entry AS next_token FROM r WHERE rank = 10 AND total > 10")
def _(spark, d):
    return _pages(spark, d).where("next_token is not null").select("bucket_id", "next_token")


@query("ls04_lower_bound", "SELECT event_id, greatest(CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END, CASE WHEN event_id % 4 <> 0 THEN 'u' || event_id % 200 END) AS bound FROM events")
def _(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", L.lower_bound(F.expr("if(event_id % 3 <> 0, concat('u', user_id), null)"), F.expr("if(event_id % 4 <> 0, concat('u', event_id % 200), null)")).alias("bound"))


@query("ls05_is_latest", V.with_(V.V_VERSIONS) + "SELECT id, name, row_number() OVER (PARTITION BY bucket_id, name ORDER BY id DESC) = 1 AS is_latest FROM v_versions WHERE status = 'Normal' OR sticky")
def _(spark, d):
    return L.mark_latest(V.versions(spark, d).where("status = 'Normal' or sticky")).select("id", "name", "is_latest")


@query("ls07_no_keys", V.with_(V.V_VERSIONS) + "SELECT bucket_id, count(DISTINCT name) AS names, 0::BIGINT AS listed, FALSE AS truncated FROM v_versions GROUP BY bucket_id")
def _(spark, d):
    """A page of no keys is empty and not truncated, however many names a bucket has."""
    names = V.versions(spark, d).select("bucket_id", "name").distinct()
    page = L.page(L.collapse(names, keys=["bucket_id"]), 0, ["bucket_id"]).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("listed"), F.bool_or("truncated").alias("truncated"))
    both = names.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("names")).join(page, "bucket_id", "left")
    return both.select("bucket_id", "names", F.coalesce("listed", F.lit(0).cast("long")).alias("listed"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query("mp01_etag", V.with_(V.V_PARTS) + "SELECT upload_id, md5(unhex(string_agg(etag, '' ORDER BY part_id))) || '-' || count(*) AS etag, sum(size)::BIGINT AS size FROM v_parts GROUP BY upload_id")
def _(spark, d):
    return L.multipart_etag(V.parts(spark, d))


@query("mp01_etag_quirk", V.with_(V.V_PARTS) + "SELECT upload_id, md5(unhex(regexp_replace(string_agg(etag, '' ORDER BY part_id), '(.)(.)', '0\\2', 'g'))) || '-' || count(*) AS etag, sum(size)::BIGINT AS size FROM v_parts GROUP BY upload_id")
def _(spark, d):
    return L.multipart_etag(V.parts(spark, d), compat="reference")


@query(
    "mp02_validate",
    V.with_(V.V_PARTS)
    + """, w AS (SELECT upload_id, part_id, CASE WHEN (upload_id + part_id) % 11 = 0 THEN md5('x') ELSE etag END AS etag FROM v_parts WHERE (upload_id + part_id) % 7 <> 0
        UNION ALL SELECT DISTINCT upload_id, 99, md5('y') FROM v_parts WHERE upload_id % 5 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY part_id) AS place FROM w),
    s AS (SELECT *, count(*) OVER (PARTITION BY upload_id) AS stored FROM v_parts)
    SELECT p.upload_id, p.part_id, CASE WHEN s.etag IS NULL OR s.etag <> p.etag THEN 'InvalidPart' WHEN place <> p.part_id THEN 'InvalidPartOrder'
        WHEN size < 200 AND p.part_id <> stored THEN 'EntityTooSmall' END AS code
    FROM p LEFT JOIN s USING (upload_id, part_id)""",
)
def _(spark, d):
    p = V.parts(spark, d)
    wanted = p.where("(upload_id + part_id) % 7 <> 0").selectExpr("upload_id", "part_id", "if((upload_id + part_id) % 11 = 0, md5('x'), etag) as etag")
    wanted = wanted.unionByName(p.where("upload_id % 5 = 0").selectExpr("upload_id", "99L as part_id", "md5('y') as etag").distinct())
    return L.validate_completion(wanted, p, 200)
