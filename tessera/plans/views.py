"""The engine's relations made from the driver's tables, each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.package import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> str:
    """Whole seconds since 1970, whatever the session's time zone."""
    return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"


BUCKETS = ["id bigint", "name string", "status string", "versioning string", "last_modified bigint"]


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket for each nation; the first four hold versions, every fifth is deleted."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id",
        "concat('b', n_nationkey) as name",
        "case when n_nationkey % 5 = 4 then 'Deleted' else 'Normal' end as status",
        "case n_nationkey % 3 when 0 then 'Disabled' when 1 then 'Enabled' else 'Suspended' end as versioning",
        "cast(n_regionkey as bigint) as last_modified",
    )


V_BUCKETS = """v_buckets AS (SELECT n_nationkey::BIGINT AS id, 'b' || n_nationkey AS name,
    CASE WHEN n_nationkey % 5 = 4 THEN 'Deleted' ELSE 'Normal' END AS status,
    CASE n_nationkey % 3 WHEN 0 THEN 'Disabled' WHEN 1 THEN 'Enabled' ELSE 'Suspended' END AS versioning,
    n_regionkey::BIGINT AS last_modified FROM nation)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object versions from events: an id, a bucket, a name, times in seconds, a state and a size."""
    e = table(spark, sf_dir, "events").withColumn("t", F.expr(epoch("ts")))
    return e.selectExpr(
        "event_id as id",
        "user_id % 4 as bucket_id",
        "concat('u', user_id, '/', get_json_object(props, '$.k')) as name",
        "cast(t as bigint) as last_modified",
        "case when event_type = 'error' then 'Deleted' when event_type = 'signup' and event_id % 5 = 0 then 'Collected' else 'Normal' end as status",
        "event_id % 3 = 0 as sticky",
        "cast(floor(value * 1000) as bigint) as size",
        "md5(cast(event_id as string)) as version",
        "case when event_type = 'error' or (event_type = 'signup' and event_id % 5 = 0) then cast(t + 3600 * (event_id % 48 + 1) as bigint) end as deleted_at",
    )


V_VERSIONS = """v_versions AS (SELECT event_id AS id, user_id % 4 AS bucket_id, 'u' || user_id || '/' || json_extract_string(props, '$.k') AS name,
    floor(epoch(ts))::BIGINT AS last_modified,
    CASE WHEN event_type = 'error' THEN 'Deleted' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'Collected' ELSE 'Normal' END AS status,
    event_id % 3 = 0 AS sticky, floor(value * 1000)::BIGINT AS size, md5(event_id::VARCHAR) AS version,
    CASE WHEN event_type = 'error' OR (event_type = 'signup' AND event_id % 5 = 0) THEN floor(epoch(ts))::BIGINT + 3600 * (event_id % 48 + 1) END AS deleted_at
    FROM events)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects from documents."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id", "source as bucket", "concat(lang, '/', lpad(cast(doc_id as string), 8, '0')) as name", "cast(octet_length(coalesce(text, '')) as bigint) as size", "md5(coalesce(text, '')) as etag", "coalesce(text, '') as text"
    )


V_OBJECTS = """v_objects AS (SELECT doc_id AS id, source AS bucket, lang || '/' || lpad(doc_id::VARCHAR, 8, '0') AS name,
    octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS etag, coalesce(text, '') AS text FROM documents)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of addresses from lineitem: ptr and size in bytes, in order within an address."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as address_id",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as bigint) as idx",
        "l_partkey * 4096 as ptr",
        "cast(l_quantity * 512 as bigint) as size",
        "l_suppkey % 3 as storage_id",
    )


V_FRAGMENTS = """v_fragments AS (SELECT l_orderkey AS address_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx,
    l_partkey * 4096 AS ptr, (l_quantity * 512)::BIGINT AS size, l_suppkey % 3 AS storage_id FROM lineitem)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipart uploads from conversations."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as upload_id", "cast(turn + 1 as bigint) as part_id", "md5(text) as etag", "cast(octet_length(text) as bigint) as size")


V_PARTS = """v_parts AS (SELECT conv_id AS upload_id, (turn + 1)::BIGINT AS part_id, md5(text) AS etag, octet_length(encode(text))::BIGINT AS size FROM conversations)"""

#: Hours of expiry count from here (2024-01-01 UTC).
EPOCH_2024 = 1704067200


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name", "concat('arn:aws:iam::', c_nationkey, ':user/', c_name) as arn", "c_custkey % 50 = 0 as super_user")


V_USERS = """v_users AS (SELECT c_custkey AS id, c_name AS name, 'arn:aws:iam::' || c_nationkey || ':user/' || c_name AS arn, c_custkey % 50 = 0 AS super_user FROM customer)"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for a customer; every seventh never expires."""
    return table(spark, sf_dir, "customer").selectExpr("c_name as username", "upper(substring(md5(c_name), 1, 20)) as access_key", f"case when c_custkey % 7 <> 0 then {EPOCH_2024} + 3600 * c_custkey end as expires")


V_KEYS = f"""v_keys AS (SELECT c_name AS username, upper(substr(md5(c_name), 1, 20)) AS access_key, CASE WHEN c_custkey % 7 <> 0 THEN {EPOCH_2024} + 3600 * c_custkey END AS expires FROM customer)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from events, with the action, the resource and who asks."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "case event_type when 'view' then 's3:GetObject' when 'click' then 's3:ListObjects' when 'purchase' then 's3:PutObject' when 'error' then 's3:DeleteObject' else 'iam:CreateUser' end as action",
        "concat('b', user_id % 4) as bucket",
        "concat('u', user_id, '/', get_json_object(props, '$.k')) as key",
        "concat('arn:aws:s3:::b', user_id % 4, '/u', user_id, '/', get_json_object(props, '$.k')) as resource",
        "concat('arn:aws:iam::', user_id % 5, ':user/u', user_id) as principal",
        "concat('u', user_id) as username",
        f"cast({epoch('ts')} as bigint) as at",
        "cast(floor(value) as bigint) as number",
    )


V_REQUESTS = """v_requests AS (SELECT event_id AS id,
    CASE event_type WHEN 'view' THEN 's3:GetObject' WHEN 'click' THEN 's3:ListObjects' WHEN 'purchase' THEN 's3:PutObject' WHEN 'error' THEN 's3:DeleteObject' ELSE 'iam:CreateUser' END AS action,
    'b' || user_id % 4 AS bucket, 'u' || user_id || '/' || json_extract_string(props, '$.k') AS key,
    'arn:aws:s3:::b' || user_id % 4 || '/u' || user_id || '/' || json_extract_string(props, '$.k') AS resource,
    'arn:aws:iam::' || user_id % 5 || ':user/u' || user_id AS principal, 'u' || user_id AS username,
    floor(epoch(ts))::BIGINT AS at, floor(value)::BIGINT AS number FROM events)"""


def with_(*views: str) -> str:
    """The beginning of an oracle over these relations."""
    return "WITH " + ",\n".join(views) + "\n"
