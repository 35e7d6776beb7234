"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from . import views as V
from .registry import query


def _pages(spark, d):
    return V.table(spark, d, "pages")


@query("sc01_split_join", "SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|') AS joined, len(string_split(url, '.'))::BIGINT AS n FROM pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(F.filter(S.split(F.col("url"), "/"), lambda x: x != ""), "|").alias("joined"), F.size(S.split(F.col("url"), ".")).cast("long").alias("n"))


@query("sc02_trim", "SELECT doc_id, md5(trim(t, chr(32) || chr(10) || chr(13) || chr(9) || chr(12) || chr(11))) AS both, md5(ltrim(t, chr(32) || chr(10) || chr(13) || chr(9) || chr(12) || chr(11))) AS l, md5(rtrim(t, chr(32) || chr(10) || chr(13) || chr(9) || chr(12) || chr(11))) AS r FROM (SELECT doc_id, chr(9) || ' ' || text || chr(10) || chr(12) AS t FROM documents)")
def _(spark, d):
    t = F.concat(F.lit("\t "), F.col("text"), F.lit("\n\f"))
    return V.table(spark, d, "documents").select("doc_id", F.md5(S.trim(t)).alias("both"), F.md5(S.ltrim(t)).alias("l"), F.md5(S.rtrim(t)).alias("r"))


@query("sc03_base64", "SELECT doc_id, md5(base64(encode(text))) AS e, md5(decode(from_base64(base64(encode(text))))) AS back FROM documents")
def _(spark, d):
    e = F.base64(F.col("text").cast("binary"))
    # Lines of 76 characters are one line elsewhere.
    flat = F.regexp_replace(e, "[\r\n]", "")
    return V.table(spark, d, "documents").select("doc_id", F.md5(flat).alias("e"), F.md5(F.unbase64(flat)).alias("back"))


@query("sc04_erase_all", "SELECT page_id, translate(url, '/.:', '') AS left FROM pages")
def _(spark, d):
    return _pages(spark, d).select("page_id", S.erase_all(F.col("url"), "/.:").alias("left"))


@query("sc05_url_encode", "SELECT page_id, replace(url_encode(url || ' ~*+'), '%2F', '/') AS kept, url_encode(url || ' ~*+') AS whole FROM pages")
def _(spark, d):
    t = F.concat("url", F.lit(" ~*+"))
    return _pages(spark, d).select("page_id", S.uri_encode(t).alias("kept"), S.uri_encode(t, keep_slash=False).alias("whole"))


@query("ls06_url_encode", "WITH " + V.V_VERSIONS + " SELECT DISTINCT name, replace(url_encode(name || ' é'), '%2F', '/') AS encoded FROM v_versions")
def _(spark, d):
    return V.versions(spark, d).select("name").distinct().select("name", S.uri_encode(F.concat("name", F.lit(" é"))).alias("encoded"))


@query("sc06_nocase_order", "SELECT n_name, row_number() OVER (ORDER BY length(n_name), lower(n_name)) AS rank, lower(n_name) = 'nation_7' AS same FROM nation")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy(*S.nocase_order(F.col("n_name")))
    return V.table(spark, d, "nation").select("n_name", F.row_number().over(w).cast("long").alias("rank"), S.equals_nocase(F.col("n_name"), F.lit("Nation_7")).alias("same"))


_WORDS = "CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN concat('', p_size) ELSE p_name END"


@query("sc07_casts", f"SELECT w, CASE WHEN lower(w) IN ('true', '1') THEN TRUE WHEN lower(w) IN ('false', '0') THEN FALSE END AS b, try_cast(w AS BIGINT) AS i FROM (SELECT DISTINCT {_WORDS} AS w FROM part)")
def _(spark, d):
    w = F.col("w")
    return V.table(spark, d, "part").selectExpr(f"{_WORDS} as w").distinct().select("w", S.to_bool(w).alias("b"), S.to_int(w).alias("i"))


@query("sc08_hex", "SELECT c_custkey, lower(hex(c_name)) AS h, upper(hex(c_name)) AS u, decode(unhex(hex(c_name))) AS back FROM customer")
def _(spark, d):
    h = F.hex("c_name")
    return V.table(spark, d, "customer").select("c_custkey", F.lower(h).alias("h"), F.upper(h).alias("u"), F.unhex(h).cast("string").alias("back"))


_TIMES = "CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '-02:00' WHEN 2 THEN '+02:00' WHEN 3 THEN '+24:00' ELSE '+00:30' END"
_ISO = f"strftime(ts, '%Y-%m-%dT%H:%M:%S') || {_TIMES}"


@query("sc09_iso8601", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT + 7200 WHEN 2 THEN floor(epoch(ts))::BIGINT - 7200 END AS at, CASE event_id % 5 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT - 7200 WHEN 2 THEN floor(epoch(ts))::BIGINT + 7200 END AS quirk FROM events")
def _(spark, d):
    """Both signs of an offset: taken away, and, as the quirk has it, added."""
    e = V.table(spark, d, "events").selectExpr("event_id", f"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), {_TIMES}) as t")
    return e.select("event_id", S.parse_iso8601(F.col("t")).alias("at"), S.parse_iso8601(F.col("t"), "reference").alias("quirk"))


@query("sc10_compact", "SELECT event_id, floor(epoch(ts))::BIGINT AS at FROM events")
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "date_format(ts, \"yyyyMMdd'T'HHmmss'Z'\") as t")
    return e.select("event_id", S.parse_compact(F.col("t")).alias("at"))


@query("sc11_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS imf FROM events")
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", f"cast({V.epoch('ts')} as bigint) as at")
    return e.select("event_id", S.format_iso8601(F.col("at")).alias("iso"), S.format_imf(F.col("at")).alias("imf"))


@query("sc12_digests", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


def _padded(key: str, byte: int) -> str:
    """A hexadecimal key of 64 bytes at most, filled up and combined with ``byte``, in DuckDB."""
    return f"unhex(array_to_string(list_transform(range(1, 129, 2), lambda i: lpad(to_hex(xor(coalesce(try_cast('0x' || nullif(substr({key}, i, 2), '') AS INTEGER), 0), {byte})), 2, '0')), ''))"


def _hmac_sql(key: str, data: str) -> str:
    return f"sha256({_padded(key, 0x5C)} || unhex(sha256({_padded(key, 0x36)} || encode({data}))))"


@query("sc13_hmac", f"SELECT c_custkey, {_hmac_sql('k', 'c_mktsegment')} AS mac FROM (SELECT *, md5(c_name) AS k FROM customer)")
def _(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.hmac_sha256(F.md5("c_name"), F.col("c_mktsegment")).alias("mac"))


#: Some seconds' work; where 64 tasks a core have more names, up to the second number, since a task costs 0.15 s and more besides.
NAMES_A_TASK, MOST_NAMES_A_TASK = 64, 512


@query("sc14_scrypt")
def _(spark, d):
    """Every user's. The function is slow on purpose: a name that several users have is hashed once, and tasks of some seconds to half a minute share out the names."""
    users = V.users(spark, d).select("id", "name")
    names = users.where("name is not null").select("name").distinct()
    n = names.count()
    dealt = names.repartition(min(n // NAMES_A_TASK, max(64 * spark.sparkContext.defaultParallelism, n // MOST_NAMES_A_TASK)) + 1)
    hashed = dealt.select("name", S.scrypt_hash(F.col("name"), F.md5("name")).alias("hash"))
    # By merging, since the hashes would else be made while a broadcast, which has a time limit, waits for them.
    return users.join(hashed.hint("merge"), "name", "left").select("id", "hash")


@query(
    "sc15_signature",
    f"""WITH k0 AS (SELECT c_custkey, c_name, lower(hex(encode('AWS4' || md5(c_name)))) AS k FROM customer),
    k1 AS (SELECT c_custkey, c_name, {_hmac_sql("k", "'20240101'")} AS k FROM k0), k2 AS (SELECT c_custkey, c_name, {_hmac_sql("k", "'us-east-1'")} AS k FROM k1),
    k3 AS (SELECT c_custkey, c_name, {_hmac_sql("k", "'s3'")} AS k FROM k2), k4 AS (SELECT c_custkey, c_name, {_hmac_sql("k", "'aws4_request'")} AS k FROM k3),
    c AS (SELECT *, 'AWS4-HMAC-SHA256' || chr(10) || '20240101T000000Z' || chr(10) || '20240101/us-east-1/s3/aws4_request' || chr(10)
        || sha256('GET' || chr(10) || '/b1/' || url_encode(c_name) || chr(10) || chr(10) || 'host:example.com' || chr(10) || chr(10) || 'host' || chr(10) || 'UNSIGNED-PAYLOAD') AS to_sign FROM k4)
    SELECT c_custkey, {_hmac_sql("k", "to_sign")} AS signature FROM c""",
)
def _(spark, d):
    """Signature version 4 of every customer's request."""
    c = V.table(spark, d, "customer").withColumn("key", S.signing_key(F.md5("c_name"), F.lit("20240101"), F.lit("us-east-1"), F.lit("s3")))
    canonical = S.canonical_request(F.lit("GET"), F.concat(F.lit("/b1/"), F.col("c_name")), F.lit(""), F.lit("host:example.com"), F.lit("host"), F.lit("UNSIGNED-PAYLOAD"))
    to_sign = S.string_to_sign(F.lit("20240101T000000Z"), F.lit("20240101/us-east-1/s3/aws4_request"), canonical)
    return c.select("c_custkey", S.hmac_sha256(F.col("key"), to_sign).alias("signature"))


@query("sc15_presigned_expiry", f"SELECT c_custkey, ({V.EPOCH_2024} + c_custkey * 60 + 3600 < {V.EPOCH_2024} + 36000) AS expired FROM customer")
def _(spark, d):
    t = V.table(spark, d, "customer").selectExpr("c_custkey", f"{V.EPOCH_2024} + c_custkey * 60 as at")
    return t.selectExpr("c_custkey", f"at + 3600 < {V.EPOCH_2024} + 36000 as expired")


@query("sc16_arn", V.with_(V.V_USERS) + "SELECT id, arn, string_split(arn, ':')[6] AS resource, len(string_split(arn, ';'))::BIGINT AS quirk FROM v_users")
def _(spark, d):
    u = V.users(spark, d)
    part = S.parse_arn(F.col("arn"))
    built = S.build_arn(*(part[k] for k in (1, 2, 3, 4, 5)))
    return u.select("id", built.alias("arn"), part[5].alias("resource"), F.size(S.parse_arn(F.col("arn"), "reference")).cast("long").alias("quirk"))


@query("sc17_bucket_key", "SELECT page_id, regexp_extract(p, '^/?([^/?#]*)', 1) AS bucket, regexp_extract(p, '^/?[^/?#]*/([^?#]*)', 1) AS key FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)")
def _(spark, d):
    p = _pages(spark, d).select("page_id", F.regexp_replace("url", "^https?://[^/]*", "").alias("p"))
    bucket, key = S.bucket_and_key(F.col("p"))
    return p.select("page_id", bucket.alias("bucket"), key.alias("key"))


@query("sc18_key_values", "SELECT page_id, CASE WHEN regexp_matches(q, '(^|&)page=') THEN regexp_extract(q, '(^|&)page=([^&]*)', 2) END AS page, CASE WHEN regexp_matches(q, '(^|&)ref=') THEN regexp_extract(q, '(^|&)ref=([^&]*)', 2) END AS ref FROM (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)")
def _(spark, d):
    m = S.key_values(F.regexp_extract("url", "\\?([^#]*)", 1))
    return _pages(spark, d).select("page_id", m["page"].alias("page"), m["ref"].alias("ref"))


_XML = "concat('<List><Key id=\"', c_custkey, '\">', c_mktsegment, '</Key><Key>x</Key></List>')"


@query("sc19_xml_path", "SELECT c_custkey, c_mktsegment || '|x' AS found FROM customer")
def _(spark, d):
    return V.table(spark, d, "customer").selectExpr("c_custkey", f"array_join(xpath({_XML}, '/List/Key/text()'), '|') as found")


@query("sc20_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(spark, d):
    """A required and an optional member, by the variant type."""
    return V.table(spark, d, "events").selectExpr("event_id", "try_variant_get(parse_json(props), '$.k', 'bigint') as k", "try_variant_get(parse_json(props), '$.none', 'string') as none")


@query("sc21_integral", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, (size + 8191) // 8192 AS pages, (size + 8191) // 8192 * 8192 AS aligned FROM v_fragments")
def _(spark, d):
    return V.fragments(spark, d).select("address_id", "idx", S.div_ceil("size", 8192).alias("pages"), S.align_up("size", 8192).alias("aligned"))


@query("sc22_epoch", V.with_(V.V_VERSIONS) + "SELECT id, least(coalesce(deleted_at, 1706000000), 1706000000) - greatest(last_modified, 1705000000) AS seconds FROM v_versions")
def _(spark, d):
    return V.versions(spark, d).selectExpr("id", "least(coalesce(deleted_at, 1706000000), 1706000000) - greatest(last_modified, 1705000000) as seconds")


@query("sc23_random", "SELECT c_custkey, 16::BIGINT AS n, TRUE AS hex FROM customer")
def _(spark, d):
    """Names by chance: what can be said of them is their form."""
    r = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)
    return V.table(spark, d, "customer").withColumn("r", r).select("c_custkey", F.length("r").cast("long").alias("n"), F.col("r").rlike("^[0-9a-f]{16}$").alias("hex"))


@query("sc24_wide_hex", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, substr(h, 1, 4) || ':' || substr(h, 5, 4) || ':' || substr(h, 9, 4) || ':' || substr(h, 13, 4) || ':' || substr(h, 17, 4) || ':' || substr(h, 21, 4) || ':' || substr(h, 25, 4) || ':' || substr(h, 29, 4) AS shown FROM (SELECT address_id, idx, lower(lpad(to_hex(address_id), 16, '0') || lpad(to_hex(ptr), 16, '0')) AS h FROM v_fragments)")
def _(spark, d):
    return V.fragments(spark, d).select("address_id", "idx", S.wide_hex("address_id", "ptr").alias("shown"))


@query("sc25_optionals", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Some:' || n_nationkey ELSE 'None' END AS shown FROM nation")
def _(spark, d):
    return V.table(spark, d, "nation").withColumn("o", F.expr("if(n_nationkey % 2 = 0, n_nationkey, null)")).selectExpr("n_nationkey", "coalesce(concat('Some:', o), 'None') as shown")
