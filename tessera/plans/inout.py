"""Queries of sources, sinks and streams."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import new_path
from ..sources import bodies as B
from ..sources import log as L
from ..sources import watch as W
from ..streaming import jobs as J
from . import views as V
from .registry import query


@query("src01_content_length", V.with_(V.V_OBJECTS) + "SELECT id, id % 4 <> 0 AS ok FROM v_objects")
def _(spark, d):
    o = V.objects(spark, d).withColumn("declared", F.expr("if(id % 4 = 0, size + 1, size)"))
    return o.select("id", B.content_length_ok(F.col("text").cast("binary"), F.col("declared")).alias("ok"))


@query("src02_chunked", V.with_(V.V_OBJECTS) + "SELECT id, CASE WHEN id % 10 <> 3 THEN etag END AS digest FROM v_objects WHERE size > 0")
def _(spark, d):
    """Bodies sent in two chunks (a single byte in one), with an extension and a trailer, come back whole; cut ones are refused."""
    # An empty chunk would be the last one.
    half = "substring(raw, 1, int((size + 1) div 2))"
    rest = "substring(raw, int((size + 1) div 2) + 1, int(size))"
    o = V.objects(spark, d).where("size > 0").withColumn("raw", F.expr("cast(text as binary)"))
    sized = lambda x: f"cast(lower(hex(octet_length({x}))) as binary)"
    crlf = "x'0D0A'"
    second = f"if(size > 1, concat({sized(rest)}, {crlf}, {rest}, {crlf}), x'')"
    body = f"concat({sized(half)}, cast(';a=b' as binary), {crlf}, {half}, {crlf}, {second}, cast('0' as binary), {crlf}, cast('x-trailer: 1' as binary), {crlf}, {crlf})"
    sent = o.withColumn("body", F.expr(f"if(id % 10 <> 3, {body}, substring({body}, 1, 20))"))
    return sent.select("id", F.md5(B.decode_chunked("body")).alias("digest"))


_AT, _SCOPE, _KEY = "20240101T000000Z", "20240101/us-east-1/s3/aws4_request", hashlib.sha256(b"key").hexdigest()


@query("src03_chunk_signed", "SELECT c_custkey, c_custkey % 5 <> 0 AS ok FROM customer")
def _(spark, d):
    """Signed bodies; those of every fifth customer were changed on the way."""
    @F.pandas_udf(T.BinaryType())
    def sent(name: pd.Series, key: pd.Series) -> pd.Series:
        whole = [B.encode_signed(bytes.fromhex(_KEY), _AT, _SCOPE, "00", [n.encode(), b"more"]) for n in name]
        return pd.Series([w.replace(b"more", b"less") if k % 5 == 0 else w for w, k in zip(whole, key, strict=True)])

    c = V.table(spark, d, "customer").withColumn("body", sent("c_name", "c_custkey"))
    return c.select("c_custkey", B.verify_signed(_KEY, _AT, _SCOPE)("body", F.lit("00")).alias("ok"))


@query("src04_body_sha256", V.with_(V.V_OBJECTS) + "SELECT id, id % 3 <> 0 AS ok FROM v_objects")
def _(spark, d):
    o = V.objects(spark, d).withColumn("header", F.expr("if(id % 3 = 0, sha2('x', 256), upper(sha2(text, 256)))"))
    return o.select("id", B.sha256_ok(F.col("text").cast("binary"), F.col("header")).alias("ok"))


@query("src05_string_body", "SELECT * FROM (VALUES ('a', 5::BIGINT), ('b', 0)) t(path, n)")
def _(spark, d):
    return B.string_bodies(spark, {"a": "hello", "b": ""}).select("path", F.octet_length("content").cast("long").alias("n"))


@query("src06_scan", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _log(spark, d):
    """A payload row for each document; documents divisible by 7 are holes."""
    o = V.objects(spark, d).where("size > 0")
    payload = o.where("id % 7 <> 0").selectExpr("id % 3 as storage_id", "id * 1000000 as ptr", "size", "cast(text as binary) as bytes")
    fragments = o.selectExpr("id as address_id", "0L as idx", "id % 3 as storage_id", "id * 1000000 as ptr", "size")
    return fragments, payload


@query("src07_log_read", V.with_(V.V_OBJECTS) + "SELECT id, CASE WHEN id % 7 <> 0 THEN etag ELSE md5(repeat(chr(0), size::BIGINT)) END AS digest FROM v_objects WHERE size > 0")
def _(spark, d):
    """Holes read as zeros."""
    return L.read_fragments(*_log(spark, d)).select(F.col("address_id").alias("id"), F.md5("bytes").alias("digest"))


@query("src08_read_range", V.with_(V.V_OBJECTS) + "SELECT id, hex(encode(text)[101:200]) AS bytes FROM v_objects WHERE size > 100 AND id % 7 <> 0")
def _(spark, d):
    return L.read_range(*_log(spark, d), 100, 200).select(F.col("address_id").alias("id"), F.hex("bytes").alias("bytes"))


@query("snk2_hole_punch", V.with_(V.V_OBJECTS) + "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM v_objects WHERE size > 0 AND id % 7 <> 0 AND NOT (id % 5 = 0)")
def _(spark, d):
    """The stripes of every fifth document are freed: its row goes from the log."""
    _, payload = _log(spark, d)
    freed = payload.where("(ptr div 1000000) % 5 = 0").selectExpr("storage_id", "explode(sequence(ptr div 8192, (ptr + size - 1) div 8192)) as stripe_id")
    left = L.punch(payload, freed)
    return left.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("ptr div 1000000")).alias("ids"))


@query("snk1_log_roundtrip", V.with_(V.V_OBJECTS) + "SELECT id % 3 AS storage_id, count(*) AS n, sum(size)::BIGINT AS bytes FROM v_objects WHERE size > 0 AND id % 7 <> 0 GROUP BY ALL")
def _(spark, d):
    """The log written by file and read again."""
    _, payload = _log(spark, d)
    path = new_path(spark, "log")
    L.write_log(payload.withColumn("file_no", F.expr("ptr div 100000000")), path)
    return L.read_log(spark, path).selectExpr("cast(storage_id as bigint) as storage_id", "size").groupBy("storage_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("src10_watch_snapshot", "SELECT key, revision, value FROM (SELECT 'u' || user_id AS key, max(event_id) AS revision, arg_max(event_type, event_id) AS op, arg_max(floor(value)::BIGINT, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) * 4 // 5 FROM events) AND starts_with('u' || user_id, 'u1') GROUP BY user_id) WHERE op <> 'error'")
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("concat('u', user_id) as key", "event_id as revision", "if(event_type = 'error', 'delete', 'put') as op", "cast(floor(value) as bigint) as value")
    return W.snapshot(e, "u1", e.agg(F.expr("max(revision) * 4 div 5")).first()[0])


@query("src11_policies", "SELECT '{\"Version\":\"2012-10-17\",\"Id\":\"' || n_name || '\"}' AS policy, n_name AS id FROM nation")
def _(spark, d):
    """A policy file for each nation, written and loaded whole."""
    path = new_path(spark, "policies")
    doc = F.concat(F.lit('{"Version":"2012-10-17","Id":"'), F.col("n_name"), F.lit('"}'))
    V.table(spark, d, "nation").repartition(25, "n_nationkey").select(doc.alias("value"), F.col("n_nationkey").alias("file")).write.partitionBy("file").text(path)
    return W.read_policies(spark, f"{path}/*").select(F.rtrim(F.col("policy"), F.lit("\n")).alias("policy")).select("policy", F.get_json_object("policy", "$.Id").alias("id"))


@query("st_ct19_data_size", V.with_(V.V_VERSIONS) + "SELECT coalesce(sum(size), 0)::BIGINT AS size FROM v_versions WHERE status = 'Normal'")
def _(spark, d):
    return J.drain(J.stream_data_size(J.as_stream(V.versions(spark, d).select("status", "size"))))


@query("st_bg04_hourly", V.with_(V.V_VERSIONS) + "SELECT last_modified // 3600 * 3600 AS hour, count(*) AS n, sum(size)::BIGINT AS size FROM v_versions GROUP BY ALL")
def _(spark, d):
    return J.drain(J.stream_hourly(J.as_stream(V.versions(spark, d).selectExpr("last_modified as at", "size"))))


@query("st_ec07_states", "SELECT user_id // 6 AS group_id, user_id % 6 AS storage_id, arg_max(event_type, event_id) AS state, count(*) AS reports FROM events GROUP BY ALL")
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("user_id div 6 as group_id", "user_id % 6 as storage_id", "event_type as state", "event_id as seq")
    return J.drain(J.stream_states(J.as_stream(e)))


@query("bg01_garbage", V.with_(V.V_VERSIONS, V.V_FRAGMENTS) + ", g AS (SELECT id FROM v_versions WHERE status = 'Deleted' AND NOT sticky AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) SELECT (SELECT count(*) FROM v_versions WHERE id NOT IN (SELECT id FROM g)) AS kept, count(*) AS unlinked, sum(size)::BIGINT AS bytes FROM v_fragments WHERE address_id IN (SELECT id FROM g)")
def _(spark, d):
    refs = V.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    kept, unlinked = J.collect_garbage(V.versions(spark, d), refs, V.fragments(spark, d))
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(unlinked.agg(F.count(F.lit(1)).alias("unlinked"), F.sum("size").alias("bytes"))))
