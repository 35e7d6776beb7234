"""Queries of metering, limits, analytics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import address as A
from ..operators import usage as U
from . import views as V
from .registry import query

_T0, _T1 = V.EPOCH_2024 + 5 * 86400, V.EPOCH_2024 + 12 * 86400
_USAGE = f"sum(greatest(0, least(coalesce(deleted_at, {_T1}), {_T1}) - greatest(last_modified, {_T0}))::HUGEINT * size)"


@query("ct20_usage", V.with_(V.V_VERSIONS) + f"SELECT (coalesce({_USAGE}, 0) // 1024 // 1024 // 1024)::BIGINT AS usage FROM v_versions WHERE last_modified < {_T1} AND (status = 'Normal' OR deleted_at >= {_T0})")
def _(spark, d):
    return U.compute_usage(V.versions(spark, d), _T0, _T1)


_H0, _H1 = V.EPOCH_2024, V.EPOCH_2024 + 10 * 86400


@query(
    "bg04_hourly_usage",
    V.with_(V.V_VERSIONS)
    + f""", h AS (SELECT {_H0} + i * 3600 AS hour FROM range(240) r(i))
    SELECT hour, (sum(greatest(0, least(coalesce(deleted_at, {_H1}), hour + 3600) - greatest(last_modified, hour)) * size) // 1024 // 1024 // 1024)::BIGINT AS usage
    FROM h JOIN v_versions ON last_modified < hour + 3600 AND least(coalesce(deleted_at, {_H1}), {_H1}) > hour AND (status = 'Normal' OR deleted_at IS NOT NULL) GROUP BY hour""",
)
def _(spark, d):
    return U.usage_by_interval(V.versions(spark, d), _H0, _H1)


@query("bg02_size_refresh", V.with_(V.V_VERSIONS) + "SELECT bucket_id, coalesce(sum(size) FILTER (status = 'Normal'), 0)::BIGINT AS size FROM v_versions GROUP BY ALL")
def _(spark, d):
    return V.versions(spark, d).groupBy("bucket_id").agg(F.coalesce(F.sum(F.expr("if(status = 'Normal', size, null)")), F.lit(0)).alias("size"))


@query("bg03_limits", V.with_(V.V_OBJECTS) + "SELECT id, bucket, stored, stored > 100000 AS refused, stored <= 100000 AND stored > 80000 AS warned FROM (SELECT id, bucket, sum(size) OVER (PARTITION BY bucket ORDER BY id)::BIGINT AS stored FROM v_objects)")
def _(spark, d):
    return U.check_limits(V.objects(spark, d).select("id", "bucket", "size"), 100000).select("id", "bucket", "stored", "refused", "warned")



def _log(spark, d):
    return V.fragments(spark, d).selectExpr("ptr", "size", "address_id", "idx", "address_id * 100 + idx as seq")


@query("an01_by_pointer", V.with_(V.V_FRAGMENTS) + "SELECT ptr, count(*) AS n, sum(size)::BIGINT AS bytes FROM v_fragments GROUP BY ptr")
def _(spark, d):
    return U.by_pointer(_log(spark, d))


@query("an02_histograms", V.with_(V.V_FRAGMENTS) + "SELECT size AS value, count(*) AS n FROM v_fragments GROUP BY ALL")
def _(spark, d):
    return U.histogram(_log(spark, d), F.col("size"))


@query("an02_prefixes", V.with_(V.V_OBJECTS) + "SELECT substr(text, 1, 4) AS value, count(*) AS n FROM v_objects GROUP BY ALL")
def _(spark, d):
    return U.histogram(V.objects(spark, d), F.substring("text", 1, 4))


@query("an03_age", V.with_(V.V_FRAGMENTS) + "SELECT ptr, seq, seq - first_value(seq) OVER w AS age, seq - lag(seq) OVER w AS updated_age FROM (SELECT ptr, address_id * 100 + idx AS seq FROM v_fragments) WINDOW w AS (PARTITION BY ptr ORDER BY seq)")
def _(spark, d):
    return U.fragment_ages(_log(spark, d))


@query("an04_summary", V.with_(V.V_FRAGMENTS) + ", u AS (SELECT uses, count(*) AS f FROM (SELECT ptr, count(*) AS uses FROM v_fragments GROUP BY ALL) GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY uses) AS k FROM u) SELECT CASE WHEN k <= 5 THEN uses - 1 ELSE -1 END AS deduplicated, sum(f)::BIGINT AS fragments FROM r GROUP BY ALL")
def _(spark, d):
    return U.summary(_log(spark, d))


@query("an05_top20", V.with_(V.V_OBJECTS) + "SELECT substr(text, 1, 4) AS value, count(*) AS n FROM v_objects GROUP BY ALL ORDER BY n DESC, value LIMIT 20")
def _(spark, d):
    return U.top(V.objects(spark, d), F.substring("text", 1, 4), 20)


@query(
    "an06_timing",
    """SELECT place, count(*) AS n, min(took)::BIGINT AS least, max(took)::BIGINT AS most, sum(took)::BIGINT AS total FROM (
    SELECT event_type AS place, kind, lead(kind) OVER w AS nk, lead(at_) OVER w - at_ AS took FROM (SELECT *, epoch_us(ts) AS at_, CASE WHEN event_id % 2 = 0 THEN 'enter' ELSE 'leave' END AS kind FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY at_, event_id)
    ) WHERE kind = 'enter' AND nk = 'leave' GROUP BY ALL""",
)
def _(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id as id", "user_id as line", "event_type as place", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as at", "if(event_id % 2 = 0, 'enter', 'leave') as kind")
    return U.pair_timings(e)


@query("an07_dump", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, (sum(size) OVER (PARTITION BY address_id ORDER BY idx))::BIGINT - size AS \"offset\", lpad(lower(to_hex(ptr)), 16, '0') AS pointer FROM v_fragments")
def _(spark, d):
    return A.with_offsets(V.fragments(spark, d)).selectExpr("address_id", "idx", "offset", "lower(lpad(hex(ptr), 16, '0')) as pointer")


@query("tm01_metrics", "SELECT event_type AS metric, 'u' || user_id % 3 AS label, CASE WHEN event_type IN ('view', 'click') THEN sum(floor(value)::BIGINT) ELSE arg_max(floor(value)::BIGINT, event_id) END::BIGINT AS value FROM events GROUP BY event_type, user_id % 3")
def _(spark, d):
    s = V.table(spark, d, "events").selectExpr("event_type as metric", "concat('u', user_id % 3) as label", "if(event_type in ('view', 'click'), 'counter', 'gauge') as kind", "cast(floor(value) as bigint) as value", "event_id as at", "event_id as id")
    return U.metrics(s)


@query("snk5_json", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' AS doc FROM customer")
def _(spark, d):
    """A metric document for each row."""
    return V.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("doc"))


@query("snk4_xml", "SELECT n_nationkey, '<Bucket><Name>' || n_name || '</Name><Region>' || n_regionkey || '</Region></Bucket>' AS doc FROM nation")
def _(spark, d):
    """An XML response for each row."""
    xml = F.to_xml(F.struct(F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Region")), {"rowTag": "Bucket"})
    return V.table(spark, d, "nation").select("n_nationkey", F.regexp_replace(xml, ">\\s+<", "><").alias("doc"))


@query("adm01_metrics", V.with_(V.V_OBJECTS) + "SELECT '{\"raw_data_size\":' || sum(size)::BIGINT || ',\"objects\":' || count(*) || '}' AS doc FROM v_objects")
def _(spark, d):
    return V.objects(spark, d).agg(F.sum("size").alias("raw_data_size"), F.count(F.lit(1)).alias("objects")).select(F.to_json(F.struct("raw_data_size", "objects")).alias("doc"))


@query("bg05_backoff", "SELECT try_no, 150 * (1 << (try_no - 1)) AS wait_ms, status = 429 OR status >= 500 AS retried FROM (SELECT unnest(range(1, 8)) AS try_no), (VALUES (200), (404), (429), (503)) s(status)")
def _(spark, d):
    """Waits of up to seven tries, doubling; only 429 and 5xx are tried again."""
    tries = spark.range(1, 8).withColumnRenamed("id", "try_no")
    states = spark.createDataFrame([(200,), (404,), (429,), (503,)], "status int")
    return tries.join(F.broadcast(states)).selectExpr("try_no", "150 * shiftleft(1L, cast(try_no - 1 as int)) as wait_ms", "status = 429 or status >= 500 as retried")


@query("bg08_config_conflicts", "SELECT s_nationkey AS id, count(DISTINCT s_suppkey % 3) > 1 AS conflict FROM supplier GROUP BY ALL")
def _(spark, d):
    """A group's configuration may not change: ids published with different ones."""
    return V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg((F.countDistinct(F.expr("s_suppkey % 3")) > 1).alias("conflict"))
