"""Queries of erasure coding, group states and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caches as K
from ..operators import erasure as E
from ..operators.ranks import with_offsets
from . import views as V
from .registry import query

_DATA, _PARITY, _CHUNK = 4, 2, 2048


def _shards(spark, d):
    return E.encode(V.objects(spark, d), _DATA, _PARITY, _CHUNK)


@query("ec01_striping", V.with_(V.V_OBJECTS) + f"SELECT id, (size + {_DATA * _CHUNK - 1}) // {_DATA * _CHUNK} * {_DATA + _PARITY} AS shards, (size + {_DATA * _CHUNK - 1}) // {_DATA * _CHUNK} * {(_DATA + _PARITY) * _CHUNK} AS bytes FROM v_objects WHERE size > 0")
def _(spark, d):
    return _shards(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("shards"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


def _recovered(spark, d, lost: str):
    whole = E.recover(_shards(spark, d).where(f"not ({lost})"), _DATA, _PARITY)
    joined = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("stripe_id", "data"))).alias("s"))
    body = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["data"])), ""))
    size = V.objects(spark, d).select("id", "size")
    return joined.join(size, "id").withColumn("body", body).select("id", F.expr("md5(substring(body, 1, int(size)))").alias("digest"))


@query("ec03_recover_md5", V.with_(V.V_OBJECTS) + "SELECT id, etag AS digest FROM v_objects WHERE size > 0")
def _(spark, d):
    """Two shards lost of every stripe, another two for each object: all bytes come back."""
    return _recovered(spark, d, "shard_id = id % 6 or shard_id = (id + 1 + stripe_id % 4) % 6")


@query("ec04_degraded_read", V.with_(V.V_OBJECTS) + "SELECT id, etag AS digest FROM v_objects WHERE size > 0")
def _(spark, d):
    """One storage down: reads go on."""
    return _recovered(spark, d, "shard_id = 2")


@query("ec05_too_few", V.with_(V.V_OBJECTS) + f"SELECT id, i AS stripe_id, 3 AS valid FROM (SELECT id, unnest(range(0, (size + {_DATA * _CHUNK - 1}) // {_DATA * _CHUNK})) AS i FROM v_objects WHERE id % 10 = 0)")
def _(spark, d):
    """Three shards lost: an error."""
    return E.recover(_shards(spark, d).where("not (id % 10 = 0 and shard_id in (1, 3, 4))"), _DATA, _PARITY).where("data is null").select("id", "stripe_id", "valid")


@query("ec02_xor_parity", "SELECT l_orderkey AS stripe_id, l_linenumber AS word, bit_xor(l_partkey) AS parity FROM lineitem GROUP BY ALL")
def _(spark, d):
    return E.xor_parity(V.table(spark, d, "lineitem").selectExpr("l_orderkey as stripe_id", "l_linenumber as word", "l_partkey as value"))


@query("ec06_repair_max_refcount", "SELECT l_partkey AS stripe_id, max(l_linenumber) AS refs FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL")
def _(spark, d):
    return E.repair_counts(V.table(spark, d, "lineitem").where("l_suppkey % 3 <> 0").selectExpr("l_partkey as stripe_id", "l_linenumber as refs"))


_STATES = "CASE (s_suppkey * 7 + s_nationkey) % 11 WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEW' ELSE 'ASSIGNED' END"


@query(
    "ec07_group_state",
    f"""WITH s AS (SELECT s_suppkey // 6 AS group_id, {_STATES} AS state, s_suppkey // 6 % 5 <> 4 AS seen FROM supplier),
    n AS (SELECT group_id, count(*) FILTER (state = 'ASSIGNED') AS assigned, count(*) FILTER (state = 'DOWN') AS down, bool_or(seen) AS seen FROM s GROUP BY ALL)
    SELECT group_id, assigned, down, CASE WHEN NOT seen THEN NULL WHEN assigned = 6 THEN 'HEALTHY' WHEN assigned < 4 THEN 'FAILED' WHEN down > 0 THEN 'DEGRADED' ELSE 'REPAIRING' END AS state FROM n""",
)
def _(spark, d):
    s = V.table(spark, d, "supplier").selectExpr("s_suppkey div 6 as group_id", f"{_STATES} as state", "(s_suppkey div 6) % 5 <> 4 as seen_all")
    return E.group_state(s, 6, 4)


@query("ec08_max_offset", "SELECT l_suppkey AS group_id, max(CASE WHEN l_linenumber > 1 THEN l_partkey * 4096 END) AS \"offset\" FROM lineitem GROUP BY ALL")
def _(spark, d):
    return E.leader_offset(V.table(spark, d, "lineitem").selectExpr("l_suppkey as group_id", "if(l_linenumber > 1, l_partkey * 4096, null) as offset"))


@query("ec09_placement", "SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 5 AS slot FROM supplier WHERE s_suppkey % 7 <> 3")
def _(spark, d):
    """Round robin over live services in order of id."""
    live = V.table(spark, d, "supplier").where("s_suppkey % 7 <> 3").select("s_suppkey")
    return with_offsets(live, ["s_suppkey"]).select("s_suppkey", (F.col("rank") % 5).alias("slot"))


@query("ec10_config", "SELECT p_partkey, coalesce(d + p = s AND d > 0 AND k % nullif(d, 0) = 0, FALSE) AS valid FROM (SELECT p_partkey, p_partkey % 5 AS d, p_partkey % 3 AS p, p_size % 8 AS s, 1024 AS k FROM part)")
def _(spark, d):
    c = V.table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 5 as data", "p_partkey % 3 as parity", "p_size % 8 as storages", "1024 as stripe_kib")
    return E.validate_config(c).select("p_partkey", "valid")


@query(
    "ec06_repair",
    V.with_(V.V_OBJECTS)
    + f"""SELECT id, i AS stripe_id, md5(encode(text)[i * {_DATA * _CHUNK} + {_CHUNK} + 1 : i * {_DATA * _CHUNK} + 2 * {_CHUNK}] || unhex(repeat('00', ({_CHUNK} - greatest(0, least({_CHUNK}, size - i * {_DATA * _CHUNK} - {_CHUNK})))::INTEGER))) AS digest
    FROM (SELECT *, unnest(range(0, (size + {_DATA * _CHUNK - 1}) // {_DATA * _CHUNK})) AS i FROM v_objects)""",
)
def _(spark, d):
    """Storages 1 and 4 are lost; a new storage 1 gets its shards from the other four."""
    left = _shards(spark, d).where("shard_id not in (1, 4)")
    return E.repair(left, [1, 4], _DATA, _PARITY, _CHUNK).where("shard_id = 1").select("id", "stripe_id", F.md5("payload").alias("digest"))


@query("ec11_used", V.with_(V.V_OBJECTS) + f"SELECT id, (size + {_DATA * _CHUNK - 1}) // {_DATA * _CHUNK} * {_DATA * _CHUNK} AS used FROM v_objects WHERE size > 0")
def _(spark, d):
    return E.used_space(_shards(spark, d), _DATA)


def _trace(spark, d):
    return V.table(spark, d, "events").selectExpr("event_id as seq", "get_json_object(props, '$.k') as key", "cast(floor(value * 10) as bigint) as size", "user_id", f"cast({V.epoch('ts')} as bigint) as at")


def _hits(rows):
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("uses"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.sum(F.size("evicted")).cast("long").alias("evictions"))


def _replay_sql(entry: str, hit: str, after: str) -> str:
    """Traces replayed a use at a time, by shard: ``held`` is a list of ``entry`` structs, the one to go first in front."""
    return f"""WITH RECURSIVE t AS (SELECT user_id % 8 AS shard, json_extract_string(props, '$.k') AS k, floor(value * 10)::BIGINT AS z, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
    r(shard, n, held, hits, gone) AS (SELECT DISTINCT shard, 0::BIGINT, []::{entry}[], 0::BIGINT, 0::BIGINT FROM t
        UNION ALL SELECT shard, n, now, hits + hit::BIGINT, gone + greatest(len(held) + (NOT known)::BIGINT - len(now), 0)
        FROM (SELECT *, {after} AS now FROM (SELECT r.shard, t.n, t.k, t.z, r.held, r.hits, r.gone, {hit} AS hit, list_contains(list_transform(r.held, lambda x: x.k), t.k) AS known FROM r JOIN t ON t.shard = r.shard AND t.n = r.n + 1)))
    SELECT shard, max(n) AS uses, max(hits) AS hits, max(gone) AS evictions FROM r GROUP BY shard"""


_KNOWN = "list_contains(list_transform(r.held, lambda x: x.k), t.k)"
_LFU_ENTRY = "STRUCT(u BIGINT, t BIGINT, k VARCHAR)"
_LFU_AFTER = "CASE WHEN known THEN list_sort(list_transform(held, lambda x: CASE WHEN x.k = k THEN {{'u': {uses}, 't': n, 'k': k}} ELSE x END)) ELSE list_sort(list_append(held, {{'u': 1::BIGINT, 't': n, 'k': k}}))[CASE WHEN len(held) >= 20 THEN 2 ELSE 1 END:] END"
_LRU_ENTRY = "STRUCT(t BIGINT, k VARCHAR, z BIGINT)"
_OTHERS = "list_filter(held, lambda x: x.k <> k)"


@query("ca01_lfu", _replay_sql(_LFU_ENTRY, _KNOWN, _LFU_AFTER.format(uses="x.u + 1")))
def _(spark, d):
    return _hits(K.replay(_trace(spark, d), lambda: K.Lfu(20), F.expr("user_id % 8")))


@query(
    "ca02_lru",
    """WITH t AS (SELECT event_id AS seq, user_id % 8 AS shard, json_extract_string(props, '$.k') AS key FROM events),
    p AS (SELECT *, lag(seq) OVER (PARTITION BY shard, key ORDER BY seq) AS last FROM t),
    h AS (SELECT p.shard, p.seq, p.last IS NOT NULL AND (SELECT count(DISTINCT x.key) FROM t x WHERE x.shard = p.shard AND x.seq > p.last AND x.seq < p.seq) < 20 AS hit FROM p)
    SELECT shard, count(*) AS uses, count(*) FILTER (hit) AS hits FROM h GROUP BY shard""",
)
def _(spark, d):
    """A use hits if fewer other keys than the capacity came since the last use of its key."""
    return _hits(K.replay(_trace(spark, d), lambda: K.Lru(20), F.expr("user_id % 8"))).select("shard", "uses", "hits")


@query("ca03_timed", "SELECT event_id AS seq, coalesce(floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY floor(epoch(ts)), event_id) <= 86400, FALSE) AS hit FROM events")
def _(spark, d):
    return K.timed_hits(_trace(spark, d), 86400, ["user_id", "key"]).select("seq", "hit")


@query("ca04_write_buffer", "SELECT event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS flush FROM events")
def _(spark, d):
    return K.write_batches(_trace(spark, d), 10, "user_id").select("seq", "flush")


@query(
    "ca05_read_cache",
    _replay_sql(
        _LRU_ENTRY,
        "len(list_filter(r.held, lambda x: x.k = t.k AND x.z >= t.z)) > 0",
        f"list_append({_OTHERS}, {{'t': n, 'k': k, 'z': greatest(z, coalesce(list_max(list_transform(list_filter(held, lambda x: x.k = k), lambda x: x.z)), 0))}})[CASE WHEN len({_OTHERS}) >= 30 THEN 2 ELSE 1 END:]",
    ),
)
def _(spark, d):
    return _hits(K.replay(_trace(spark, d), lambda: K.ReadCache(30), F.expr("user_id % 8")))


@query("ca07_lfu_reset", _replay_sql(_LFU_ENTRY, _KNOWN, _LFU_AFTER.format(uses="1::BIGINT")))
def _(spark, d):
    return _hits(K.replay(_trace(spark, d), lambda: K.Lfu(20, reset_on_update=True), F.expr("user_id % 8")))


_BYTES = f"list_append({_OTHERS}, {{'t': n, 'k': k, 'z': z}})"


@query("ca08_bytes_lru", _replay_sql(_LRU_ENTRY, _KNOWN, f"{_BYTES}[list_min(list_filter(range(1, len({_BYTES}) + 1), lambda i: i = len({_BYTES}) OR list_sum(list_transform({_BYTES}[i:], lambda x: x.z)) <= 2000)):]"))
def _(spark, d):
    return _hits(K.replay(_trace(spark, d), lambda: K.ByteLru(2000), F.expr("user_id % 8")))
