"""The relational primitives that the catalog is made of, one small query each (REL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import latest, upsert
from ..operators.ranks import with_offsets
from . import views as V
from .registry import query


def _t(spark, d, name):
    return V.table(spark, d, name)


@query("rel01_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def _(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '5-LOW'").select("o_orderkey")


@query("rel02_not_and", V.with_(V.V_VERSIONS) + "SELECT id FROM v_versions WHERE NOT (status = 'Deleted' AND NOT sticky)")
def _(spark, d):
    return V.versions(spark, d).where(~((F.col("status") == "Deleted") & ~F.col("sticky"))).select("id")


@query("rel03_like", "SELECT p_partkey FROM part WHERE p_name LIKE 'blue' || '%'")
def _(spark, d):
    return _t(spark, d, "part").where(F.col("p_name").like("blue" + "%")).select("p_partkey")


@query("rel04_starts_with", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'b') AND p_name > 'blue c'")
def _(spark, d):
    return _t(spark, d, "part").where(F.col("p_name").startswith("b") & (F.col("p_name") > "blue c")).select("p_partkey")


@query("rel05_typed_null", "SELECT n_nationkey, n_name, NULL::VARCHAR AS version FROM nation")
def _(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("version"))


@query("rel06_join_on_max", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders JOIN (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY ALL) ON o_custkey = c AND o_orderkey = k")
def _(spark, d):
    return latest(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("rel07_two_tables", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def _(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("rel08_name_join", V.with_(V.V_KEYS, V.V_USERS) + "SELECT access_key, arn FROM v_keys JOIN v_users ON username = name")
def _(spark, d):
    k, u = V.keys(spark, d), V.users(spark, d)
    return k.join(u, k["username"] == u["name"]).select("access_key", "arn")


@query("rel09_left_is_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' WHERE o_orderkey IS NULL")
def _(spark, d):
    """Customers without a finished order."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("rel10_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(spark, d):
    p, li = _t(spark, d, "part"), _t(spark, d, "lineitem").where("l_quantity > 45")
    return p.join(li, p.p_partkey == li.l_partkey, "left_anti").select("p_partkey")


@query("rel11_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount = 0.1)")
def _(spark, d):
    s, li = _t(spark, d, "supplier"), _t(spark, d, "lineitem").where("l_discount = 0.1")
    return s.join(li, s.s_suppkey == li.l_suppkey, "left_semi").select("s_suppkey")


@query("rel12_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3)")
def _(spark, d):
    top = _t(spark, d, "customer").where("c_nationkey = 3").agg(F.max("c_custkey").alias("o_custkey"))
    return _t(spark, d, "orders").join(F.broadcast(top), "o_custkey").select("o_orderkey")  # one row


@query("rel13_group_max", "SELECT l_partkey, l_suppkey, max(l_orderkey) AS top FROM lineitem GROUP BY ALL")
def _(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_orderkey").alias("top"))


@query("rel14_global_sum", "SELECT coalesce(sum(l_partkey), 0)::BIGINT AS total FROM lineitem WHERE l_quantity > 100")
def _(spark, d):
    return _t(spark, d, "lineitem").where("l_quantity > 100").agg(F.coalesce(F.sum("l_partkey"), F.lit(0)).alias("total"))


@query("rel15_count", V.with_(V.V_VERSIONS) + "SELECT count(*) AS n FROM (SELECT bucket_id, name, arg_max(status, id) AS s FROM v_versions GROUP BY ALL) WHERE s = 'Normal'")
def _(spark, d):
    return latest(V.versions(spark, d), ["bucket_id", "name"]).where("status = 'Normal'").agg(F.count(F.lit(1)).alias("n"))


@query("rel16_order", "SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey DESC) AS place FROM orders")
def _(spark, d):
    rows = _t(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return with_offsets(rows, ["o_orderpriority", F.desc("o_orderkey")]).select("o_orderpriority", "o_orderkey", (F.col("rank") + 1).alias("place"))


@query("rel17_top1", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def _(spark, d):
    return _t(spark, d, "orders").orderBy(F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_custkey")


@query("rel18_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 37")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(37)


@query("rel19_accumulate", "SELECT sum(greatest(l_partkey - 500, 0) * (l_quantity)::BIGINT)::BIGINT AS total FROM lineitem")
def _(spark, d):
    return _t(spark, d, "lineitem").agg(F.sum(F.expr("greatest(l_partkey - 500, 0) * cast(l_quantity as bigint)")).alias("total"))


@query("rel20_insert_returning", "SELECT 100000 + row_number() OVER (ORDER BY c_custkey) AS id, c_name AS name FROM customer WHERE c_nationkey = 5")
def _(spark, d):
    new = _t(spark, d, "customer").where("c_nationkey = 5")
    return with_offsets(new.select("c_custkey", "c_name"), ["c_custkey"]).select((F.col("rank") + 100001).alias("id"), F.col("c_name").alias("name"))


@query("rel21_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT 900000 + n_nationkey, 'new' FROM nation")
def _(spark, d):
    c = _t(spark, d, "customer")
    old = c.selectExpr("c_custkey as k", "c_mktsegment as v")
    new = c.where("c_custkey % 3 = 0").selectExpr("c_custkey as k", "'new' as v").unionByName(_t(spark, d, "nation").selectExpr("900000L + n_nationkey as k", "'new' as v"))
    return upsert(old, new, ["k"])


@query("rel22_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("rel23_update_from", "SELECT c_custkey, coalesce(CASE WHEN n_regionkey = 2 THEN n_name END, c_mktsegment) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation").where("n_regionkey = 2")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", "c_mktsegment").alias("label"))


@query("rel24_delete_cascade", "SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def _(spark, d):
    gone = _t(spark, d, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("rel25_interval", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 300 DAY < TIMESTAMP '1996-01-01'")
def _(spark, d):
    return _t(spark, d, "orders").where("o_orderdate + interval 300 days < timestamp_ntz'1996-01-01 00:00:00'").select("o_orderkey")


@query("rel26_raise", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'TooCheap' WHEN o_orderstatus = 'P' THEN 'Pending' END AS violation FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 1000, "TooCheap").when(F.col("o_orderstatus") == "P", "Pending").alias("violation"))


@query("rel27_optional_conditions", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 100")
def _(spark, d):
    """Conditions put together from those that are given."""
    given = {"o_orderstatus": ("==", "F"), "o_custkey": (">=", 100), "o_orderpriority": None}
    rows = _t(spark, d, "orders")
    for column, wanted in given.items():
        if wanted is not None:
            how, value = wanted
            rows = rows.where(F.col(column) == value if how == "==" else F.col(column) >= value)
    return rows.select("o_orderkey")


@query("rel28_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c.intersect(_t(spark, d, "supplier").select("s_nationkey"))
