"""Neighbours and shared prefixes of whole texts against brute force."""

from pyspark.sql import functions as F

from tessera.operators import dedup as D


def _shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_neighbours_of_whole_texts(spark, sf_dir):
    bodies = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("body"))
    # Texts that differ after their first 200 characters only, and far behind them.
    long = "The quick brown fox. " * 300
    bodies = bodies.unionByName(spark.createDataFrame([(long + x,) for x in ("", "a", "b", "é", "日本")], "body string")).distinct()
    want = sorted((r["body"] for r in bodies.collect()), key=lambda t: t.encode())
    found = D.neighbours(bodies)
    shared = found.withColumn("shared", D.common_prefix(F.col("body"), F.coalesce("low", F.lit(""))))
    rows = {r["body"]: (r["low"], r["high"], r["shared"]) for r in shared.collect()}
    assert rows == {b: (low, high, _shared(b, low or "")) for low, b, high in zip([None, *want], want, [*want[1:], None])}
    assert max(s for *_, s in rows.values()) >= len(long)


def test_neighbours_are_not_sorted_in_one_task(spark):
    bodies = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("body"))
    found = D.neighbours(bodies)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows stay dealt
    try:
        rows = found.select("low", "high", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 5000 and len({r["part"] for r in rows}) > 1


def test_neighbours_of_nothing_one_and_null(spark):
    def rows(given):
        return sorted(D.neighbours(spark.createDataFrame([(x,) for x in given], "body string")).collect(), key=repr)

    assert rows([]) == [] and rows(["a"]) == [("a", None, None)]
    assert set(map(tuple, rows([None, "a", "b"]))) == {(None, None, "a"), ("a", None, "b"), ("b", "a", None)}


def test_common_prefix_has_no_cap(spark):
    long = "ñ日" * 700
    pairs = [(long + "x", long + "y"), (long, long), (long, long + "z"), ("", "a"), ("b", "a"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(D.common_prefix(F.col("a"), F.col("b"))).collect()]
    assert got == [1400, 1400, 1400, 0, 0, None]
