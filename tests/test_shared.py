"""Tables in the shared folder, and offsets that no single task computes."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import shared
from tessera.operators.ranks import with_offsets


def _folders(spark):
    top = shared.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scratch_keeps_what_is_asked_for(spark):
    before = _folders(spark)
    with shared.scratch() as kept:
        a = shared.materialize(spark.range(5).repartition(3), "a")
        kept.append(shared.materialize(a.select((F.col("id") * 2).alias("id")), "b"))
    assert sorted(r[0] for r in kept[0].collect()) == [0, 2, 4, 6, 8]
    left = _folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("b-")


def test_settings_stay(spark):
    spark.conf.unset(shared._CLEANUP)
    before = spark.conf.get(shared._CLEANUP, None)
    shared.materialize(spark.range(3), "c")
    assert spark.conf.get(shared._CLEANUP, None) == before


def test_no_local_folder_on_a_cluster():
    class Nothing:
        def __getattr__(self, name):
            return lambda *a: False if name == "isDefined" else None if name == "get" else self

    class Session:
        class sparkContext:
            master, _jsc = "spark://host:7077", Nothing()

        conf = Nothing()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_offsets_of_groups_and_ties(spark):
    rows = [(g, k % 3, k) for g, n in (("a", 200), (None, 7), ("b", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, o long, z long")
    got = with_offsets(df, ["g", F.desc("o")], "z", by=["g"]).collect()
    for g in ("a", None, "b"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [r["o"] for r in own] == sorted((r["o"] for r in own), reverse=True)
        total = 0
        for r in own:
            assert r["offset"] == total
            total += r["z"]


def test_rows_alike_are_split(spark):
    df = spark.range(4000).select(F.lit("same").alias("k"), F.lit(1).cast("long").alias("z"))
    got = with_offsets(df, ["k"], "z", parts=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r["rank"] for r in got.collect()) == list(range(4000))
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_offsets_of_nothing(spark):
    assert with_offsets(spark.range(0), ["id"], "id").columns == ["id", "rank", "offset"]
    assert with_offsets(spark.range(0), ["id"]).count() == 0
