"""Golden cases of operators, and nulls and empty inputs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import address as A
from tessera.operators import caches, catalog, cors, dedup, erasure, listing, policy, refcount, usage
from tessera.sources import bodies, watch

KIB = 1024


def one(spark, *columns, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize(("start", "end", "want"), [(0, 1 << 50, (40, 60)), (15, 1 << 50, (55, 45)), (15, 27, (55, 12)), (50, 400, (90, 10)), (300, 90, (None, None))])
def test_sub_fragment(spark, start, end, want):
    ptr, size = A.sub_fragment(F.lit(40), F.lit(60), F.lit(start), F.lit(end))
    assert one(spark, ptr, size) == want


_A, _B = [(7, 90)], [(7, 90), (500, 33), (500, 33), (12, 300)]


@pytest.mark.parametrize(("fragments", "start", "end", "want"), [(_A, 10, 25, [(17, 15)]), (_A, 60, 40, []), (_A, 10, 90, [(17, 80)]), (_B, 85, 130, [(92, 5), (500, 33), (500, 7)]), (_B, 100, 900, [(510, 23), (500, 33), (12, 300)])])
def test_address_range(spark, fragments, start, end, want):
    rows = spark.createDataFrame([(1, i, p, s) for i, (p, s) in enumerate(fragments)], "address_id long, idx long, ptr long, size long")
    got = A.byte_range(rows, F.lit(start), F.lit(end)).orderBy("idx").collect()
    assert [(r["ptr"], r["size"]) for r in got] == want


@pytest.mark.parametrize(("header", "want"), [("bytes=64-127", (64, 128)), ("bytes=600-", (600, 640)), ("bytes=-40", (600, 640)), ("bytes=-641", (0, 640)), ("bytes=-", (None, None)), ("x", (None, None))])
def test_range_header(spark, header, want):
    start, end = A.parse_range(F.lit(header), F.lit(640).cast("long"))
    assert one(spark, start, end) == want


def test_erasure_pointers(spark):
    assert one(spark, A.storage_to_group("s", "p", 4 * KIB, 3), s=2, p=9 * KIB) == (33 * KIB,)
    assert one(spark, *A.group_to_storage("p", 4 * KIB, 3), p=33 * KIB) == (2, 9 * KIB)


def test_dictionary_calls():
    data = random.Random(42).randbytes(66)
    d = dedup.Dictionary()
    first = dedup.greedy_scan(data, d)
    assert first == [(0, 66, None)]
    dedup.learn_call(data, first, d)
    for _ in range(2):
        assert dedup.greedy_scan(data, d) == [(0, 66, data)]


def test_dictionary_sees_earlier_calls_only():
    half = random.Random(1).randbytes(8192)
    assert [x[2] for x in dedup.greedy_scan(half + half, dedup.Dictionary())] == [None, None]


def test_match_must_exceed_32_bytes():
    d = dedup.Dictionary()
    d.insert(b"x" * 32 + b"tail" * 20)
    assert dedup.greedy_scan(b"x" * 32 + b"else" * 20, d)[0][2] is None
    assert dedup.greedy_scan(b"x" * 32 + b"tail!", d)[0][:2] == (0, 36)


def test_neighbours_of_the_dictionary():
    d = dedup.Dictionary()
    assert d.match(b"a" * 8192) == (0, None)
    d.insert(b"a" * 8192)
    d.insert(b"c" * 2048)
    assert d.match(b"b" * 4096) == (0, None)
    assert d.match(b"c" * 100)[0] == 100 and d.match(b"a" * 9000)[0] == 8192


def test_forgetting_the_least_used():
    r = random.Random(3)
    a, b, c = (bytes([k]) + r.randbytes(99) for k in range(3))
    d = dedup.Dictionary(2)
    d.insert(a)
    d.insert(b)
    d.touch(a)
    d.insert(c)
    assert sorted(d.bodies) == [a, c]
    d.insert(b, header=True)  # headers have room of their own
    assert len(d.bodies) == 3


def test_first_writer_wins():
    d = dedup.Dictionary()
    d.insert(b"a" * 16 + b"bcd")
    d.insert(b"a" * 16 + b"bc")
    d.insert(b"a" * 16 + b"x")
    assert len(d.bodies) == 2


def test_greedy_dedup_rebuilds(spark):
    rows = [(i, random.Random(i % 3).randbytes(20000)) for i in range(9)] + [(9, None), (10, b"")]
    found = dedup.greedy_dedup(spark.createDataFrame(rows, "id long, text binary"), F.lit(0)).collect()
    new = sum(r["size"] for r in found if not r["stored"])
    assert sum(r["size"] for r in found) == 9 * 20000
    assert new == 3 * 20000


def test_reference_counts(spark):
    counts = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "storage_id long, stripe_id long, refs long")
    more = spark.createDataFrame([(0, 2, 1), (0, 3, 1)], "storage_id long, stripe_id long, refs long")
    after, refused = refcount.link(counts, more)
    assert sorted(map(tuple, after.collect())) == [(0, 1, 1), (0, 2, 3)]
    assert [tuple(r) for r in refused.collect()] == [(0, 3, 1)]
    after, refused = refcount.link(counts, more, upstream=False)
    assert after.count() == 3 and refused.count() == 0
    left, freed, errors = refcount.unlink(counts, spark.createDataFrame([(0, 1, 1), (0, 9, 1)], "storage_id long, stripe_id long, refs long"))
    assert [tuple(r) for r in left.collect()] == [(0, 2, 2)]
    assert [tuple(r) for r in freed.collect()] == [(0, 1)]
    assert [tuple(r) for r in errors.collect()] == [(0, 9, 1)]


def test_contiguous_stripes_are_one_run(spark):
    assert [tuple(r) for r in refcount.runs(spark.range(128).selectExpr("0L as storage_id", "id as stripe_id")).collect()] == [(0, 0, 128)]


def test_recover_two_losses_not_three(spark):
    raw = random.Random(7).randbytes(4 * 512 + 17)
    shards = erasure.encode(spark.createDataFrame([(1, raw)], "id long, text binary"), 4, 2, 512)
    back = erasure.recover(shards.where("shard_id not in (1, 3)"), 4, 2).orderBy("stripe_id").collect()
    assert b"".join(r["data"] for r in back)[: len(raw)] == raw
    assert all(r["data"] is None for r in erasure.recover(shards.where("shard_id not in (1, 3, 4)"), 4, 2).collect())


def test_parity_of_zeros_is_zero(spark):
    shards = erasure.encode(spark.createDataFrame([(1, b"\0" * 300)], "id long, text binary"), 3, 2, 100)
    assert {bytes(r["payload"]) for r in shards.collect()} == {b"\0" * 100}


def test_any_data_shards_suffice():
    import itertools

    import numpy as np

    g = erasure.generator(4, 3)
    for rows in itertools.combinations(range(7), 4):
        m = g[list(rows)]
        assert (erasure.combine(erasure.invert(m), m) == np.eye(4, dtype=np.uint8)).all()


_VARIABLES = [("${foo}", "bar"), ("${none}x", "x"), ("${}", ""), ("${foo}${", "bar${"), ("\\${foo}", "${foo}"), ("${${foo}}", "}"), ("${*}${?}${$}", "*?$")]


@pytest.mark.parametrize(("text", "want"), _VARIABLES)
def test_variables(text, want):
    assert policy.replace_variables(text, {"foo": "bar"}.get) == want


_GLOBS = [("foo*", "foo", True), ("ba?", "baz", True), ("foo*bar", "fooqbarquuxbar", True), ("*?", "f", True), ("???", "foo", True), ("", "bar", False), ("*?", "", False), ("root", "arn:foo:root", False), ("foo*bar", "fooqbarxx", False)]


@pytest.mark.parametrize(("pattern", "value", "want"), _GLOBS)
def test_globs(spark, pattern, value, want):
    assert one(spark, policy.glob(F.lit(value), pattern)) == (want,)


def _decide(spark, statement, at="2024-06-01T00:00:00Z"):
    s = policy.parse(json.dumps({"Version": policy.VERSION, "Statement": [{"Effect": "Allow", "Action": "*", "Resource": "*"} | statement]}))
    requests = policy.Requests(action=F.lit("s3:GetObject"), resource=F.lit("arn:aws:s3:::b/k"), principal=F.lit("p"), variables={"aws:CurrentTime": F.lit(at)})
    return one(spark, policy.decide(s, requests))[0]


def test_policy_dates(spark):
    after = {"DateGreaterThan": {"aws:CurrentTime": "2020-01-01T00:00:00Z"}}
    assert _decide(spark, {"Condition": after}) == "Allow"
    assert _decide(spark, {"Condition": {"DateGreaterThan": {"aws:CurrentTime": "2220-01-01T00:00:00Z"}}}) == "Deny"
    assert _decide(spark, {"Condition": after | {"DateLessThan": {"aws:CurrentTime": "2021-01-01T00:00:00Z"}}}) == "Deny"
    assert _decide(spark, {"Condition": {"DateGreaterThan": {"aws:nothing": "2020-01-01T00:00:00Z"}}}) == "Deny"
    with pytest.raises(policy.PolicyError):
        _decide(spark, {"Condition": {"DateGreaterThan": {"aws:CurrentTime": ["2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z"]}}})


def test_cors_wildcards(spark):
    m = lambda p, h, c="s3": one(spark, cors.header_matches(F.lit(p), F.lit(h), c))[0]
    assert m("x-*", "x-a") and m("*", "y") and m("a", "a") and not m("a", "b") and not m("x-*", "xya")
    assert m("x-*", "xya", "reference")


@pytest.mark.parametrize(("text", "want"), [("2019-07-04T05:06:07Z", 1562216767), ("2019-07-04T05:06:07+02:00", 1562216767 - 7200), ("2019-07-04T05:06:07+24:00", None), ("2019-07-04T05:06:07+00:01", None), ("2019-07-04T05:06:07.5Z", None), ("2261-01-01T00:00:00Z", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, S.parse_iso8601(F.lit(text).cast("string"))) == (want,)


def test_date_sign_quirk_and_formats(spark):
    assert one(spark, S.parse_iso8601(F.lit("2019-07-04T05:06:07-02:00"), "reference")) == (1562216767 - 7200,)
    assert one(spark, S.format_iso8601(F.lit(1562216767))) == ("2019-07-04T05:06:07Z",)
    assert one(spark, S.format_imf(F.lit(1562216767))) == ("Thu, 04 Jul 2019 05:06:07 GMT",)
    assert one(spark, S.parse_compact(F.lit("20221109T080706Z"))) == (1667981226,)


def test_signature_version_4_key(spark):
    # A published example of the key derivation.
    key = one(spark, S.signing_key(F.lit("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"), F.lit("20150830"), F.lit("us-east-1"), F.lit("iam")))[0]
    assert key == "c4afb1cc5771d871763a393e44b703571b55cc28424d1a5e86da6ed3c154a4b9"


def test_lfu():
    def evicted(capacity, keys):
        c = caches.Lfu(capacity)
        return [g for k in keys for g in c.use(str(k))[1]]

    assert evicted(5, [0, 1, 2, 3, 4, 5]) == ["0"]
    assert evicted(5, [0, 1, 2, 3, 4, 0, 5]) == ["1"]
    assert evicted(5, [0, 1, 2, 3, 4, 0, 1, 3, 4, 5]) == ["2"]
    assert evicted(1, [0, 1]) == ["0"]
    c = caches.Lfu(2)
    c.use("a"), c.use("b"), c.erase("a")
    assert c.use("c")[1] == []
    hot = caches.Lfu(2)
    for k in "aabb":
        hot.use(k)
    assert hot.use("c") == (False, ["c"])


def test_lru_and_bytes():
    c = caches.Lru(2)
    assert [c.use(k)[1] for k in "abac"] == [[], [], [], ["b"]]
    b = caches.ByteLru(10)
    b.use("a", 6)
    b.pinned.add("a")
    b.use("b", 4)
    assert b.use("c", 5)[1] == ["b"]
    r = caches.ReadCache(4)
    r.use("a", 5)
    assert r.use("a", 3)[0] and not r.use("a", 9)[0] and r.use("a", 9)[0]


def _fold(spark, mode, ops):
    commands = spark.createDataFrame([(0, "k", i, op, 10, mode) for i, op in enumerate(ops)], "bucket_id long, name string, id long, op string, size long, versioning string")
    return [(r["id"], r["status"], r["sticky"]) for r in catalog.fold_commands(commands).orderBy("id").collect()]


def test_versioning(spark):
    assert _fold(spark, "Disabled", ["put", "put", "delete"]) == [(0, "Deleted", False), (1, "Deleted", False)]
    assert _fold(spark, "Enabled", ["put", "put", "delete"]) == [(0, "Normal", True), (1, "Normal", True), (2, "Deleted", True)]
    assert _fold(spark, "Suspended", ["put", "put"]) == [(0, "Deleted", False), (1, "Normal", False)]


def test_list_hides_what_get_finds(spark):
    rows = [(1, 0, "k", 10, "Normal", True, 5, "v1", None), (2, 0, "k", 20, "Deleted", False, 5, "v2", 30)]
    v = spark.createDataFrame(rows, "id long, bucket_id long, name string, last_modified long, status string, sticky boolean, size long, version string, deleted_at long")
    b = spark.createDataFrame([(0, "b", "Normal", "Enabled", 0)], "id long, name string, status string, versioning string, last_modified long")
    assert catalog.list_objects(v).count() == 0
    assert catalog.get_object(v, b).first()["id"] == 1


def test_listing_edges(spark):
    names = spark.createDataFrame([("a/b/c",), ("a/d",), ("e",), ("a%b",)], "name string")
    got = sorted((r["entry"], r["n"]) for r in listing.collapse(names, "a/").collect())
    assert got == [("a/b/", 1), ("a/d", 1)]
    assert listing.collapse(names.limit(0)).count() == 0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "address_id long, idx long, ptr long, size long, storage_id long")
    assert A.by_storage(empty).count() == 0 and A.split_chunks(empty, 10).count() == 0 and refcount.stripe_counts(empty).count() == 0
    versions = spark.createDataFrame([], "id long, bucket_id long, name string, last_modified long, status string, sticky boolean, size long, version string, deleted_at long")
    assert usage.compute_usage(versions, 0, 10).first()["usage"] == 0
    assert catalog.data_size(versions).first()["size"] == 0


def test_bodies(spark):
    rows = spark.createDataFrame([(b"3\r\nabc\r\n0\r\n\r\n",), (b"3\r\nab",), (None,), (b"zz\r\n",)], "c binary")
    assert [r[0] for r in rows.select(bodies.decode_chunked("c")).collect()] == [b"abc", None, None, None]


@pytest.mark.parametrize(("tail", "whole"), [(b"\r\n", True), (b"x: 1\r\n\r\n", True), (b"x: 1\r\ny: 2\r\n\r\n", True), (b"", False), (b"\r", False), (b"x", False), (b"x: 1\r\n", False), (b"x: 1\r\n\r", False)])
def test_bodies_cut_after_the_last_chunk(spark, tail, whole):
    rows = spark.createDataFrame([(b"3\r\nabc\r\n0\r\n" + tail,)], "c binary")
    assert rows.select(bodies.decode_chunked("c")).first()[0] == (b"abc" if whole else None)


def test_short_bodies(spark, tmp_path):
    """Texts of a few bytes, which are cut in the trailer, and of one byte, which can't be halved."""
    from tessera.plans import registry

    texts = [None, "", "a", "ab", "abc", "abcd", "é", "0", "\r", "0\r\n\r\n"]
    rows = [(10 * i + k, t, "en", "s") for i, t in enumerate(texts) for k in (3, 4)] + [(None, "abc", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["id"]: r["digest"] for r in registry.QUERIES["src02_chunked"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(t.encode()).hexdigest() if i is not None and i % 10 != 3 else None for i, t, *_ in rows if t}


def test_snapshot(spark):
    e = spark.createDataFrame([("a", "1", 1, "put"), ("a", None, 2, "delete"), ("b", "2", 3, "put")], "key string, value string, revision long, op string")
    assert [r["key"] for r in watch.snapshot(e).collect()] == ["b"]
    assert sorted(r["key"] for r in watch.snapshot(e, revision=1).collect()) == ["a"]


def test_listing_pushes_its_prefix(spark, sf_dir):
    from tessera.plans import views

    plan = views.table(spark, sf_dir, "part").where(policy.glob(F.col("p_name"), "blue*"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,blue)" in plan


def test_scrypt(spark):
    # Fixed value: the first 32 bytes of RFC 7914's example for N 16384, r 8, p 1.
    want = "7023bdcb3afd7348461c06cd81fd38ebfda8fbba904f8e3ea9b543f6545da1f2"
    assert one(spark, S.scrypt_hash(F.lit("pleaseletmein"), F.lit(b"SodiumChloride".hex()))) == (want,)


@pytest.mark.parametrize(("password", "salt"), [(b"", b""), (b"", b"salt"), (b"a\0b", b"\0\xff"), ("é".encode() * 99, bytes(16))])
def test_scrypt_by_either_library(password, salt):
    assert S.scrypt(password, salt) == S.scrypt(password, salt, fast=False)


def test_scrypt_is_dealt_out(spark, tmp_path):
    """One file of users becomes several tasks; users of one name have one hash, which is made once; a null name has none."""
    from tessera.plans import registry

    rows = [(i, f"u{i % 150}" if i else None, 0) for i in range(301)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = registry.QUERIES["sc14_scrypt"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(3)" in plan and "Broadcast" not in plan
    found = {r["id"]: r["hash"] for r in df.collect()}
    assert len(found) == 301 and found[0] is None
    assert all(found[i] == found[i + 150] for i in range(1, 151)) and len(set(found.values())) == 151
    assert found[7] == hashlib.scrypt(b"u7", salt=hashlib.md5(b"u7").digest(), n=16384, r=8, p=1, dklen=32).hex()


def test_scrypt_of_many_names_has_few_tasks(spark, tmp_path):
    """Tasks of 64 names each would cost more than they share out: beyond 64 tasks a core, they get longer."""
    from tessera.plans import registry

    tasks = 64 * spark.sparkContext.defaultParallelism
    spark.range(tasks * 128).selectExpr("id as c_custkey", "concat('u', id) as c_name", "0L as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    plan = registry.QUERIES["sc14_scrypt"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({tasks + 1})" in plan
