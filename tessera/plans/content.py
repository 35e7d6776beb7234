"""Queries of addresses, reference counts and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import address as A
from ..operators import dedup as D
from ..operators import refcount as R
from . import views as V
from .registry import query

_CHUNKS = """chunks AS (SELECT id, bucket, i AS idx, encode(text)[i * 8192 + 1 : (i + 1) * 8192] AS chunk
    FROM (SELECT *, unnest(range(0, (size + 8191) // 8192)) AS i FROM v_objects)),
c AS (SELECT id, bucket, idx, md5(chunk) AS digest, octet_length(chunk)::BIGINT AS size FROM chunks)"""


def _pieces(spark, d):
    return D.chunks(V.objects(spark, d), keep=["bucket"])


@query("dd20_raw_vs_effective", V.with_(V.V_OBJECTS, _CHUNKS) + "SELECT sum(size)::BIGINT AS raw_size, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT digest, size FROM c)) AS effective_size, count(*) AS n_chunks, count(DISTINCT digest) AS n_distinct FROM c")
def _(spark, d):
    return D.effective_size(_pieces(spark, d))


@query(
    "dd07_effective_by_source",
    V.with_(V.V_OBJECTS, _CHUNKS)
    + """SELECT bucket, sum(n * size)::BIGINT AS raw_size, sum(size)::BIGINT AS effective_size, sum(n)::BIGINT AS n_chunks, count(*) AS n_distinct
    FROM (SELECT bucket, digest, size, count(*) AS n FROM c GROUP BY ALL) GROUP BY bucket""",
)
def _(spark, d):
    """Raw and effective size of each source."""
    return D.effective_size(_pieces(spark, d), ["bucket"])


@query("dd08_address_roundtrip_md5", V.with_(V.V_OBJECTS) + "SELECT id, etag AS digest, size FROM v_objects WHERE size > 0")
def _(spark, d):
    """Objects put together again from their chunks have the digests of their texts."""
    whole = D.reassemble(_pieces(spark, d))
    return whole.select("id", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("size"))


@query("dd10_unstored_offsets", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, sum(size) OVER (PARTITION BY address_id ORDER BY idx)::BIGINT - size AS \"offset\" FROM v_fragments WHERE ptr % 3 = 0")
def _(spark, d):
    f = V.fragments(spark, d).withColumn("kind", F.expr("if(ptr % 3 = 0, 'UNSTORED', 'STORED')"))
    return D.unstored_offsets(f).select("address_id", "idx", "offset")


@query("dd09_stored_only", V.with_(V.V_FRAGMENTS) + "SELECT address_id, count(*) AS n, sum(size)::BIGINT AS size FROM v_fragments WHERE ptr % 3 <> 0 GROUP BY ALL")
def _(spark, d):
    return V.fragments(spark, d).where("ptr % 3 <> 0").groupBy("address_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(
    "dd11_reslice",
    V.with_(V.V_FRAGMENTS)
    + """, n AS (SELECT address_id, idx, size, sum(size) OVER (PARTITION BY address_id ORDER BY idx)::BIGINT - size AS off FROM v_fragments),
    t AS (SELECT address_id, sum(size)::BIGINT AS total FROM v_fragments GROUP BY ALL),
    a AS (SELECT address_id, i * 10000 AS a_off, least(10000, total - i * 10000) AS a_size, address_id * 1000000 + i * 20000 AS a_ptr FROM (SELECT *, unnest(range(0, (total + 9999) // 10000)) AS i FROM t))
    SELECT address_id, idx, a_ptr + greatest(off, a_off) - a_off AS ptr, least(off + size, a_off + a_size) - greatest(off, a_off) AS size FROM n JOIN a USING (address_id) WHERE off < a_off + a_size AND a_off < off + size""",
)
def _(spark, d):
    f = V.fragments(spark, d)
    new = A.with_offsets(f).select("address_id", "idx", "offset", "size")
    total = f.groupBy("address_id").agg(F.sum("size").alias("total"))
    given = total.withColumn("i", F.explode(F.expr("sequence(0L, (total - 1) div 10000)"))).selectExpr("address_id", "i * 10000 as a_offset", "least(10000, total - i * 10000) as a_size", "address_id * 1000000 + i * 20000 as a_ptr")
    return D.reslice(new, given)


@query("dd12_first_writer", V.with_(V.V_OBJECTS, _CHUNKS) + "SELECT digest, size, min(id * 100000 + idx) AS first FROM c GROUP BY ALL")
def _(spark, d):
    return _pieces(spark, d).groupBy(F.md5("chunk").alias("digest"), "size").agg(F.min(F.expr("id * 100000 + idx")).alias("first"))


@query("dd14_fully_deduplicated", V.with_(V.V_OBJECTS, _CHUNKS) + "SELECT id FROM (SELECT id, idx, min(id) OVER (PARTITION BY digest, size) AS first FROM c) GROUP BY id HAVING bool_and(first < id)")
def _(spark, d):
    """Objects all of whose chunks an earlier object has: nothing is flushed for them."""
    p = _pieces(spark, d).select("id", F.md5("chunk").alias("digest"), "size")
    first = p.groupBy("digest", "size").agg(F.min("id").alias("first"))
    return p.join(first, ["digest", "size"]).groupBy("id").agg(F.bool_and(F.col("first") < F.col("id")).alias("all")).where("all").select("id")


@query("dd15_headers", V.with_(V.V_OBJECTS, _CHUNKS) + "SELECT idx = 0 AS is_header, count(*) AS n, count(DISTINCT digest) AS n_distinct FROM c GROUP BY ALL")
def _(spark, d):
    return _pieces(spark, d).groupBy((F.col("idx") == 0).alias("is_header")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("chunk")).alias("n_distinct"))


_BODIES = "SELECT DISTINCT text AS body FROM v_objects"


def _bodies(spark, d):
    return V.objects(spark, d).select(F.col("text").alias("body")).distinct()


@query("dd01_neighbours", V.with_(V.V_OBJECTS) + f"SELECT md5(body) AS body, md5(lag(body) OVER (ORDER BY body)) AS low, md5(lead(body) OVER (ORDER BY body)) AS high FROM ({_BODIES})")
def _(spark, d):
    return D.neighbours(_bodies(spark, d)).select(*(F.md5(c).alias(c) for c in ("body", "low", "high")))


@query("dd02_order", V.with_(V.V_OBJECTS) + f"SELECT md5(body) AS body, row_number() OVER (PARTITION BY encode(body)[1:16] ORDER BY body)::BIGINT AS rank FROM ({_BODIES})")
def _(spark, d):
    """Bodies that agree in their first 16 bytes, in order of the rest."""
    return D.prefix_order(_bodies(spark, d)).select(F.md5("body").alias("body"), (F.col("rank") + 1).alias("rank"))


@query(
    "dd03_lcp",
    V.with_(V.V_OBJECTS)
    + f"""SELECT md5(body) AS body, coalesce(list_position(list_transform(list_zip(string_split(hex(encode(body)), ''), string_split(hex(encode(low)), '')), lambda x: x[1] IS DISTINCT FROM x[2]), TRUE) - 1, octet_length(encode(body)) * 2) // 2 AS shared
    FROM (SELECT body, lag(body, 1, '') OVER (ORDER BY body) AS low FROM ({_BODIES}))""",
)
def _(spark, d):
    """Leading bytes that each body shares with the one below."""
    raw = lambda c: F.coalesce(c, F.lit("")).cast("binary")
    found = D.neighbours(_bodies(spark, d)).withColumn("shared", D.common_prefix(raw(F.col("body")), raw(F.col("low"))).cast("long"))
    return found.select(F.md5("body").alias("body"), "shared")


def _twice(objects):
    """Every object and, as the next call of a node of its own, its copy."""
    return objects.select(F.expr("id * 2").alias("id"), "text").unionByName(objects.select(F.expr("id * 2 + 1").alias("id"), "text"))


@query(
    "dd05_greedy_copies",
    V.with_(V.V_OBJECTS)
    + """, t AS (SELECT id, size, (size + 8191) // 8192 AS n, (size - 1) % 8192 + 1 AS tail FROM v_objects WHERE size > 0)
    SELECT id, 0 AS copy, size AS raw, size AS effective, n, 0 AS n_stored, TRUE AS contiguous FROM t
    UNION ALL SELECT id, 1, size, CASE WHEN tail <= 32 THEN tail ELSE 0 END, n, n - CASE WHEN tail <= 32 THEN 1 ELSE 0 END, TRUE FROM t""",
)
def _(spark, d):
    """An object is all new data the first time; its copy is references only, but for an end of 32 bytes or fewer."""
    from pyspark.sql import Window

    f = D.greedy_dedup(_twice(V.objects(spark, d)), F.expr("id div 2"))
    w = Window.partitionBy("id").orderBy("offset")
    f = f.withColumn("next", F.coalesce(F.lag(F.expr("offset + size")).over(w), F.lit(0)))
    found = f.groupBy("id").agg(
        F.sum("size").alias("raw"), F.sum(F.expr("if(stored, 0, size)")).alias("effective"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("stored"), 1)).alias("n_stored"), F.bool_and(F.expr("offset = next")).alias("contiguous")
    )
    return found.select(F.expr("id div 2").alias("id"), F.expr("int(id % 2)").alias("copy"), "raw", "effective", "n", "n_stored", "contiguous")


@query("dd06_own_call_unseen", V.with_(V.V_OBJECTS) + "SELECT id, size * 2 AS raw, size * 2 AS effective FROM v_objects WHERE size > 0")
def _(spark, d):
    """An object that holds its text twice finds nothing: a call does not see what it adds itself."""
    f = D.greedy_dedup(V.objects(spark, d).select("id", F.expr("concat(text, text)").alias("text")), F.col("id"))
    return f.groupBy("id").agg(F.sum("size").alias("raw"), F.sum(F.expr("if(stored, 0, size)")).alias("effective"))


@query("dd18_calls_in_turn", V.with_(V.V_OBJECTS) + "SELECT id, i::BIGINT AS call, (row_number() OVER (ORDER BY id, i) - 1) % 8 AS shard FROM (SELECT id, unnest(range(0, (size + 999) // 1000)) AS i FROM v_objects)")
def _(spark, d):
    """Which of eight nodes takes each call, when objects are cut every 1000 bytes."""
    return D.calls_in_turn(V.objects(spark, d), 8, call_bytes=1000)


@query("dd18_sharded")
def _(spark, d):
    """Raw and effective bytes and fragments of each of eight nodes, which take the calls in turn."""
    return D.greedy_dedup(V.objects(spark, d)).groupBy("shard").agg(F.sum("size").alias("raw"), F.sum(F.expr("if(stored, 0, size)")).alias("effective"), F.count(F.lit(1)).alias("n"))


_REPAIR = "kind AS (SELECT *, CASE WHEN ptr % 3 = 0 THEN 'UNSTORED' ELSE 'STORED' END AS kind FROM v_fragments)"


@query("dd16_rejected_repair", V.with_(V.V_FRAGMENTS, _REPAIR) + "SELECT address_id, sum(size)::BIGINT AS raw, sum(CASE WHEN k = 'UNSTORED' THEN size ELSE 0 END)::BIGINT AS effective, count(*) FILTER (k = 'UNSTORED') AS n_new, count(*) FILTER (k <> 'UNSTORED') AS n_stored FROM (SELECT *, CASE WHEN storage_id = 1 AND ptr % 5 = 0 THEN 'UNSTORED' ELSE kind END AS k FROM kind) GROUP BY address_id")
def _(spark, d):
    f = V.fragments(spark, d).withColumn("kind", F.expr("if(ptr % 3 = 0, 'UNSTORED', 'STORED')"))
    return D.totals(D.repair_rejected(f, f.where("storage_id = 1 and ptr % 5 = 0")), ["address_id"])


@query("dd17_noop", V.with_(V.V_OBJECTS) + "SELECT id, 0::BIGINT AS idx, size, size AS effective_size FROM v_objects")
def _(spark, d):
    return D.noop(V.objects(spark, d))


@query("ad01_data_size", V.with_(V.V_FRAGMENTS) + "SELECT address_id, sum(size)::BIGINT AS size, count(*) AS n FROM v_fragments GROUP BY ALL")
def _(spark, d):
    return A.data_size(V.fragments(spark, d))


@query("ad03_append", V.with_(V.V_FRAGMENTS) + "SELECT address_id, row_number() OVER (PARTITION BY address_id ORDER BY storage_id = 2, idx) - 1 AS idx, ptr, size FROM v_fragments")
def _(spark, d):
    """The fragments on storage 2 moved behind the others."""
    f = V.fragments(spark, d)
    from pyspark.sql import Window

    w = Window.partitionBy("address_id").orderBy("idx")
    left, right = (f.where(c).withColumn("idx", (F.row_number().over(w) - 1).cast("long")).drop("storage_id") for c in ("storage_id <> 2", "storage_id = 2"))
    return A.append(left, right).select("address_id", "idx", "ptr", "size")


@query("ad04_subfrag", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, CASE WHEN 700 < least(9000, size) THEN ptr + 700 END AS ptr, CASE WHEN 700 < least(9000, size) THEN least(9000, size) - 700 END AS size FROM v_fragments")
def _(spark, d):
    f = V.fragments(spark, d)
    ptr, size = A.sub_fragment(F.col("ptr"), F.col("size"), F.lit(700), F.lit(9000))
    return f.select("address_id", "idx", ptr.alias("ptr"), size.alias("size"))


_RANGE = V.with_(V.V_FRAGMENTS) + ", o AS (SELECT *, sum(size) OVER (PARTITION BY address_id ORDER BY idx)::BIGINT - size AS off FROM v_fragments) "


@query("ad05_range", _RANGE + "SELECT address_id, idx, ptr + greatest(1000, off) - off AS ptr, least(20000, off + size) - greatest(1000, off) AS size FROM o WHERE greatest(1000, off) < least(20000, off + size)")
def _(spark, d):
    return A.byte_range(V.fragments(spark, d), F.lit(1000), F.lit(20000))


@query("ad15_ranges", _RANGE + "SELECT address_id, s, count(*) AS n, sum(least(s + 5000, off + size) - greatest(s, off))::BIGINT AS size FROM o, (VALUES (0), (7000), (40000)) r(s) WHERE greatest(s, off) < least(s + 5000, off + size) GROUP BY ALL")
def _(spark, d):
    """Several ranges of every address: bytes and fragments of each."""
    f = V.fragments(spark, d)
    each = [A.byte_range(f, F.lit(s), F.lit(s + 5000)).groupBy("address_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).withColumn("s", F.lit(s)) for s in (0, 7000, 40000)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("ad06_split_chunks", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, chunk, greatest(ptr, chunk * 8192) AS ptr, least(ptr + size, (chunk + 1) * 8192) - greatest(ptr, chunk * 8192) AS size FROM (SELECT *, unnest(range(ptr // 8192, (ptr + size - 1) // 8192 + 1)) AS chunk FROM v_fragments WHERE size > 0)")
def _(spark, d):
    return A.split_chunks(V.fragments(spark, d), 8192)


@query("ad07_rr_pack", V.with_(V.V_FRAGMENTS) + "SELECT DISTINCT address_id % 7 AS g, storage_id, ptr, lower(lpad(to_hex(address_id % 7), 8, '0') || lpad(to_hex(storage_id), 8, '0') || lpad(to_hex(ptr), 16, '0')) AS pointer FROM v_fragments")
def _(spark, d):
    """Packed, and unpacked again."""
    f = V.fragments(spark, d).selectExpr("address_id % 7 as g0", "storage_id as s0", "ptr as p0").distinct().withColumn("pointer", A.pack_pointer("g0", "s0", "p0"))
    g, s, p = A.unpack_pointer("pointer")
    return f.select(g.alias("g"), s.alias("storage_id"), p.alias("ptr"), "pointer")


_EC = V.with_(V.V_FRAGMENTS) + ", e AS (SELECT address_id, idx, (ptr % 20480) // 10240 AS storage, (ptr // 20480) * 10240 + ptr % 10240 AS place FROM v_fragments) "


@query("ad08_ec_translate", _EC + "SELECT * FROM e")
def _(spark, d):
    storage, place = A.group_to_storage("ptr", 10240, 2)
    return V.fragments(spark, d).select("address_id", "idx", storage.alias("storage"), place.alias("place"))


@query("ad08_ec_inverse", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, ptr FROM v_fragments")
def _(spark, d):
    storage, place = A.group_to_storage("ptr", 10240, 2)
    return V.fragments(spark, d).select("address_id", "idx", storage.alias("s"), place.alias("p")).select("address_id", "idx", A.storage_to_group("s", "p", 10240, 2).alias("ptr"))


@query("ad10_by_storage", _RANGE + "SELECT address_id, storage_id, count(*) AS n, sum(size)::BIGINT AS size, min(off) AS first_offset FROM o GROUP BY ALL")
def _(spark, d):
    return A.by_storage(V.fragments(spark, d))


@query("ad10_straddling", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx FROM v_fragments WHERE size > 0 AND ptr // 1000000 <> (ptr + size - 1) // 1000000")
def _(spark, d):
    return A.straddling(V.fragments(spark, d), 1000000).select("address_id", "idx")


@query("ad11_offsets", _RANGE + "SELECT address_id, off AS \"offset\", coalesce(lead(off) OVER (PARTITION BY address_id ORDER BY off), sum(size) OVER (PARTITION BY address_id)::BIGINT) - off AS size FROM o")
def _(spark, d):
    f = A.with_offsets(V.fragments(spark, d))
    total = f.groupBy("address_id").agg(F.sum("size").alias("total"))
    return A.offsets_to_fragments(f.select("address_id", "offset").join(total, "address_id")).select("address_id", "offset", "size")


@query("ad13_text", V.with_(V.V_FRAGMENTS) + "SELECT address_id, idx, '[group ' || address_id % 7 || ', pointer ' || lpad(lower(to_hex(ptr)), 16, '0') || ', size ' || lower(to_hex(size)) || ']' AS shown FROM v_fragments")
def _(spark, d):
    return V.fragments(spark, d).select("address_id", "idx", A.as_text(F.expr("address_id % 7"), F.col("ptr"), F.col("size")).alias("shown"))


_HEADERS = "CASE p_partkey % 5 WHEN 0 THEN concat('bytes=', p_size, '-', p_size + 100) WHEN 1 THEN concat('bytes=', p_size, '-') WHEN 2 THEN concat('bytes=-', p_size) WHEN 3 THEN 'bytes=-' ELSE concat('bytes=-', p_size * 100) END"


@query(
    "ad14_range_header",
    f"""SELECT header, CASE WHEN a <> '' THEN a::BIGINT WHEN b <> '' THEN greatest(1000 - b::BIGINT, 0) END AS "start", CASE WHEN a <> '' AND b <> '' THEN least(b::BIGINT + 1, 1000) WHEN a <> '' OR b <> '' THEN 1000 END AS "end"
    FROM (SELECT DISTINCT header, regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 1) AS a, regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 2) AS b FROM (SELECT {_HEADERS} AS header FROM part))""",
)
def _(spark, d):
    h = V.table(spark, d, "part").selectExpr(f"{_HEADERS} as header").distinct()
    start, end = A.parse_range(F.col("header"), F.lit(1000).cast("long"))
    return h.select("header", start.alias("start"), end.alias("end"))


_SEQ = "SELECT storage_id, size, row_number() OVER (PARTITION BY storage_id ORDER BY address_id, idx) AS seq FROM v_fragments"


@query("snk3_allocate", V.with_(V.V_FRAGMENTS) + f"SELECT storage_id, seq, size, (sum((size + 8191) // 8192 * 8192) OVER (PARTITION BY storage_id ORDER BY seq))::BIGINT - (size + 8191) // 8192 * 8192 AS \"offset\" FROM ({_SEQ})")
def _(spark, d):
    return A.allocate(_writes(spark, d)).select("storage_id", "seq", "size", "offset")


def _writes(spark, d):
    return V.fragments(spark, d).selectExpr("storage_id", "size", "cast(row_number() over (partition by storage_id order by address_id, idx) as bigint) as seq")


@query("snk1_files", V.with_(V.V_FRAGMENTS) + f""", a AS (SELECT storage_id, seq, size, (sum((size + 8191) // 8192 * 8192) OVER (PARTITION BY storage_id ORDER BY seq))::BIGINT - (size + 8191) // 8192 * 8192 AS off FROM ({_SEQ}))
    SELECT storage_id, file_no, count(*) AS n, sum(least(off + size, (file_no + 1) * 16777216) - greatest(off, file_no * 16777216))::BIGINT AS bytes
    FROM (SELECT *, unnest(range(off // 16777216, (off + size - 1) // 16777216 + 1)) AS file_no FROM a WHERE size > 0) GROUP BY ALL""")
def _(spark, d):
    """An append log over files of 16 MiB: what each file holds."""
    return A.files_of(A.allocate(_writes(spark, d)), 1 << 24).groupBy("storage_id", "file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


# Half of all fragments are stored, by regions of 64 KiB; the other half is asked for.
_FAN = "fan AS (SELECT address_id, idx, storage_id, ptr // 65536 % 2 AS side, unnest(range(ptr // 8192, (ptr + size - 1) // 8192 + 1)) AS stripe_id FROM v_fragments WHERE size > 0)"
_COUNTS = "cnt AS (SELECT storage_id, stripe_id, count(*) AS refs FROM fan WHERE side = 0 GROUP BY ALL), odd AS (SELECT storage_id, stripe_id, count(*) AS refs FROM fan WHERE side = 1 GROUP BY ALL)"


@query("rc01_stripe_counts", V.with_(V.V_FRAGMENTS, _FAN) + "SELECT storage_id, stripe_id, count(*) AS refs FROM fan GROUP BY ALL")
def _(spark, d):
    return R.stripe_counts(V.fragments(spark, d))


def _counts(spark, d):
    return R.stripe_counts(_side(spark, d, 0)), R.stripe_counts(_side(spark, d, 1))


def _side(spark, d, side):
    return V.fragments(spark, d).where(f"ptr div 65536 % 2 = {side}")


@query("rc02_link_rejects", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS) + "SELECT * FROM odd WHERE (storage_id, stripe_id) NOT IN (SELECT storage_id, stripe_id FROM cnt)")
def _(spark, d):
    return R.link(*_counts(spark, d))[1]


@query("rc07_link", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS) + "SELECT storage_id, stripe_id, cnt.refs + coalesce(odd.refs, 0) AS refs FROM cnt LEFT JOIN odd USING (storage_id, stripe_id)")
def _(spark, d):
    return R.link(*_counts(spark, d))[0]


_LEFT = "le AS (SELECT storage_id, stripe_id, cnt.refs - coalesce(odd.refs, 0) AS refs FROM cnt LEFT JOIN odd USING (storage_id, stripe_id))"


@query("rc03_decrement", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _LEFT) + "SELECT 'left' AS what, storage_id, stripe_id, refs FROM le WHERE refs > 0 UNION ALL SELECT 'error', * FROM odd WHERE (storage_id, stripe_id) NOT IN (SELECT storage_id, stripe_id FROM cnt)")
def _(spark, d):
    left, _, errors = R.unlink(*_counts(spark, d))
    return left.withColumn("what", F.lit("left")).unionByName(errors.withColumn("what", F.lit("error")))


_RUNS = "runs AS (SELECT storage_id, min(stripe_id) AS first_stripe, count(*) AS n FROM (SELECT *, stripe_id - row_number() OVER (PARTITION BY storage_id ORDER BY stripe_id) AS g FROM le WHERE refs <= 0) GROUP BY storage_id, g)"


@query("rc04_free_runs", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _LEFT, _RUNS) + "SELECT * FROM runs")
def _(spark, d):
    return R.runs(R.unlink(*_counts(spark, d))[1])


@query("rc05_freed_bytes", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _LEFT, _RUNS) + ", w AS (SELECT storage_id, max(ptr + size) - 1000 AS o FROM v_fragments GROUP BY ALL) SELECT storage_id, sum(greatest(0, least((first_stripe + n) * 8192, o) - first_stripe * 8192))::BIGINT AS freed FROM runs JOIN w USING (storage_id) GROUP BY ALL")
def _(spark, d):
    offsets = V.fragments(spark, d).groupBy("storage_id").agg((F.max(F.expr("ptr + size")) - 1000).alias("write_offset"))
    return R.freed_bytes(R.runs(R.unlink(*_counts(spark, d))[1]), offsets)


@query("rc08_ec_freed", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _LEFT, _RUNS) + ", w AS (SELECT storage_id, max(ptr + size) - 1000 AS o FROM v_fragments GROUP BY ALL) SELECT storage_id, sum(greatest(0, least((first_stripe + n) * 8192, o) - first_stripe * 8192))::BIGINT AS freed FROM runs JOIN w USING (storage_id) WHERE storage_id < 2 GROUP BY ALL")
def _(spark, d):
    """Two storages hold data and the third parity, which does not count."""
    offsets = V.fragments(spark, d).groupBy("storage_id").agg((F.max(F.expr("ptr + size")) - 1000).alias("write_offset"))
    return R.freed_bytes(R.runs(R.unlink(*_counts(spark, d))[1]), offsets, data=2)


_REFUSED = "ref AS (SELECT storage_id, stripe_id FROM odd WHERE (storage_id, stripe_id) NOT IN (SELECT storage_id, stripe_id FROM cnt))"


@query("rc06_rejected_frags", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _REFUSED) + "SELECT DISTINCT address_id, idx FROM fan JOIN ref USING (storage_id, stripe_id) WHERE side = 1")
def _(spark, d):
    return R.rejected_fragments(_side(spark, d, 1), R.link(*_counts(spark, d))[1]).select("address_id", "idx")


@query("rc12_rejected_quirk", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS, _REFUSED) + "SELECT DISTINCT address_id, idx FROM fan WHERE side = 1 AND stripe_id IN (SELECT stripe_id FROM ref)")
def _(spark, d):
    return R.rejected_fragments(_side(spark, d, 1), R.link(*_counts(spark, d))[1], compat="reference").select("address_id", "idx")


@query("rc09_get", V.with_(V.V_FRAGMENTS, _FAN, _COUNTS) + "SELECT storage_id, stripe_id, coalesce(cnt.refs, 0) AS refs FROM odd LEFT JOIN cnt USING (storage_id, stripe_id)")
def _(spark, d):
    counts, ids = _counts(spark, d)
    return R.get_counts(counts, ids.select("storage_id", "stripe_id"))


@query("rc10_used", V.with_(V.V_FRAGMENTS, _FAN) + "SELECT storage_id, count(*) * 8192 AS used, greatest(0, 100000000 - count(*) * 8192) AS available FROM (SELECT DISTINCT storage_id, stripe_id FROM fan) GROUP BY ALL")
def _(spark, d):
    used = F.count(F.lit(1)) * 8192
    return R.stripe_counts(V.fragments(spark, d)).groupBy("storage_id").agg(used.alias("used"), F.greatest(F.lit(0), F.lit(100000000) - used).alias("available"))


_LINES = "concat(case when l_orderkey % 3 = 0 then 'decrementing' when l_orderkey % 3 = 1 then 'incrementing' else 'reading' end, ' refcount at offset=', l_partkey * 4096, ', size=', cast(l_quantity as bigint))"


@query("rc11_audit", "SELECT l_partkey * 4096 AS \"offset\", l_quantity::BIGINT AS size, count(*) FILTER (l_orderkey % 3 = 1) AS increments, count(*) FILTER (l_orderkey % 3 = 0) AS decrements FROM lineitem WHERE l_orderkey % 3 < 2 GROUP BY ALL HAVING increments <> decrements")
def _(spark, d):
    return R.audit_log(V.table(spark, d, "lineitem").selectExpr(f"{_LINES} as value"))
