"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, media, mix, quality, shard, substrings, tokens, toxicity
from ._text import documents, held_out

SHARDS = 24
WINDOW_WORDS = 10


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by dictionary compression, learned where crc32(doc_id) mod 5 is not 0, over every text."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, keep=["doc_id", "held_out"], threshold=0.3)


def op2_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by a recurrent network, learned where crc32(doc_id) mod 5 is not 0, over every window of every text."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, keep=["doc_id", "held_out"], threshold=0.5)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class under five-word shingles and similarity 0.8, and its number of links."""
    return jaccard.jaccard_classes(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings that also start in an earlier document, cut from every text."""
    return substrings.repeated_spans(documents(spark, sf_dir, "doc_id", "text"), 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document, encoded whole."""
    return tokens.count_tokens(documents(spark, sf_dir, "doc_id", "text"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back: digests of both, difference hash and checksum of the tile."""
    found = media.text_media(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.PAYLOAD_UNIT, media.PAYLOAD_UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("-", "dhash", F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0")).alias("feature"),
        "media_format",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney language models, learned where crc32(doc_id) mod 4 is not 2, over every text."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language.learn(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of equal bytes by global prefix sums."""
    found = shard.assign_shards(documents(spark, sf_dir, "doc_id", "text"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any ten-word window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(documents(spark, sf_dir, "doc_id", "text"), items, WINDOW_WORDS, keep=["doc_id"])
    return found.drop("hit_spans")


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in a mix of sources by temperature, with its block and order."""
    return mix.mix(documents(spark, sf_dir, "doc_id", "source", "text"))[0].drop("text_crc32")


#: CRC-32 in SQL: the table of 256 remainders by its rule (the reversed polynomial 0xEDB88320), then one step a byte.
_CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i::BIGINT, [8, 7, 6, 5, 4, 3, 2, 1]::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i))"""

#: The bisection of mix.plan: whether the weights at exponent ``x`` reach the target entropy, and the repetition limit.
_ENTROPY_OK = """(SELECT CASE WHEN count(*) > 1 THEN -sum(r / z * ln(r / z)) / ln(count(*)) ELSE 1 END >= {target} FROM (SELECT pow(share, {x}) AS r, sum(pow(share, {x})) OVER () AS z FROM t))"""
_PASSES_OK = """(SELECT max(r / z / tokens) / min(r / z / tokens) <= {limit} FROM (SELECT tokens, pow(share, {x}) AS r, sum(pow(share, {x})) OVER () AS z FROM t))"""

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + {jaccard.SHINGLE_WORDS} - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {jaccard.SHINGLE_WORDS} + 1, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * {jaccard.THRESHOLD.denominator} >= (x.n + y.n - k) * {jaccard.THRESHOLD.numerator}),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, min(other) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id)::BIGINT AS n_links FROM r GROUP BY r.doc_id""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, p, raw[p + 1 : p + 50] AS k FROM (SELECT doc_id, raw, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING count(*) > 1),
c AS (SELECT g.doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after FROM g JOIN f ON f.k = g.k AND f.first < g.doc_id WINDOW w AS (PARTITION BY g.doc_id ORDER BY p)),
b AS (SELECT doc_id, p FROM c WHERE before IS NULL OR p - before > 50),
e AS (SELECT doc_id, p + 50 AS q FROM c WHERE after IS NULL OR after - p > 50),
t AS (SELECT x.doc_id, p, q, coalesce(lag(q) OVER (PARTITION BY x.doc_id ORDER BY p), 0) AS past
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM b) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q) AS i FROM e) y USING (doc_id, i)),
s AS (SELECT d.doc_id, sum(q - p)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * past + 1, 2 * (p - past)), '' ORDER BY p) || substr(any_value(h), 2 * max(q) + 1) AS kept FROM t JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op10_temperature_mix": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, (octet_length(encode(coalesce(text, ''))) + 3) // 4)::BIGINT AS n_tokens FROM documents),
t0 AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT source, tokens, tokens::DOUBLE / sum(tokens) OVER () AS share FROM t0),
e(i, lo, hi) AS (SELECT 0, CASE WHEN {_ENTROPY_OK.format(target=mix.TARGET_ENTROPY, x="1.0::DOUBLE")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE
    UNION ALL SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END
    FROM (SELECT *, {_ENTROPY_OK.format(target=mix.TARGET_ENTROPY, x="m")} AS ok FROM (SELECT *, (lo + hi) / 2 AS m FROM e WHERE i < {mix.STEPS} AND lo < hi))),
p(i, lo, hi) AS (SELECT 0, CASE WHEN {_PASSES_OK.format(limit=mix.MAX_EPOCHS, x="0.0::DOUBLE")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE
    UNION ALL SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END
    FROM (SELECT *, {_PASSES_OK.format(limit=mix.MAX_EPOCHS, x="(1 - m)")} AS ok FROM (SELECT *, (lo + hi) / 2 AS m FROM p WHERE i < {mix.STEPS} AND lo < hi))),
x AS (SELECT round(greatest((SELECT arg_max(lo, i) FROM e), 1 - (SELECT arg_max(lo, i) FROM p)), 6) AS x),
w AS (SELECT source, tokens, greatest(1, round_even(pow(share, x) / sum(pow(share, x)) OVER () * 1000000, 0)::BIGINT) AS w FROM t, x),
b AS (SELECT max((tokens * 1000000 + w - 1) // w) AS budget FROM w),
q AS (SELECT source, tokens, greatest(1, w * {mix.BLOCK_TOKENS} // 1000000) AS in_block, greatest(tokens, budget * w // 1000000) AS quota FROM w, b),
u AS (SELECT d.*, tokens, in_block, quota, unnest(range(0, quota // tokens + CASE WHEN quota % tokens > 0 THEN 1 ELSE 0 END)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, md5('0|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS key FROM u),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key ROWS UNBOUNDED PRECEDING)::BIGINT - n_tokens AS off FROM k)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, (epoch * tokens + off) // in_block AS block,
    md5('0:block|' || (epoch * tokens + off) // in_block || '|' || key) AS order_key
FROM o WHERE epoch < quota // tokens OR off < quota % tokens""",
    "op8_sharding": f"""
WITH table_of AS (SELECT {_CRC_TABLE} AS t),
b AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
sized AS (SELECT doc_id, n::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * n + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS text_crc32
    FROM b, table_of),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS off,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS r, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, least({SHARDS - 1}, ((2 * off + size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut""",
    "op9_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW_WORDS}) AS k, array_to_string(ws[p : p + least(len(ws), {WINDOW_WORDS}) - 1], ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW_WORDS} + 1, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g
    FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
m AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_compression,
        op2_toxicity_gru,
        op3_ngram_jaccard,
        op4_suffix_dedup,
        op5_token_counts,
        op6_media_columns,
        op7_language_id,
        op8_sharding,
        op9_decontamination,
        op10_temperature_mix,
    )
}
