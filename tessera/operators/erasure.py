"""Erasure coding of stripes and the state of storage groups (EC-*).

Parity is Reed-Solomon over GF(2^8) with a Cauchy matrix, so any ``data`` of the
``data + parity`` shards give the stripe back.  Coding runs on Arrow batches in
numpy; grouping shards by stripe is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the field's polynomial, x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for k in range(255):
        power[k] = power[k + 255] = x
        log[x] = k
        x <<= 1
        x ^= POLYNOMIAL if x & 256 else 0
    return power, log


_POWER, _LOG = _tables()


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, element by element."""
    a, b = np.broadcast_arrays(a, b)
    return np.where((a == 0) | (b == 0), 0, _POWER[_LOG[a] + _LOG[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    return int(_POWER[255 - _LOG[a]])


def combine(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """matrix (r, k) times shards (k, n)."""
    out = np.zeros((matrix.shape[0], shards.shape[1]), np.uint8)
    for k in range(matrix.shape[1]):
        out ^= multiply(matrix[:, k : k + 1], shards[k : k + 1])
    return out


def generator(data: int, parity: int) -> np.ndarray:
    """The matrix (data + parity, data): shards as they are, then Cauchy rows 1 / (x_i + y_j)."""
    rows = [[inverse((data + i) ^ j) for j in range(data)] for i in range(parity)]
    return np.concatenate([np.eye(data, dtype=np.uint8), np.array(rows, np.uint8).reshape(parity, data)])


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan in the field."""
    n = len(matrix)
    work = np.concatenate([matrix.copy(), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(work[c:, c])[0])
        work[[c, p]] = work[[p, c]]
        work[c] = multiply(work[c], np.uint8(inverse(int(work[c, c]))))
        for r in range(n):
            if r != c and work[r, c]:
                work[r] ^= multiply(work[c], work[r, c])
    return work[:, n:]


SHARDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("stripe_id", T.LongType()), T.StructField("shard_id", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def encode(objects: DataFrame, data: int, parity: int, chunk: int, id: str = "id", content: str = "text") -> DataFrame:
    """EC-1, 2: each object as stripes of data * chunk bytes, the last padded with zeros; a row for each shard."""
    source = objects.select(F.col(id).cast("long").alias("id"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = generator(data, parity)[data:]
        for pdf in batches:
            rows = []
            for i, raw in pdf.itertuples(index=False):
                raw = raw or b""
                for s in range(0, -(-len(raw) // (data * chunk))):
                    part = raw[s * data * chunk : (s + 1) * data * chunk].ljust(data * chunk, b"\0")
                    shards = np.frombuffer(part, np.uint8).reshape(data, chunk)
                    both = np.concatenate([shards, combine(g, shards)])
                    rows += [(i, s, k, both[k].tobytes()) for k in range(data + parity)]
            yield pd.DataFrame(rows, columns=SHARDS.names)

    return source.mapInPandas(run, SHARDS)


RECOVERED = T.StructType([T.StructField("id", T.LongType()), T.StructField("stripe_id", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("valid", T.IntegerType())])


def recover(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """EC-3, 4, 5: each stripe's bytes from the shards that are left; null where they are fewer than ``data``.

    A stripe has data + parity shards at most, so its rows fit one group.
    """
    listed = shards.groupBy("id", "stripe_id").agg(F.array_sort(F.collect_list(F.struct("shard_id", "payload"))).alias("shards"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, known = generator(data, parity), {}
        for pdf in batches:
            rows = []
            for i, s, listed in pdf.itertuples(index=False):
                have = tuple(x["shard_id"] for x in listed)
                if len(have) < data:
                    rows.append((i, s, None, len(have)))
                    continue
                use = have[:data]
                body = np.stack([np.frombuffer(x["payload"], np.uint8) for x in listed[:data]])
                if use != tuple(range(data)):
                    if use not in known:
                        known[use] = invert(g[list(use)])
                    body = combine(known[use], body)
                rows.append((i, s, body.tobytes(), len(have)))
            yield pd.DataFrame(rows, columns=RECOVERED.names)

    return listed.mapInPandas(run, RECOVERED)


def xor_parity(words: DataFrame) -> DataFrame:
    """One parity shard as the exclusive or of the others, word by word, for checks in SQL."""
    return words.groupBy("stripe_id", "word").agg(F.bit_xor("value").alias("parity"))


def repair(shards: DataFrame, lost: list[int], data: int, parity: int, chunk: int) -> DataFrame:
    """EC-6: the lost shards of every stripe anew, from those that are left; stripes with too few give none."""
    whole = recover(shards, data, parity).where("data IS NOT NULL").select("id", "stripe_id", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = generator(data, parity)
        for pdf in batches:
            rows = []
            for i, s, raw in pdf.itertuples(index=False):
                body = combine(g[lost], np.frombuffer(raw, np.uint8).reshape(data, chunk))
                rows += [(i, s, k, body[n].tobytes()) for n, k in enumerate(lost)]
            yield pd.DataFrame(rows, columns=SHARDS.names)

    return whole.mapInPandas(run, SHARDS)


def repair_counts(counts: DataFrame) -> DataFrame:
    """EC-6: a rebuilt storage takes each stripe's largest reference count among the survivors."""
    return counts.groupBy("stripe_id").agg(F.max("refs").alias("refs"))


def group_state(states: DataFrame, storages: int, data: int) -> DataFrame:
    """EC-7: each group's state from its storages' (ASSIGNED, NEW, DOWN); null until all were assigned once (``seen_all``)."""
    n = states.groupBy("group_id").agg(F.count(F.when(F.col("state") == "ASSIGNED", 1)).alias("assigned"), F.count(F.when(F.col("state") == "DOWN", 1)).alias("down"), F.bool_or("seen_all").alias("seen_all"))
    state = F.when(~F.col("seen_all"), None).when(F.col("assigned") == storages, "HEALTHY").when(F.col("assigned") < data, "FAILED").when(F.col("down") > 0, "DEGRADED").otherwise("REPAIRING")
    return n.select("group_id", "assigned", "down", state.alias("state"))


def leader_offset(reports: DataFrame) -> DataFrame:
    """EC-8: the largest offset reported; absent ones do not count."""
    return reports.groupBy("group_id").agg(F.max("offset").alias("offset"))


def validate_config(configs: DataFrame) -> DataFrame:
    """EC-10: data + parity must be the storages, and the stripe a multiple of data."""
    ok = (F.col("data") + F.col("parity") == F.col("storages")) & (F.col("data") > 0) & (F.col("stripe_kib") % F.nullif(F.col("data"), F.lit(0)) == 0)
    return configs.withColumn("valid", F.coalesce(ok, F.lit(False)))


def used_space(shards: DataFrame, data: int) -> DataFrame:
    """EC-11: bytes of data shards only."""
    return shards.where(F.col("shard_id") < data).groupBy("id").agg(F.sum(F.octet_length("payload")).cast("long").alias("used"))
