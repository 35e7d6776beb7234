"""Deduplication by content: chunks, neighbours, greedy matching against a dictionary (DD-*)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import materialize
from .caches import Lfu
from .ranks import with_offsets

# Bytes by which the dictionary is ordered first, the length that a match must exceed, and that of a new fragment at most.
PREFIX, MIN_MATCH, MAX_FRAGMENT = 16, 32, 8192
#: Bytes of one call: what a call adds is not seen before the next.
CALL_BYTES = 64 << 20
#: Fragments that a dictionary holds, and as many headers; 256 MiB of either at most.
CAPACITY = 1 << 15


def chunks(objects: DataFrame, size: int = MAX_FRAGMENT, id: str = "id", content: str = "text", keep: list[str] | None = None) -> DataFrame:
    """DD-19: (id, idx, chunk, size): content cut every ``size`` bytes; empty content has no chunk."""
    raw = F.col(content).cast("binary")
    rows = objects.select(id, *(keep or []), raw.alias("__raw")).where(F.octet_length("__raw") > 0)
    rows = rows.withColumn("idx", F.explode(F.expr(f"sequence(0, (octet_length(__raw) - 1) div {size})")))
    chunk = F.substring(F.col("__raw"), F.col("idx") * size + 1, F.lit(size))
    return rows.select(id, *(keep or []), F.col("idx").cast("long").alias("idx"), chunk.alias("chunk")).withColumn("size", F.octet_length("chunk").cast("long"))


def effective_size(pieces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """DD-7, 20: raw and effective bytes, each distinct chunk once (in all, or within ``by``)."""
    by = by or []
    marked = pieces.select(*by, F.md5("chunk").alias("digest"), "size")
    # Repeated chunks fold before they are shuffled again.
    folded = marked.groupBy(*by, "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    return folded.groupBy(*by).agg(F.sum(F.col("size") * F.col("n")).alias("raw_size"), F.sum("size").alias("effective_size"), F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"))


def reassemble(pieces: DataFrame, id: str = "id") -> DataFrame:
    """DD-8, AD-16: each object's bytes from its chunks in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk"))), lambda x: F.hex(x["chunk"]))
    return pieces.groupBy(id).agg(F.unhex(F.array_join(ordered, "")).alias("content"))


def neighbours(bodies: DataFrame, body: str = "body", buckets: int | None = None) -> DataFrame:
    """DD-1, 2: each body's neighbours below and above in the order of their bytes.

    Bodies are dealt by ranges, so no task holds all of them; at the border of a range
    stand the last body of the nearest range below and the first of that above.
    """
    if buckets is not None:
        w = Window.partitionBy(F.substring(F.col(body), 1, buckets)).orderBy(body)
        return bodies.withColumn("low", F.lag(body).over(w)).withColumn("high", F.lead(body).over(w))
    n = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(bodies.repartitionByRange(n, body).withColumn("__part", F.spark_partition_id()), "dealt")
    w, borders = Window.partitionBy("__part").orderBy(body), Window.orderBy("__part")
    # One row for each partition that has bodies.
    ends = dealt.groupBy("__part").agg(F.min(body).alias("__first"), F.max(body).alias("__last"))
    ends = ends.select("__part", F.lag("__last").over(borders).alias("__below"), F.lead("__first").over(borders).alias("__above"))
    # A null is the lowest body and no neighbour's absence: the row's place tells where a range ends.
    inside = dealt.withColumn("low", F.lag(body).over(w)).withColumn("high", F.lead(body).over(w)).withColumn("__at", F.row_number().over(w)).withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy("__part")))
    low = F.when(F.col("__at") == 1, F.col("__below")).otherwise(F.col("low"))
    high = F.when(F.col("__at") == F.col("__of"), F.col("__above")).otherwise(F.col("high"))
    return inside.join(F.broadcast(ends), "__part").select(*bodies.columns, low.alias("low"), high.alias("high"))


def common_prefix(a: Column, b: Column) -> Column:
    """DD-3: how many leading bytes two binaries share (characters of two strings); null if one of them is."""
    most = F.least(F.length(a), F.length(b))

    def longer(n: Column, step: Column) -> Column:
        # What is shared so far grows by half as much each time, if that much more is alike.
        return F.when((n + step <= most) & (F.substring(a, n + F.lit(1), step) == F.substring(b, n + F.lit(1), step)), n + step).otherwise(n)

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), longer))


def prefix_order(bodies: DataFrame, body: str = "body") -> DataFrame:
    """DD-2: each body's place among those with its first 16 bytes, in order of all bytes; a prefix that many share is no heavier than others."""
    marked = bodies.withColumn("__prefix", F.substring(F.col(body).cast("binary"), 1, PREFIX))
    return with_offsets(marked, ["__prefix", body], by=["__prefix"], offset="__none").drop("__prefix", "__none")


class Dictionary:
    """Fragments in order of their first 16 bytes, then of as much of their bodies as the shorter one has.

    With a ``capacity``, the least used fragments are forgotten; those that begin a
    call (headers) have a capacity of their own (DD-13, 15).
    """

    def __init__(self, capacity: int | None = None):
        self.bodies: list[bytes] = []
        self.main, self.headers = (None, None) if capacity is None else (Lfu(capacity), Lfu(capacity))

    def match(self, data: bytes) -> tuple[int, bytes | None]:
        """The longest prefix of ``data`` that a neighbour shares, and that neighbour; of equal ones the upper."""
        at = bisect_left(self.bodies, data)
        best, found = 0, None
        for body in reversed(self.bodies[max(0, at - 1) : at + 1]):
            low, high = 0, min(len(body), len(data))
            if body[:high] == data[:high]:
                low = high
            while low < high:  # the first byte that differs lies between
                mid = (low + high + 1) // 2
                low, high = (mid, high) if body[:mid] == data[:mid] else (low, mid - 1)
            if low > best:
                best, found = low, body
        return best, found

    def insert(self, body: bytes, header: bool = False) -> None:
        """The first writer wins: a body that equals a neighbour, or is its prefix, or it its, beyond the first 16 bytes, is not added."""
        at = bisect_left(self.bodies, body)
        for other in self.bodies[max(0, at - 1) : at + 1]:
            n = min(len(body), len(other))
            if body[:PREFIX] == other[:PREFIX] and body[:n] == other[:n]:
                return
        self.bodies.insert(at, body)
        if self.main is not None:
            for gone in (self.headers if header else self.main).use(body)[1]:
                self.bodies.pop(bisect_left(self.bodies, gone))

    def touch(self, body: bytes) -> None:
        """A hit counts for fragments that are no headers."""
        if self.main is not None and body in self.main.uses:
            self.main.use(body)


def greedy_scan(data: bytes, dictionary: Dictionary) -> list[tuple[int, int, bytes | None]]:
    """DD-5: (offset, size, the dictionary's fragment or none) of each fragment of one call, against what earlier calls added."""
    at, out = 0, []
    while at < len(data):
        n, body = dictionary.match(bytes(data[at : at + 2 * MAX_FRAGMENT]))
        if n <= MIN_MATCH:
            n, body = min(MAX_FRAGMENT, len(data) - at), None
        out.append((at, n, body))
        at += n
    return out


def learn_call(data: bytes, found: list[tuple[int, int, bytes | None]], dictionary: Dictionary) -> None:
    """DD-6, 12, 14: what a scanned call leaves in the dictionary; a call without new data leaves nothing."""
    if all(body is not None for *_, body in found):
        return
    for at, n, body in found:
        if body is not None:
            dictionary.touch(body)
        else:
            dictionary.insert(bytes(data[at : at + n]), header=at == 0)


FRAGMENTS = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "id", "call", "idx", "offset", "size")] + [T.StructField("stored", T.BooleanType())])


def calls_in_turn(objects: DataFrame, nodes: int, id: str = "id", content: str = "text", call_bytes: int = CALL_BYTES) -> DataFrame:
    """DD-18, 19: (id, call, shard) of each call: objects in order of id, cut every ``call_bytes``, dealt to the nodes in turn."""
    sized = objects.select(F.col(id).cast("long").alias("id"), F.expr(f"(octet_length(cast(`{content}` as binary)) + {call_bytes - 1}) div {call_bytes}").cast("long").alias("calls")).where("calls > 0")
    placed = with_offsets(sized, ["id"], "calls", rank="__rank", offset="first")
    return placed.select("id", F.explode(F.expr("sequence(0L, calls - 1)")).alias("call"), "first").select("id", "call", F.expr(f"(first + call) % {nodes}").alias("shard"))


def greedy_dedup(objects: DataFrame, shard: Column | None = None, nodes: int = 8, id: str = "id", content: str = "text", capacity: int | None = CAPACITY, call_bytes: int = CALL_BYTES) -> DataFrame:
    """DD-5, 6, 9, 12, 18, 19: fragments of every object; ids must be distinct.

    Objects are cut into calls, which ``nodes`` nodes take in turn, or each object's
    the node that ``shard`` names.  A node works through its calls in order of id, with a
    dictionary of its own of ``capacity`` fragments at most, those least used forgotten;
    what a call adds is seen by the node's later calls.  More nodes mean more tasks and
    less found.  ``idx`` counts within the call, ``offset`` within the object.
    """
    source = objects.select(F.col(id).cast("long").alias("id"), F.col(content).cast("binary").alias("__raw"), (F.lit(None) if shard is None else shard).cast("long").alias("shard"))
    if shard is None:
        dealt = calls_in_turn(objects, nodes, id, content, call_bytes)
        source = source.drop("shard").join(dealt, "id")
    else:
        source = source.where(F.octet_length("__raw") > 0).withColumn("call", F.explode(F.expr(f"sequence(0L, bigint((octet_length(__raw) - 1) div {call_bytes}))")))
    cut = source.select("shard", "id", "call", F.substring(F.col("__raw"), (F.col("call") * call_bytes + 1).cast("int"), F.lit(call_bytes)).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, dictionary = None, Dictionary(capacity)
        for pdf in batches:
            rows = []
            for s, i, call, data in pdf.itertuples(index=False):
                if s != now:
                    now, dictionary = s, Dictionary(capacity)
                found = greedy_scan(data, dictionary)
                rows += [(s, i, call, k, call * call_bytes + at, n, body is not None) for k, (at, n, body) in enumerate(found)]
                learn_call(data, found, dictionary)
            yield pd.DataFrame(rows, columns=FRAGMENTS.names)

    return cut.repartition("shard").sortWithinPartitions("shard", "id", "call").mapInPandas(run, FRAGMENTS)


def repair_rejected(fragments: DataFrame, rejected: DataFrame) -> DataFrame:
    """DD-16: references that storage refused become new data again; effective size grows by them."""
    hit = rejected.select("address_id", "idx", F.lit(True).alias("__hit"))
    both = fragments.join(hit, ["address_id", "idx"], "left")
    return both.withColumn("kind", F.when(F.col("__hit"), "UNSTORED").otherwise(F.col("kind"))).drop("__hit")


def totals(fragments: DataFrame, by: list[str]) -> DataFrame:
    """DD-7: raw bytes, bytes of new data, and fragments of either kind."""
    new = F.col("kind") == "UNSTORED"
    return fragments.groupBy(*by).agg(F.sum("size").alias("raw"), F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("effective"), F.count(F.when(new, 1)).alias("n_new"), F.count(F.when(~new, 1)).alias("n_stored"))


def unstored_offsets(fragments: DataFrame) -> DataFrame:
    """DD-10: where each new fragment stands in the concatenation of its address's new data."""
    w = Window.partitionBy("address_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return fragments.where("kind = 'UNSTORED'").withColumn("offset", F.sum("size").over(w) - F.col("size"))


def reslice(new: DataFrame, allocated: DataFrame) -> DataFrame:
    """DD-11: new fragments (address_id, idx, offset, size) cut along the allocations (address_id, a_offset, a_size, a_ptr) that took them."""
    both = new.join(allocated, "address_id").where("offset < a_offset + a_size and a_offset < offset + size")
    begin = F.greatest("offset", "a_offset")
    end = F.least(F.col("offset") + F.col("size"), F.col("a_offset") + F.col("a_size"))
    return both.select("address_id", "idx", (F.col("a_ptr") + begin - F.col("a_offset")).alias("ptr"), (end - begin).alias("size"))


def noop(objects: DataFrame) -> DataFrame:
    """DD-17: one fragment, all of it new."""
    return objects.select("id", F.lit(0).cast("long").alias("idx"), "size", F.col("size").alias("effective_size"))
