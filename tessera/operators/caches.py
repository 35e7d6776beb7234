"""Cache traces replayed: what hits, what goes (CA-*).

A cache's state depends on all that came before, so a trace is replayed in order
within its shard; shards are caches of their own and run side by side.  A shard's
rows stream through a task; only the cache itself is held.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLAY = T.StructType([T.StructField("shard", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("hit", T.BooleanType()), T.StructField("evicted", T.ArrayType(T.StringType()))])


class Lru:
    """CA-2: reads and writes refresh; beyond the capacity the one unused longest goes."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def use(self, key: str, size: int = 1) -> tuple[bool, list[str]]:
        hit = key in self.held
        self.held[key] = size
        self.held.move_to_end(key)
        return hit, [self.held.popitem(last=False)[0]] if len(self.held) > self.capacity else []


class ByteLru:
    """CA-6, 8: the capacity is in bytes; what is pinned does not go."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.total, self.pinned = capacity, OrderedDict(), 0, set()

    def use(self, key: str, size: int = 1) -> tuple[bool, list[str]]:
        hit = key in self.held
        self.total += size - self.held.get(key, 0)
        self.held[key] = size
        self.held.move_to_end(key)
        gone = []
        for other in list(self.held):
            if self.total <= self.capacity:
                break
            if other != key and other not in self.pinned:
                self.total -= self.held.pop(other)
                gone.append(other)
        return hit, gone


class ReadCache(Lru):
    """CA-5: a hit is a cached value at least as long as what is asked for."""

    def use(self, key: str, size: int = 1) -> tuple[bool, list[str]]:
        hit = self.held.get(key, -1) >= size
        _, gone = super().use(key, max(size, self.held.get(key, 0)))
        return hit, gone


class Lfu:
    """CA-1: the least used goes, of equals the oldest; a new key counts as used once and may be the one that goes."""

    def __init__(self, capacity: int, reset_on_update: bool = False):
        self.capacity, self.reset = capacity, reset_on_update
        self.uses: dict[str, int] = {}
        self.levels: dict[int, OrderedDict] = {}

    def _put(self, key: str, uses: int) -> None:
        self.uses[key] = uses
        self.levels.setdefault(uses, OrderedDict())[key] = None

    def _take(self, key: str) -> int:
        uses = self.uses.pop(key)
        level = self.levels[uses]
        del level[key]
        if not level:
            del self.levels[uses]
        return uses

    def use(self, key: str, size: int = 1) -> tuple[bool, list[str]]:
        hit = key in self.uses
        if hit:
            uses = self._take(key)
            self._put(key, 1 if self.reset else uses + 1)
            return True, []
        self._put(key, 1)
        if len(self.uses) <= self.capacity:
            return False, []
        gone = next(iter(self.levels[min(self.levels)]))
        self._take(gone)
        return False, [gone]

    def erase(self, key: str) -> None:
        if key in self.uses:
            self._take(key)


def replay(trace: DataFrame, make: Callable[[], object], shard: Column | None = None) -> DataFrame:
    """A trace (seq, key, size) through caches that ``make`` gives, one for each shard."""
    source = trace.select((F.lit(0) if shard is None else shard).cast("long").alias("shard"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("size").cast("long").alias("size"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, None
        for pdf in batches:
            rows = []
            for s, seq, key, size in pdf.itertuples(index=False):
                if s != now:
                    now, cache = s, make()
                hit, gone = cache.use(key, size)
                rows.append((s, seq, key, hit, gone))
            yield pd.DataFrame(rows, columns=REPLAY.names)

    return source.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, REPLAY)


def timed_hits(trace: DataFrame, retention: int, by: list[str]) -> DataFrame:
    """CA-3: a use is a hit if the one before lies within the retention."""
    w = Window.partitionBy(*by).orderBy("at", "seq")
    return trace.withColumn("gap", F.col("at") - F.lag("at").over(w)).withColumn("hit", F.coalesce(F.col("gap") <= retention, F.lit(False)))


def write_batches(writes: DataFrame, n: int, by: str = "shard") -> DataFrame:
    """CA-4: which flush each write leaves with, when every ``n`` writes are flushed."""
    w = Window.partitionBy(by).orderBy("seq")
    return writes.withColumn("__rn", F.row_number().over(w)).withColumn("flush", F.expr(f"(__rn - 1) div {n}")).drop("__rn")
