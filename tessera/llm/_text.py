"""Shared plumbing of the text operators: Arrow blocks as numpy bytes, learning splits, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.package import ship

#: Bytes of text that one numpy block holds, so that temporaries stay small; a longer text is a block of its own.
BLOCK_BYTES = 1 << 17
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def spare_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of ``tables`` has, for columns that come and go."""
    taken = [c for df in tables for c in df.columns]
    prefix = "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` by executors that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, only ``columns`` of it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """True for rows that may not be learned from; a null id is never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


class Block:
    """Some consecutive texts as one run of UTF-8 bytes; a null text is empty and not ``valid``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.n = n
        self.valid = np.asarray(texts.is_valid()) if texts.null_count else np.ones(n, bool)
        base = int(off[0])
        self.data = np.frombuffer(data, np.uint8)[base : int(off[-1])] if data is not None and n else np.zeros(0, np.uint8)
        self.starts = off[:-1] - base
        self.ends = off[1:] - base
        self.lengths = self.ends - self.starts
        if not self.valid.all() and self.lengths[~self.valid].any():  # bytes behind a null: drop them
            keep = np.repeat(self.valid, self.lengths)
            self.data = self.data[keep]
            self.lengths = np.where(self.valid, self.lengths, 0)
            self.ends = np.cumsum(self.lengths)
            self.starts = self.ends - self.lengths

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batch: pa.RecordBatch, text: int, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that no part but a single long text holds over ``block_bytes`` of text."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if i > at and held + size > block_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[Block], dict]], keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``df``'s columns ``keep`` (default: all) and the columns that a block function finds.

    ``make`` runs once in each task and returns the block function, which gives an
    array for each name in ``fields``.  A new column, whose name gets ``prefix``,
    replaces an old one of that name, in whatever case.
    """
    added = [T.StructField(prefix + f.name, f.dataType) for f in fields]
    fresh = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    source = df.select(*kept, F.col(text).alias(spare_prefix(df) + "text"))
    schema = T.StructType([source.schema[c] for c in kept] + added)
    names, at = schema.names, len(kept)

    def run(batches):
        function = make()
        for batch in batches:
            for part in slices(batch, at):
                found = function(Block(part.column(at)))
                new = [a if isinstance(a := found[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(a) for f in fields]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(at)] + new, names=names)

    return map_arrow(source, run, schema)


def without_spans(text: str, spans: str) -> Column:
    """The bytes of column ``text`` outside the ordered ``spans`` (structs of start and end)."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    pieces = F.zip_with(begins, stops, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")))
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_INVERSE = np.uint64(pow(int(_GOLD), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _GOLD) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept for the next call unless large."""
    held = _POWERS.get(int(base))
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.ones(max(n, BLOCK_BYTES + 2), np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < len(out):
            m = min(done, len(out) - done)
            np.multiply(out[:m], out[done - 1] * base, out=out[done : done + m])
            done += m
    if len(out) <= 8 * BLOCK_BYTES:
        _POWERS[int(base)] = out
    return out[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each s, e; equal runs have equal hashes wherever they stand."""
    n = len(values)
    # Horner's rule by prefix sums: sums of v[i] * base**-i, brought back to each run's own origin.
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values.astype(np.uint64) + np.uint64(1), powers(n, _INVERSE), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    h = (total[ends] - total[starts]) * powers(n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: Bytes of words once A-Z are lower-cased: 0-9, a-z and all of UTF-8 beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a block: runs of word bytes after lower-casing A-Z; they never cross texts."""

    def __init__(self, block: Block):
        self.data = LOWER[block.data]
        inside = WORD_BYTE[self.data]
        n = len(inside)
        first = np.zeros(n, bool)
        last = np.zeros(n, bool)
        if n:
            first[0] = last[-1] = True
            first[1:] = ~inside[:-1]
            last[:-1] = ~inside[1:]
            edge = block.starts[(block.starts > 0) & (block.starts < n)]
            first[edge] = True
            last[edge - 1] = True
        self.starts = np.flatnonzero(inside & first)
        self.ends = np.flatnonzero(inside & last) + 1
        #: Words of text i are first[i] … first[i + 1] - 1.
        self.first = np.searchsorted(self.starts, np.append(block.starts, n))
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words; of length len(words) - width + 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return run_hashes(words, at, at + width)


def whole_groups(batches, keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by their first ``keys`` columns, dealt anew so that no group is cut, with each group's first row.

    A group is held whole, so groups must be bounded by how rows were keyed.
    """

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        new = np.zeros(n, bool)
        for k in range(keys):
            c = batch.column(k)
            differ = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True)
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        new[0] = True
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            whole = pa.concat_batches(held)
            yield whole, changes(whole)
            held = []
        starts = changes(batch)
        if len(starts) > 1:  # all but the last group are whole
            head = pa.concat_batches([*held, batch.slice(0, int(starts[-1]))])
            yield head, changes(head)
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
    if held:
        whole = pa.concat_batches(held)
        yield whole, changes(whole)
