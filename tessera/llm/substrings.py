"""Suffix-array deduplication of byte substrings (operator 4).

Every byte covered by a string of ``length`` bytes that also starts in a document
with a smaller id is removed, all strings judged on the input.

1. Documents are packed (some megabytes of text each) and written once.
2. Anchors: in each string of ``length`` bytes the 16-gram with the lowest hash.
   The anchor depends on the string alone, so equal strings meet under one anchor.
   Anchors, six bytes each, are dealt to buckets, which tell the packs which of
   them occur elsewhere too.
3. Around each such anchor lies its context, the bytes of all strings that might
   have it as theirs.  Distinct contexts go to the anchors' buckets with the
   smallest id that has them; copies, however many, are one context of a pack.
4. A bucket's contexts, cut into 16-byte symbols aligned at the anchor, make one
   text, whose suffix array is built by linear grouping.  Neighbours' common
   prefixes, in bytes, split it into runs of suffixes that agree to a string's end;
   what lies before the symbol's border is compared too.  So each string of a
   context learns the smallest id that has it.
5. The verdicts go back to the packs: spans are marked, joined and cut out.

Nothing is emitted for pairs, and a group of copies is one row of a bucket for
each pack.  Buckets number at least four for each shuffle partition and one for each
8 MiB of text, so what a bucket holds does not grow with the input.

An anchor that ``HOT_PACKS`` packs or more have is hot.  A string with it has at least
half of its other bytes on one side, so a hot anchor's contexts go to two buckets:
that of the anchor with the 17 bytes behind it, which judges the strings that reach
those, and that of the anchor with the bytes before it, which judges the others.  Equal
strings still meet, and an anchor's contexts are spread over tasks.

Hashes only bring contexts together; what counts as equal is equal byte for byte.

Defined cases: a null text has no bytes; one shorter than ``length`` is kept
whole; rows of one id do not remove each other's bytes, so repeated rows keep theirs;
a row with a null id neither loses bytes nor removes any; a text of any length is
taken whole, and is a pack of its own beyond 2 MiB; an empty table gives no rows.
Ids are whole numbers: another type is an error.  Columns beside id and text play no
part, whatever their names, and come back as they are from ``remove_spans``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import materialize, scratch
from ._text import Block, map_arrow, mix64, run_hashes, slices, spare_prefix, whole_groups, without_spans
from .suffix_array import suffix_array

LENGTH = 50
GRAM = 16
PACK_BYTES = 1 << 21
STRETCH = 1 << 18
BUCKETS_PER_PARTITION = 4
BUCKET_BYTES = 8 << 20
#: Packs that an anchor may occur in before its contexts are split by what stands beside it.
HOT_PACKS = 4096
#: Bytes beside a hot anchor that tell its contexts apart.
BESIDE = 17
#: Contexts whose suffixes are sorted together, unless one anchor has more.
SORTED_TOGETHER = 4000
HASH_BYTES = 6
EARLIER = np.uint64(1) << np.uint64(63)
#: Which strings an entry judges, by their offset in the context: all, those that reach behind the anchor, or the others.
BOTH, BEHIND, BEFORE = 0, 1, 2


def _squeeze(x: np.ndarray | bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x.tobytes() if isinstance(x, np.ndarray) else x)


def _expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` values."""
    n, now = 1, a
    while 2 * n <= width:
        now = f(now[:-n], now[n:])
        n *= 2
    rest = width - n
    return f(now[: len(now) - rest], now[rest:]) if rest else now


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the lowest 16-grams of all strings of ``length`` bytes within texts."""
    window = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) + np.uint64(1)
        n, factor = 1, np.uint64(0x9E3779B97F4A7C15)
        while n < GRAM:
            h = h[:-n] * factor + h[n:]
            n, factor = 2 * n, factor * factor
    h = mix64(h)
    low = _slide(h, window, np.minimum)  # of the string that starts here
    n = len(low)
    # Strings that would cross into the next text have no anchor.
    whole = np.zeros(n + 1, np.int32)
    valid = ends - starts >= length
    np.add.at(whole, starts[valid], 1)
    np.add.at(whole, ends[valid] - length + 1, -1)
    inside = np.cumsum(whole)[:n] > 0
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, window, np.maximum) == h)
    at = at[h[at] != 0]
    return at, h[at]


class Pack:
    """Some documents' ids and bytes, with the anchors that occur in them."""

    def __init__(self, blob: bytes, length: int):
        with pa.ipc.open_stream(_expand(blob)) as reader:
            batch = reader.read_next_batch()
        self.ids = batch.column(0)
        self.block = Block(batch.column(1))
        known = np.asarray(self.ids.is_valid())
        self.id = self.ids.fill_null(0).to_numpy()
        b, self.length = self.block, length
        # Texts without an id take no part.
        found: dict[int, tuple] = {}
        for s in range(0, max(1, len(b.data)), STRETCH):  # so that a very long text takes no more memory than its anchors
            e = min(len(b.data), s + STRETCH + length - 1)
            inside = known & (b.starts < e) & (b.ends > s)
            at, h = anchors(b.data[s:e], np.maximum(b.starts[inside], s) - s, np.minimum(b.ends[inside], e) - s, length)
            found[s] = (at + s, h)
        at = np.concatenate([x for x, _ in found.values()])
        self.at, first = np.unique(at, return_index=True)
        self.h = np.concatenate([x for _, x in found.values()])[first]
        # Empty texts start where the next one does: the last start at or before a byte owns it.
        self.doc = np.searchsorted(b.starts, self.at, "right") - 1

    def contexts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes before and after the chosen anchors that strings with them can reach, and a hash of the context."""
        at, doc, b = self.at[chosen], self.doc[chosen], self.block
        left = np.minimum(at - b.starts[doc], self.length - GRAM)
        right = np.minimum(b.ends[doc] - at, self.length)
        return left, right, context_keys(b.data, at, left, right)


def context_keys(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each context and of where its anchor stands in it."""
    return mix64(run_hashes(data, at - left, at + right) ^ (left.astype(np.uint64) << np.uint64(32)))


def _six(h: np.ndarray, buckets: int) -> np.ndarray:
    """The hashes without what the bucket tells, as 48-bit numbers."""
    return (h // np.uint64(buckets)) & np.uint64((1 << 48) - 1)


def _to_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _from_bytes(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k()) for n, k in kinds.items()])


PACKS = _fields(pack=T.LongType, bytes=T.LongType, blob=T.BinaryType)
ANCHORS = _fields(bucket=T.IntegerType, pack=T.LongType, once=T.BinaryType, often=T.BinaryType)
SHARED = _fields(pack=T.LongType, bucket=T.IntegerType, shared=T.BinaryType, hot=T.BinaryType)
CONTEXTS = _fields(bucket=T.IntegerType, pack=T.LongType, ids=T.BinaryType, shape=T.BinaryType, data=T.BinaryType)
VERDICTS = _fields(pack=T.LongType, bucket=T.IntegerType, verdict=T.BinaryType)


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(schema)], names=schema.names)


def _pack(documents: DataFrame, id: str, text: str) -> DataFrame:
    if not isinstance(documents.schema[id].dataType, T.IntegralType):
        raise TypeError(f"{id} must be a whole number, not {documents.schema[id].dataType.simpleString()}")
    source = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for batch in batches:
            for part in slices(batch, 1, PACK_BYTES):
                to = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.large_binary())], names=["id", "text"])
                with pa.ipc.new_stream(to, own.schema) as writer:
                    writer.write_batch(own)
                yield _batch(PACKS, [(number, own.nbytes, _squeeze(to.getvalue().to_pybytes()))])
                number += 1

    return map_arrow(source, run, PACKS)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """A stable order by bucket, and where each bucket that occurs stands in it."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(bucket))
    return order, {k: slice(a, b) for k, a, b in zip(found.tolist(), starts.tolist(), ends.tolist(), strict=True)}


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _spread(packs: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pack = Pack(blob, length)
                order = np.lexsort((pack.id[pack.doc], pack.h))
                h, id = pack.h[order], pack.id[pack.doc][order]
                if not len(h):
                    continue
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                last = np.append(new[1:], len(h)) - 1
                often, h = id[new] != id[last], h[new]
                order, places = _split((h % np.uint64(buckets)).astype(np.int64))
                six, often = _six(h, buckets)[order], often[order]
                rows = []
                for k, at in places.items():
                    own, many = six[at], often[at]
                    rows.append((k, number, _to_bytes(np.sort(own[~many])), _to_bytes(np.sort(own[many]))))
                yield _batch(ANCHORS, rows)

    return map_arrow(packs, run, ANCHORS)


def _share(rows: DataFrame, hot_packs: int) -> DataFrame:
    def run(batches):
        for table, starts in whole_groups(batches, 1):
            out = []
            ends = np.append(starts[1:], table.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                bucket = table.column(0)[s].as_py()
                once = [_from_bytes(x) for x in table.column(2).slice(s, e - s).to_pylist()]
                often = [_from_bytes(x) for x in table.column(3).slice(s, e - s).to_pylist()]
                every = np.sort(np.concatenate(once + often))
                repeated = every[1:][every[1:] == every[:-1]]
                shared = np.unique(np.concatenate([repeated, *often]))
                if not len(shared):
                    continue
                new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                hot = every[new][np.diff(np.append(new, len(every))) >= hot_packs]
                for pack, x, y in zip(table.column(1).slice(s, e - s).to_pylist(), once, often, strict=True):
                    own = np.sort(np.concatenate([x, y]))
                    own = own[_among(own, shared)]
                    if len(own):
                        out.append((pack, bucket, _to_bytes(own), _to_bytes(own[_among(own, hot)])))
            if out:
                yield _batch(SHARED, out)

    return map_arrow(rows, run, SHARED)


def _chosen(pack: Pack, buckets: int, answers: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pack's anchors that occur elsewhere, their buckets, and whether they are hot."""
    bucket = (pack.h % np.uint64(buckets)).astype(np.int64)
    six = _six(pack.h, buckets)
    order, places = _split(bucket)
    keep, hot = np.zeros(len(six), bool), np.zeros(len(six), bool)
    for k, (shared, often) in answers.items():
        own = order[places[k]]
        keep[own] = _among(six[own], _from_bytes(shared))
        if often:
            hot[own] = _among(six[own], _from_bytes(often))
    at = np.flatnonzero(keep)
    return at, bucket[at], hot[at]


class Distinct:
    """A pack's contexts: each once, with the places that have it and the buckets that judge it."""

    def __init__(self, pack: Pack, buckets: int, answers: dict[int, tuple[bytes, bytes]]):
        self.at, bucket, hot = _chosen(pack, buckets, answers)
        at = self.at
        self.left, self.right, key = pack.contexts(at)
        order = np.lexsort((pack.id[pack.doc[at]], key, bucket))
        k, b = key[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        alike = np.flatnonzero(~new)
        if len(alike):  # equal hashes: compare the contexts themselves
            new[alike] = ~_same(pack, at[order[alike - 1]], at[order[alike]], self.left[order[alike - 1]], self.left[order[alike]], self.right[order[alike - 1]], self.right[order[alike]])
        begins = np.flatnonzero(new)
        #: The first place of each context, that with its smallest id, and the context of each place.
        self.first = order[begins]
        self.rank = np.zeros(len(at), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        # Entries: (bucket, context, which strings it judges), in order of bucket.
        cold, warm = np.flatnonzero(~hot[self.first]), np.flatnonzero(hot[self.first])
        to = [bucket[self.first[cold]]]
        if len(warm):
            own, n = self.first[warm], beside_of(pack.length)
            data, column = np.concatenate([np.zeros(n, np.uint8), pack.block.data, np.zeros(GRAM + n, np.uint8)]), np.arange(n)[None, :]
            # What lies beyond the context's own text reads as zeros.
            behind = np.where(column + GRAM < self.right[own][:, None], data[pack.at[at[own]][:, None] + column + GRAM + n], 0)
            before = np.where(column >= n - self.left[own][:, None], data[pack.at[at[own]][:, None] + column], 0)
            for part, grid in ((BEHIND, behind), (BEFORE, before)):
                beside = run_hashes(grid.ravel(), np.arange(len(grid)) * n, np.arange(1, len(grid) + 1) * n)
                to.append((mix64(beside ^ pack.h[at[own]] ^ np.uint64(part)) % np.uint64(buckets)).astype(np.int64))
        context = np.concatenate([cold, warm, warm])
        part = np.repeat(np.array([BOTH, BEHIND, BEFORE], np.uint8), [len(cold), len(warm), len(warm)])
        to = np.concatenate(to)
        sort = np.lexsort((part, context, to))
        self.bucket, self.part, self.context = to[sort], part[sort], context[sort]


def beside_of(length: int) -> int:
    """How many bytes beside a hot anchor tell its contexts apart: no string has fewer on both sides."""
    return min(BESIDE, (length - GRAM) // 2)


def _same(pack: Pack, a: np.ndarray, b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray, right_a: np.ndarray, right_b: np.ndarray) -> np.ndarray:
    """Whether the contexts of anchors ``a`` and ``b`` are the same bytes around the same place."""
    same = (left_a == left_b) & (right_a == right_b)
    data, reach = pack.block.data, pack.length - GRAM
    for some in np.array_split(np.flatnonzero(same), max(1, len(a) // 20_000)):  # so that the grids stay small
        column = np.arange(-reach, pack.length)[None, :]
        inside = (column >= -left_a[some][:, None]) & (column < right_a[some][:, None])
        last = len(data) - 1
        x, y = (data[np.clip(pack.at[k[some]][:, None] + column, 0, last)] for k in (a, b))
        same[some] = ((x == y) | ~inside).all(axis=1)
    return same


def _with_answers(packs: DataFrame, shared: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Packs (kind 0), what buckets told them of anchors (kind 1), and of contexts (kind 2): each pack's rows together."""
    none = F.lit(None).cast("binary")
    rows = packs.select("pack", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "blob", none.alias("hot"))
    rows = rows.unionByName(shared.select("pack", F.lit(1).alias("kind"), "bucket", F.col("shared").alias("blob"), "hot"))
    if verdicts is not None:
        rows = rows.unionByName(verdicts.select("pack", F.lit(2).alias("kind"), "bucket", F.col("verdict").alias("blob"), none.alias("hot")))
    return rows.repartition("pack").sortWithinPartitions("pack", "kind", "bucket")


def _gather(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    span = 2 * length - GRAM

    def run(batches):
        for table, starts in whole_groups(batches, 1):
            ends = np.append(starts[1:], table.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                number = table.column(0)[s].as_py()
                pack = Pack(table.column(3)[s].as_py(), length)
                found = Distinct(pack, buckets, _answers(table, s + 1, e))
                line = np.concatenate([np.zeros(length, np.uint8), pack.block.data, np.zeros(length, np.uint8)])
                column = np.arange(span)[None, :] - (length - GRAM)
                id = pack.id[pack.doc[found.at[found.first]]]
                out = []
                for k, at in _split(found.bucket)[1].items():
                    own = found.first[found.context[at]]
                    shape = np.stack([found.left[own], found.right[own]], axis=1).astype(np.uint16)
                    grid = line[pack.at[found.at[own]][:, None] + column + length]
                    grid[(column < -found.left[own][:, None]) | (column >= found.right[own][:, None])] = 0
                    out.append((k, number, _squeeze(id[found.context[at]]), _squeeze(shape), _squeeze(grid, 6)))
                yield _batch(CONTEXTS, out)

    return map_arrow(rows, run, CONTEXTS)


def _answers(table: pa.RecordBatch, start: int, end: int) -> dict[int, tuple[bytes, bytes]]:
    """What the buckets told a pack: by bucket, its anchors that occur elsewhere, and the hot ones among them."""
    rows = (table.column(k).slice(start, end - start).to_pylist() for k in (1, 2, 3, 4))
    return {bucket: (shared, hot) for kind, bucket, shared, hot in zip(*rows, strict=True) if kind == 1}


def smallest_ids(grid: np.ndarray, left: np.ndarray, right: np.ndarray, id: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context and offset, the smallest id with the same string there; the own id where there is no string.

    ``grid`` holds the contexts' bytes, aligned at their anchors, sorted so that those
    of an anchor stand together.  By suffix array and common prefixes.
    """
    m, span = grid.shape
    middle = length - GRAM  # the anchor's column
    best = np.repeat(id[:, None], middle + 1, axis=1)
    first = middle % GRAM
    blocks = -(-(span - first) // GRAM)
    padded = np.zeros((m, GRAM + first + blocks * GRAM), np.uint8)
    padded[:, GRAM : GRAM + span] = grid
    symbols = padded[:, GRAM + first :].reshape(m * blocks, 2, 8).copy().view(">u8").reshape(m * blocks, 2).astype(np.uint64)
    order = np.lexsort((symbols[:, 1], symbols[:, 0]))
    ranked = symbols[order]
    new = np.concatenate([[False], (ranked[1:] != ranked[:-1]).any(axis=1)])
    rank = np.zeros(m * blocks, np.int64)
    rank[order] = np.cumsum(new) + 1
    text = np.zeros((m, blocks + 1), np.int64)  # 0 ends each context
    text[:, :blocks] = rank.reshape(m, blocks)
    suffixes = np.asarray(suffix_array(text.ravel().tolist()), np.int64)
    row, block = suffixes // (blocks + 1), suffixes % (blocks + 1)
    for k in range(middle // GRAM + 1):
        border = first + k * GRAM  # the column at which these suffixes begin
        rows = row[block == k]
        tail = grid[rows, border:]
        same = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            differ = tail[1:] != tail[:-1]
            same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), tail.shape[1])
        # The up to 15 bytes before the border, as two numbers.
        head = padded[rows, border : border + GRAM].reshape(len(rows), 2, 8).copy().view(">u8").reshape(len(rows), 2).astype(np.uint64)
        for offset in range(max(0, border - GRAM + 1), border + 1):
            part = border - offset
            run = np.cumsum(same < length - part)
            has = np.flatnonzero((offset >= middle - left[rows]) & (offset + length <= middle + right[rows]))
            # Only runs of several contexts can hold a string twice.
            several = np.bincount(run[has], minlength=run[-1] + 1)[run[has]] > 1
            has = has[several]
            if not len(has):
                continue
            high = head[has, 0] & np.uint64((1 << max(0, 8 * (part - 8))) - 1)
            low = head[has, 1] & np.uint64((1 << min(64, 8 * part)) - 1)
            key = mix64(mix64(mix64(run[has].astype(np.uint64)) ^ high) ^ low)
            sort = np.argsort(key, kind="stable")
            r, a, b = run[has][sort], high[sort], low[sort]
            begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            own = rows[has][sort]
            least = np.minimum.reduceat(id[own], begin)
            best[own, offset] = np.repeat(least, np.diff(np.append(begin, len(own))))
    return best


def _judge(rows: DataFrame, length: int) -> DataFrame:
    span, middle = 2 * length - GRAM, length - GRAM

    def run(batches):
        for table, starts in whole_groups(batches, 1):
            ends = np.append(starts[1:], table.num_rows)
            out = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                bucket, packs = table.column(0)[s].as_py(), table.column(1).slice(s, e - s).to_pylist()
                column = lambda k: table.column(k).slice(s, e - s).to_pylist()  # noqa: B023, E731
                ids = [np.frombuffer(_expand(x), np.int64) for x in column(2)]
                shape = np.concatenate([np.frombuffer(_expand(x), np.uint16).reshape(-1, 2) for x in column(3)]).astype(np.int64)
                grid = np.concatenate([np.frombuffer(_expand(x), np.uint8).reshape(-1, span) for x in column(4)])
                keys = context_keys(grid.ravel(), np.arange(len(grid)) * span + middle, shape[:, 0], shape[:, 1])
                id = np.concatenate(ids)
                sort = np.lexsort((id, keys))
                k = keys[sort]
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                alike = np.flatnonzero(~new)  # equal hashes: compare the contexts themselves
                x, y = sort[alike - 1], sort[alike]
                new[alike] = (grid[x] != grid[y]).any(axis=1) | (shape[x] != shape[y]).any(axis=1)
                number = np.zeros(len(keys), np.int64)
                number[sort] = np.cumsum(new) - 1
                first = sort[new]  # a row of each distinct context, with its smallest id
                shape, grid = shape[first], grid[first]
                least = id[first]
                anchor = grid[:, middle : middle + GRAM].copy().view(">u8").reshape(-1, 2)
                order = np.lexsort((anchor[:, 1], anchor[:, 0]))
                cut = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]).any(axis=1)])
                begins = np.append(np.flatnonzero(cut), len(order))
                several = np.diff(begins) > 1  # an anchor with one context has no string twice
                order = order[np.repeat(several, np.diff(begins))]
                begins = np.concatenate([[0], np.cumsum(np.diff(begins)[several])])
                verdict = np.zeros(len(first), np.uint64)
                at = 0
                while at < len(begins) - 1:
                    to = max(at + 1, int(np.searchsorted(begins, begins[at] + SORTED_TOGETHER, "right")) - 1)
                    own = order[begins[at] : begins[to]]
                    best = smallest_ids(grid[own], shape[own, 0], shape[own, 1], least[own], length)
                    bits = (best < least[own][:, None]).astype(np.uint64) << np.arange(middle + 1, dtype=np.uint64)[None, :]
                    verdict[own] = np.bitwise_or.reduce(bits, axis=1)
                    at = to
                done = 0
                for pack, x in zip(packs, ids, strict=True):
                    own = number[done : done + len(x)]
                    answer = np.where(x > least[own], EARLIER, verdict[own])
                    done += len(x)
                    out.append((pack, bucket, _squeeze(answer)))
            yield _batch(VERDICTS, out)

    return map_arrow(rows, run, VERDICTS)


FOUND = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("text_crc32", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def _verdicts(table: pa.RecordBatch, start: int, end: int) -> dict[int, bytes]:
    """The buckets' verdicts for a pack."""
    rows = (table.column(k).slice(start, end - start).to_pylist() for k in (1, 2, 3))
    return {bucket: verdict for kind, bucket, verdict in zip(*rows, strict=True) if kind == 2}


def _mark(rows: DataFrame, buckets: int, length: int, id: str) -> DataFrame:
    schema = T.StructType([T.StructField(id, T.LongType()), *FOUND])
    middle = length - GRAM

    def run(batches):
        for table, starts in whole_groups(batches, 1):
            ends = np.append(starts[1:], table.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                pack = Pack(table.column(3)[s].as_py(), length)
                b = pack.block
                verdicts = _verdicts(table, s + 1, e)
                change = np.zeros(len(b.data) + 1, np.int32)
                answers = _answers(table, s + 1, e)
                if answers:
                    found = Distinct(pack, buckets, answers)
                    at, left, right, first, rank = found.at, found.left, found.right, found.first, found.rank
                    judged = np.concatenate([np.frombuffer(_expand(verdicts[k]), np.uint64) for k in sorted(verdicts)]) if verdicts else np.zeros(0, np.uint64)
                    if len(judged) != len(found.context):
                        raise ValueError("verdicts do not fit their pack")
                    # A string that begins few bytes before its anchor reaches far behind it.
                    every, near = (1 << 63) - 1, sum(1 << k for k in range(middle - beside_of(length), middle + 1))
                    scope = np.array([every, near, every & ~near], np.uint64) | EARLIER
                    word = np.zeros(len(first), np.uint64)
                    np.bitwise_or.at(word, found.context, judged & scope[found.part])
                    # Later copies of a context within the pack have an earlier document too.
                    id_of = pack.id[pack.doc[at]]
                    whole = ((word[rank] & EARLIER) != 0) | (id_of > id_of[first][rank])
                    whole_at = np.flatnonzero(whole & (left + right >= length))
                    np.add.at(change, pack.at[at[whole_at]] - left[whole_at], 1)
                    np.add.at(change, pack.at[at[whole_at]] + right[whole_at], -1)
                    part = np.flatnonzero(~whole & (word[rank] != 0))
                    i, o = np.nonzero((word[rank[part]][:, None] >> np.arange(middle + 1, dtype=np.uint64)[None, :]) & np.uint64(1))
                    begin = pack.at[at[part[i]]] - middle + o
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[b.ends] - total[b.starts]
                columns = [[] for _ in FOUND]
                for i in range(b.n):
                    raw = b.data[b.starts[i] : b.ends[i]]
                    spans = []
                    if removed[i]:
                        mine = gone[b.starts[i] : b.ends[i]]
                        step = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                        spans = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                        kept = raw[~mine].tobytes()
                    else:
                        kept = raw.tobytes()
                    for to, x in zip(columns, (len(raw), int(removed[i]), len(spans), hashlib.sha256(kept).hexdigest(), zlib.crc32(raw), spans), strict=True):
                        to.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pack.ids, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=schema.names)

    return map_arrow(rows, run, schema)


def repeated_spans(documents: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text", buckets: int | None = None, hot_packs: int = HOT_PACKS) -> DataFrame:
    """One row for each row of ``documents``: id, n_bytes, n_removed, n_spans, kept_sha256, text_crc32 and the removed byte spans."""
    if not GRAM <= length <= GRAM + 62:
        raise ValueError(f"length is {GRAM} to {GRAM + 62}")  # a string's offset is a bit of a verdict
    with scratch() as kept:
        packs = materialize(_pack(documents, id, text), "packs")
        if buckets is None:
            size = packs.agg(F.sum("bytes")).first()[0] or 0
            buckets = max(BUCKETS_PER_PARTITION * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
        shared = materialize(_share(by_bucket(_spread(packs, buckets, length)), hot_packs), "shared")
        verdicts = materialize(_judge(by_bucket(_gather(_with_answers(packs, shared), buckets, length)), length), "verdicts")
        kept.append(materialize(_mark(_with_answers(packs, shared, verdicts), buckets, length, id), "spans"))
    return kept[0]


def remove_spans(documents: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the spans of ``found`` cut out of their texts, as bytes in ``text``."""
    p = spare_prefix(documents)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    spans = found.select(F.col(id).alias(p + "id"), F.col("text_crc32").alias(p + "crc"), F.col("spans").alias(p + "spans")).dropDuplicates([p + "id", p + "crc"])
    # Only texts that lose bytes have spans to find.
    joined = documents.join(spans.where(F.size(p + "spans") > 0), (F.col(id) == F.col(p + "id")) & (F.crc32(raw) == F.col(p + "crc")), "left")
    return joined.withColumn(text, F.when(F.col(p + "spans").isNotNull(), without_spans(text, p + "spans")).otherwise(raw)).select(*documents.columns)
