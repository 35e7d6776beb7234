"""Benchmark decontamination (operator 9).

Word windows of benchmark items become a hash set that goes to every task; each
document's windows are looked up in it, and a hit counts only after its words
were compared.  A set holds ``max_broadcast_windows`` windows at most.  A benchmark
with more is dealt into blocks of items within that bound: a pass over the documents
for each block writes what it hits, the block is taken back from the executors before
the next one is sent, and a last pass puts the hits of each document together.

Defined cases: a null or empty text has no words, no hits and is kept; an item
without words never occurs; rows of the benchmark with a null id are left out;
repeated (id, text) rows count as one; an id with several texts occurs when any
of them does; an empty benchmark contaminates nothing, and an empty table has no rows.
Repeated rows of the documents are judged each by itself; a text of any length is
searched whole.  New columns replace old ones of their names; ``remove_contamination``
returns the table's own columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import materialize
from ._text import Block, Words, map_arrow, slices, spare_prefix, window_hashes, with_text_columns, without_spans

#: Windows that may be held by one task at a time: 8 bytes of hash, 4 of item and about 80 of words each.
MAX_BROADCAST_WINDOWS = 1_000_000


class WindowSet(NamedTuple):
    """Windows of one block of the benchmark, ordered by width and hash."""

    hashes: dict[int, np.ndarray]
    items: dict[int, np.ndarray]
    words: dict[int, list[bytes]]
    ids: list


def _window_set(rows: list[tuple], width: int) -> WindowSet:
    ids = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    found: dict[int, set] = {}
    for item, text in rows:
        block = Block(pa.array([text], pa.string()))
        words = Words(block)
        k = min(width, int(words.counts[0]))
        if not k:
            continue
        h = window_hashes(words.hashes(), k)
        pieces = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
        for i, x in enumerate(h.tolist()):
            found.setdefault(k, set()).add((x, at[item], b" ".join(pieces[i : i + k])))
    ordered = {k: sorted(v) for k, v in found.items()}
    return WindowSet(
        {k: np.array([x[0] for x in v], np.uint64) for k, v in ordered.items()},
        {k: np.array([x[1] for x in v], np.int64) for k, v in ordered.items()},
        {k: [x[2] for x in v] for k, v in ordered.items()},
        ids,
    )


def _blocks(benchmark: DataFrame, width: int, most: int, item: str, text: str):
    """Blocks of the benchmark of ``most`` windows at most (one larger item is a block of its own)."""
    held, windows = [], 0
    rows = benchmark.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(item, text)
    for row in rows.toLocalIterator():
        n = len(row[1]) // 2 + 1  # no text has more words than this
        if held and windows + n > most:
            yield _window_set(held, width)
            held, windows = [], 0
        held.append((row[0], row[1]))
        windows += n
    if held:
        yield _window_set(held, width)


def _look_up(words: Words, hashes: np.ndarray, windows: WindowSet, hit: np.ndarray, doc_of: np.ndarray, items: list[set]) -> None:
    """Marks hit words and adds the items that occur in each text, after comparing the words."""
    for k, known in windows.hashes.items():
        h = window_hashes(hashes, k)
        if not len(h):
            continue
        lo = np.searchsorted(known, h)
        like = known[np.minimum(lo, len(known) - 1)] == h
        like &= doc_of[: len(h)] == doc_of[k - 1 :]  # windows never cross texts
        for i in np.flatnonzero(like).tolist():
            own = b" ".join(words.data[words.starts[j] : words.ends[j]].tobytes() for j in range(i, i + k))
            at, verified = int(lo[i]), False
            while at < len(known) and known[at] == h[i]:
                if windows.words[k][at] == own:
                    items[doc_of[i]].add(windows.ids[windows.items[k][at]])
                    verified = True
                at += 1
            if verified:
                hit[i : i + k] = True


FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    max_broadcast_windows: int = MAX_BROADCAST_WINDOWS,
    prefix: str = "",
) -> DataFrame:
    """``documents`` with their hit words, items and hit byte spans; nothing is removed yet.

    A window is ``width`` consecutive words of an item, or all its words if it has
    fewer.  One pass over the documents and no shuffle, whatever the skew, as long as
    the benchmark's windows are within the bound.
    """
    blocks = _blocks(benchmark, width, max_broadcast_windows, item, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:
        return _in_passes(documents, itertools.chain((first, second), blocks), text, keep, prefix)
    sent = documents.sparkSession.sparkContext.broadcast(first)

    def make():
        def find(block: Block) -> dict:
            words, hit, items = _search(block, sent.value)
            return _report(block, words, hit, items)

        return find

    return with_text_columns(documents, text, FOUND, make, keep, prefix)


def _search(block: Block, windows: WindowSet | None) -> tuple[Words, np.ndarray, list[set]]:
    """The block's words, which of them are hit, and each text's items."""
    words = Words(block)
    hashes = words.hashes()
    hit = np.zeros(len(hashes), bool)
    items: list[set] = [set() for _ in range(block.n)]
    if windows is not None:
        _look_up(words, hashes, windows, hit, np.repeat(np.arange(block.n), words.counts), items)
    return words, hit, items


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of hit words."""
    mark = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(mark == 1), np.flatnonzero(mark == -1) - 1


def _report(block: Block, words: Words, hit: np.ndarray, items: list[set]) -> dict:
    """The columns of FOUND."""
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    spans = []
    for i in range(block.n):
        s, e = _runs(hit[words.first[i] : words.first[i + 1]]) if n_hit[i] else ((), ())
        spans.append([{"start": int(words.starts[words.first[i] + x] - block.starts[i]), "end": int(words.ends[words.first[i] + y] - block.starts[i])} for x, y in zip(s, e, strict=True)])
    return {
        "n_words": words.counts.astype(np.int64),
        "n_hit": n_hit.astype(np.int64),
        "n_items": np.array([len(x) for x in items], np.int64),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items], pa.string()),
        "contaminated": n_hit > 0,
        "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    }


_HITS = T.StructType([T.StructField("row", T.LongType()), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _in_passes(documents: DataFrame, blocks, text: str, keep: list[str] | None, prefix: str) -> DataFrame:
    """find_contamination by one pass for each block, so that a task never holds more than one."""
    p = spare_prefix(documents)
    row, held = p + "row", p + "hits"
    # Numbers are written down: they must be the same in every pass.
    numbered = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    context = documents.sparkSession.sparkContext
    found = []
    for windows in blocks:
        sent = context.broadcast(windows)

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, 1):
                    words, hit, items = _search(Block(part.column(1)), sent.value)
                    own = [i for i in range(part.num_rows) if items[i]]
                    runs = [_runs(hit[words.first[i] : words.first[i + 1]]) for i in own]
                    rows = [part.column(0).take(pa.array(own, pa.int64())), *(pa.array([r[k].tolist() for r in runs], pa.list_(pa.int64())) for k in (0, 1)), pa.array([sorted(map(str, items[i])) for i in own], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(rows, names=_HITS.names)

        found.append(materialize(map_arrow(numbered.select(row, text), run, _HITS), "hits"))
        sent.destroy()  # no executor holds two blocks
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # At most one row for each document and block that hits it.
    hits = every.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = numbered.join(hits.select(row, F.struct("first", "last", "items").alias(held)), row, "left").drop(row)
    return _merged(joined, text, held, documents.columns if keep is None else keep, prefix)


def _merged(joined: DataFrame, text: str, held: str, keep: list[str], prefix: str) -> DataFrame:
    """The columns of FOUND from the hits of all passes in column ``held``."""
    added = [T.StructField(prefix + f.name, f.dataType) for f in FOUND]
    fresh = {f.name.lower() for f in added}
    kept = [c for c in keep if c.lower() not in fresh]
    source = joined.select(*kept, F.col(text).alias(held + "text"), held)
    schema = T.StructType([source.schema[c] for c in kept] + added)

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(kept)):
                block = Block(part.column(len(kept)))
                words, hit, items = _search(block, None)
                for i, own in enumerate(part.column(len(kept) + 1).to_pylist()):
                    if own:
                        items[i].update(own["items"])
                        for x, y in zip(own["first"], own["last"], strict=True):
                            hit[words.first[i] + x : words.first[i] + y + 1] = True
                new = _report(block, words, hit, items)
                arrays = [a if isinstance(a := new[f.name], pa.Array) else pa.array(a) for f in FOUND]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + arrays, names=schema.names)

    return map_arrow(source, run, schema)


def remove_contamination(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", min_hit_share: float = 0.0, text: str = "text", **options) -> DataFrame:
    """``documents`` without contamination, with their own columns.

    ``mode="documents"`` drops each document of which more than ``min_hit_share``
    of the words are hit; ``mode="spans"`` keeps every document and cuts the hit
    byte spans out of its text.  Documents without hits come back unchanged.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    p = spare_prefix(documents)
    found = find_contamination(documents, benchmark, text=text, prefix=p, **options)
    if mode == "documents":
        share = F.col(p + "n_hit") > F.col(p + "n_words") * F.lit(float(min_hit_share))
        return found.where(~(F.col(p + "contaminated") & share)).select(*documents.columns)
    return found.withColumn(text, F.when(F.col(p + "contaminated"), without_spans(text, p + "hit_spans").cast("string")).otherwise(F.col(text))).select(*documents.columns)
