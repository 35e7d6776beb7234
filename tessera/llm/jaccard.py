"""N-gram Jaccard join with Bayesian candidate pruning (operator 3).

Texts become sets of five-word shingles (64-bit hashes); rows of equal sets are one
node that knows how many rows it stands for.  A node's number is a 64-bit hash of its
set; a second one tells when two sets share a number, and these go by the second.
MinHash signatures are cut into bands, and nodes that share a band's bucket are
candidates: a pair of similarity 0.8 meets in no bucket with a probability below
4e-6.  A candidate pair's MinHash values are compared some at a time.  It goes as soon
as the posterior probability of reaching the threshold falls below the tolerance, and
also once it agrees in a band before the bucket's own, for then it is looked at there.
What is left is verified on the shingles.

Copies are never expanded: a group of any number of equal sets is one node.  Large
buckets are dealt into pairs of blocks.  A pair of different sets that survives is an
entry of a list, as its link must be counted; verification, again in pairs of blocks,
gives sums of links for each node and a spanning star of each linked group.

Defined cases: a text of fewer than five words, but not none, is one shingle; a
text without words (or null) is a class of its own without links, as is a row
with a null id; repeated rows are copies of one another; a text of any length is
one set; an empty table gives no rows.  Ids are of any type that can be ordered.
Columns beside id and text play no part, whatever their names, and come back as they
are from ``keep_first``.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import materialize, scratch
from ._text import Block, Words, map_arrow, mix64, slices, spare_prefix, whole_groups, window_hashes
from .components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = Fraction(4, 5)
TOLERANCE = 1e-6
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: MinHash values compared before the posterior is looked at again.
STEP = 20
#: Nodes of a block, and shingles of a block to verify; what is larger is dealt into pairs of blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21

_random = np.random.default_rng(20240501)
_FLIP = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_FACTOR = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32)[:, None] << np.uint32(1)) | np.uint32(1)


def shingle_sets(block: Block, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(block)
    hashes = words.hashes()
    runs = window_hashes(hashes, width)
    out = []
    for i in range(block.n):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray, seed: int = 0) -> int | None:
    """The number of a set, or with another seed its second one; none for the empty set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - (1 << 63) if len(shingles) else None


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low halves of MinHash values under ``HASHES`` random orders."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = (x[None, at : at + 2048] ^ _FLIP) * _FACTOR
        low = np.minimum(low, v.min(axis=1))
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(n, m): after n values, a pair with fewer than m matches has a posterior below ``tolerance``.

    With a uniform prior the posterior of m matches in n is Beta(m + 1, n - m + 1),
    which exceeds t with the probability that n + 1 trials at t succeed m times at most.
    """
    t = float(threshold)
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _describe(documents: DataFrame, id: str, text: str) -> DataFrame:
    """Each row's id, text hash, set (null without words) by both numbers, shingles and signature."""
    source = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("__text"))
    schema = T.StructType([source.schema["id"], *(T.StructField(n, T.LongType()) for n in ("text_hash", "node", "second", "n")), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(Block(part.column(2)))
                nodes, second = ([node_of(s, seed) for s in sets] for seed in (0, 1))
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(second, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], names=schema.names)

    return map_arrow(source, run, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, band, bucket) for each band."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            for k in range(ROWS):
                h = mix64(h ^ (sig[:, :, k].astype(np.uint64) + np.uint64(k << 20)))
            flat = pa.array(h.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS), pa.int32()), flat)], names=schema.names)

    return map_arrow(nodes.select("node", "sig"), run, schema).select("node", F.posexplode("buckets").alias("band", "bucket"))


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs (i < j) within consecutive groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    reps = within  # row k of a group pairs with the k rows before it
    j = np.repeat(np.arange(len(within)), reps)
    i = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(np.repeat(starts, sizes), reps)
    return i, j


def _prune(sig: np.ndarray, sizes: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[tuple[int, int]], threshold: Fraction) -> np.ndarray:
    """Which candidate pairs are this bucket's own and may still reach the threshold."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    live = np.flatnonzero(small * threshold.denominator >= large * threshold.numerator)
    matches = np.zeros(len(live), np.int64)
    done = 0
    for n, least in limits:  # whole bands at a time
        same = sig[i[live], done:n] == sig[j[live], done:n]
        matches += same.sum(axis=1)
        # A pair belongs to the first band in which it agrees.
        before = np.arange(done // ROWS, n // ROWS)[None, :] < band[i[live], None]
        earlier = (same.reshape(len(live), (n - done) // ROWS, ROWS).all(axis=2) & before).any(axis=1)
        keep = (matches >= least) & ~earlier
        live, matches = live[keep], matches[keep]
        done = n
    return live


def _candidates(members: DataFrame, limits: list[tuple[int, int]], threshold: Fraction) -> DataFrame:
    """Surviving pairs as lists (g1, g2, left, right); g1 and g2 are the nodes' blocks."""
    schema = T.StructType([T.StructField("g1", T.LongType()), T.StructField("g2", T.LongType()), T.StructField("left", T.ArrayType(T.LongType())), T.StructField("right", T.ArrayType(T.LongType()))])
    budget = 1 << 18  # pairs at a time

    def run(batches):
        for table, starts in whole_groups(batches, 3):
            n = table.num_rows
            node, block, size = (table.column(k).to_numpy() for k in (4, 5, 6))
            side = table.column(3).to_numpy()
            sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(n, HASHES)
            group_sizes = np.diff(np.append(starts, n))
            same_block = (table.column(1).to_numpy() == table.column(2).to_numpy())[starts]
            found_i, found_j = [], []

            def look(i, j):
                for at in range(0, len(i), budget):
                    a, b = i[at : at + budget], j[at : at + budget]
                    keep = _prune(sig, size, band, a, b, limits, threshold)
                    found_i.append(a[keep])
                    found_j.append(b[keep])

            band = table.column(8).to_numpy()
            # Groups of one block: all pairs; small ones together.
            ends = np.cumsum(np.where(same_block, group_sizes * (group_sizes - 1) // 2, 0))
            own = np.flatnonzero(same_block)
            at = 0
            while at < len(own):
                base = ends[own[at]] - group_sizes[own[at]] * (group_sizes[own[at]] - 1) // 2
                to = max(at + 1, int(np.searchsorted(ends[own], base + budget, "right")))
                chosen = own[at:to]
                rows = np.concatenate([np.arange(starts[g], starts[g] + group_sizes[g]) for g in chosen])
                i, j = _pairs_within(group_sizes[chosen])
                look(rows[i], rows[j])
                at = to
            # Groups of two blocks: one side with the other.
            for g in np.flatnonzero(~same_block):
                rows = np.arange(starts[g], starts[g] + group_sizes[g])
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                per = max(1, budget // max(1, len(right)))
                for k in range(0, len(left), per):
                    part = left[k : k + per]
                    look(np.repeat(part, len(right)), np.tile(right, len(part)))
            i = np.concatenate(found_i) if found_i else np.zeros(0, np.int64)
            j = np.concatenate(found_j) if found_j else np.zeros(0, np.int64)
            if not len(i):
                continue
            swap = (block[i] > block[j]) | ((block[i] == block[j]) & (node[i] > node[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((block[j], block[i]))
            i, j = i[order], j[order]
            g1, g2 = block[i], block[j]
            new = np.flatnonzero(np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]))
            bounds = np.append(new, len(i))
            # A row for each pair of blocks, its pairs in pieces of bounded length.
            cuts = np.unique(np.concatenate([bounds, np.arange(0, len(i), budget)]))
            at = pa.array(cuts, pa.int32())
            first = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(g1[first]), pa.array(g2[first]), pa.ListArray.from_arrays(at, pa.array(node[i])), pa.ListArray.from_arrays(at, pa.array(node[j]))], names=schema.names)

    return map_arrow(members, run, schema)


def _members(lists: DataFrame) -> DataFrame:
    """(g1, g2, node): each node of a block pair's lists once.  Lists are merged before there is a row for each node."""
    schema = T.StructType([T.StructField("g1", T.LongType()), T.StructField("g2", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches):
        now, held = None, np.zeros(0, np.int64)
        for batch in batches:
            found = [[], [], []]

            def put():
                for to, x in zip(found, (np.full(len(held), now[0]), np.full(len(held), now[1]), held), strict=True):  # noqa: B023
                    to.append(x)

            for g1, g2, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own = np.unique(np.concatenate([left.values.to_numpy(), right.values.to_numpy()]))
                if now == (g1, g2):
                    held = np.union1d(held, own)
                    continue
                if now is not None:
                    put()
                now, held = (g1, g2), own
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=schema.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), now[0])), pa.array(np.full(len(held), now[1])), pa.array(held)], names=schema.names)

    return map_arrow(lists.select("g1", "g2", "left", "right").repartition("g1", "g2").sortWithinPartitions("g1", "g2"), run, schema)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|sets[i] & sets[j]| for each pair."""
    if len(i) < 2 * len(sets):
        out = np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out[k] = int((y[at] == x).sum())
        return out
    # Many pairs: a 0/1 matrix over the shingles that several sets hold, some columns at a time.
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    counts = np.bincount(column)
    common = counts > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (1 << 23) // len(sets))
    for at in range(0, int(common.sum()), width):
        mine = (column >= at) & (column < at + width)
        m = np.zeros((len(sets), min(width, int(common.sum()) - at)), np.float32)
        m[owner[mine], column[mine] - at] = 1
        total += m @ m.T
    return np.rint(total[i, j]).astype(np.int64)


def _verify(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, links, centre): what each node's verified partners of one group stand for, and the smallest node it hangs together with there."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("centre", T.LongType())])

    def run(batches):
        for table, starts in whole_groups(batches, 2):
            kind = table.column(2).to_numpy()
            node, copies = (table.column(k).fill_null(0).to_numpy() for k in (3, 4))
            ends = np.append(starts[1:], table.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                n = int((kind[s:e] == 0).sum())
                texts = table.slice(s, n).column(5)
                sets = []
                for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
                    sets += shingle_sets(Block(part.column(0)))
                # Rows of one id may hold other texts, or the same again: one row a node, the right one.
                held: dict[int, int] = {}
                for k, x in enumerate(node[s : s + n].tolist()):
                    if x not in held and x in (node_of(sets[k]), node_of(sets[k], 1)):
                        held[x] = k
                chosen = np.array(sorted(held.values(), key=lambda k: node[s + k]), np.int64)
                names, weight = node[s + chosen], copies[s + chosen].astype(np.int64)
                sets = [sets[k] for k in chosen]
                a, b = (np.searchsorted(names, table.column(k).slice(s + n, e - s - n).flatten().to_numpy()) for k in (6, 7))
                common = _intersections(sets, a, b)
                length = np.array([len(x) for x in sets])
                p, q = threshold.numerator, threshold.denominator
                linked = common * (p + q) >= p * (length[a] + length[b])
                a, b = a[linked], b[linked]
                if not len(a):
                    continue
                links = np.bincount(a, weight[b], len(names)) + np.bincount(b, weight[a], len(names))
                label = np.arange(len(names))
                while True:  # the smallest number spreads along links
                    before = label.copy()
                    np.minimum.at(label, a, label[b])
                    np.minimum.at(label, b, label[a])
                    label = label[label]
                    if (label == before).all():
                        break
                mine = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array(links[mine].astype(np.int64)), pa.array(names[label[mine]])], names=schema.names)

    return map_arrow(rows, run, schema)


def jaccard_classes(documents: DataFrame, id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``documents``: id, class_id, n_links and text_hash.

    n_links counts the other rows of similarity ``threshold`` or more; class_id is
    the smallest id among all that links connect.
    """
    return _labelled(documents, id, text, threshold, tolerance, block).drop("__label")


def _nodes(rows: DataFrame) -> DataFrame:
    """Each set once: its smallest id, rows, shingles and signature, and the least and the largest of its second numbers."""
    own = rows.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node")
    return own.agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.min("second").alias("second0"), F.max("second").alias("second1"))


def _labelled(documents: DataFrame, id: str, text: str, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """jaccard_classes with ``__label``: one number for each class, also where classes share an id; null without shingles."""
    with scratch() as kept:
        kept.append(materialize(_classes(documents, id, text, threshold, tolerance, block), "classes"))
    return kept[0]


def _classes(documents: DataFrame, id: str, text: str, threshold: Fraction, tolerance: float, block: int) -> DataFrame:
    rows = materialize(_describe(documents, id, text), "shingled")
    nodes = materialize(_nodes(rows), "nodes")
    shared = nodes.where("second0 <> second1").select("node")
    if not shared.isEmpty():  # two sets of one number: about one such number for each 2**32 sets squared
        apart = shared.withColumn("shared", F.lit(True))
        rows = materialize(rows.join(apart, "node", "left").withColumn("node", F.when(F.col("shared"), F.col("second")).otherwise(F.col("node"))).drop("shared"), "shingled")
        nodes = materialize(_nodes(rows), "nodes")

    hits = _buckets(nodes)
    shared = hits.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(hits.join(shared, "bucket"), "members")
    # A node's home, among all its buckets, is the one with the smallest number: nodes of one crowd share few homes.
    home = members.groupBy("node").agg(F.min("bucket").alias("home")).join(nodes.select("node", "n", "sig"), "node")
    crowd = home.groupBy("home").agg(F.expr(f"greatest(ceil(count(1) / {block}), ceil(sum(n) / {BLOCK_SHINGLES}))").alias("blocks"))
    known = home.join(crowd, "home").select("node", F.xxhash64("home", F.expr("pmod(xxhash64(node), blocks)")).alias("block"), "n", "sig")
    # A node has a row for each of its bands until it has its signature, and only then for each pair of blocks.
    parts = members.join(known, "node").withColumn("blocks", F.expr(f"ceil(size / {block})")).withColumn("mine", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = parts.select("bucket", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), F.expr("int(mine > other)").alias("side"), "node", "block", "n", "sig", "band")
    limits = least_matches(threshold, tolerance)
    grouped = dealt.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
    found = materialize(_candidates(grouped, limits, threshold), "candidates")

    needed = _members(found).join(nodes.select("node", "first_id", "copies"), "node")
    texts = documents.select(F.col(id).alias("first_id"), F.col(text).alias("text"))
    none = F.lit(None).cast("array<bigint>")
    sets = needed.join(texts, "first_id").select("g1", "g2", F.lit(0).alias("kind"), "node", "copies", "text", none.alias("left"), none.alias("right"))
    lists = found.select("g1", "g2", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("string").alias("text"), "left", "right")
    verified = materialize(_verify(sets.unionByName(lists).repartition("g1", "g2").sortWithinPartitions("g1", "g2", "kind"), threshold), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(verified.where("node <> centre"), "node", "centre")
    joined = nodes.select("node", "first_id", "copies").join(links, "node").join(labels, "node")
    first = joined.groupBy("label").agg(F.min("first_id").alias("class_first"))
    linked = joined.join(first, "label").select("node", "links", "class_first", "label")
    known = nodes.select("node", "first_id", "copies").join(linked, "node", "left").select("node", "copies", F.coalesce("class_first", "first_id").alias("class_first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("label", "node").alias("label"))
    known = materialize(known, "known")
    own = rows.select("id", "text_hash", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    # A node with more than a quarter of a partition's rows is hot; there are at most four for each partition, so these
    # are broadcast, and their rows meet them where they are.  All other rows are dealt by node.
    share = rows.count() // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    hot = F.broadcast(known.where(F.col("copies") > share))
    cold = own.join(hot.select("node"), "node", "left_anti").join(known.where(F.col("copies") <= share), "node", "left")
    return own.join(hot, "node").unionByName(cold).select(F.col("id").alias(id), F.coalesce("class_first", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "text_hash", F.col("label").alias("__label"))


def keep_first(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that with the smallest id, with all columns; rows with a null id stay."""
    p = spare_prefix(documents)
    classes = _labelled(documents, id, text, **options).select(F.col(id).alias("id"), "text_hash", "__label").where("id IS NOT NULL")
    # Texts without shingles have no links: each id and text of theirs is a class.
    alone = F.when(F.col("__label").isNull(), F.struct("id", "text_hash"))
    first = classes.groupBy("__label", alone.alias("alone")).agg(F.min(F.struct("id", "text_hash")).alias("first")).select(F.col("first.id").alias(p + "id"), F.col("first.text_hash").alias(p + "hash"))
    marked = documents.withColumn(p + "hash", F.xxhash64(F.col(text))).withColumn(p + "id", F.col(id))
    # A row repeated as it is has the same id and text hash: one of it stays.
    own = [p + "id", p + "hash"]
    kept = marked.join(first.distinct(), own, "left_semi").dropDuplicates(own)
    return kept.select(*documents.columns).unionByName(documents.where(F.col(id).isNull()))
