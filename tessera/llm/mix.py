"""Mixing sources to target weights by temperature (operator 10).

A source's weight is its share of all tokens to the power of an exponent between
1 (shares as they are) and 0 (all alike), normalised.  The exponent is found by
bisection: the largest that reaches a target entropy, raised again as far as the
repetition limit demands.  A budget of tokens then gives every source a quota.

The quota is realised by passes over the source, each in an order of its own by
hash; the last pass ends where the quota is met, with the document that meets it.
The passes form one line, which is cut into blocks of equal quotas, so that each
block holds every source at its weight; within a block a second hash gives the
order of training.

Without a budget the smallest is taken under which no source is used less than
once, so no document goes.

Defined cases: a null source is a source; a null or empty text counts as one
token, a very long one as what its bytes say; repeated rows are rows; rows equal in
id and text are interchangeable in ``mix``, and in ``mixed`` only rows equal in all
their columns are; an empty table gives an empty mix.  With token counts of one's own,
a null or negative count is none; a source without tokens has no weight: its rows
come once where no budget is given, else not at all.  A budget that no exponent can
spend within the repetition limit is an error.  Columns beside id, source and text
play no part in ``mix``, whatever their names, and come back as they are in ``mixed``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_offsets
from ._text import spare_prefix

TARGET_ENTROPY = 0.97
MAX_EPOCHS = 2.0
BLOCK_TOKENS = 1 << 20
STEPS = 50
PARTS_PER_MILLION = 1_000_000


class Plan(NamedTuple):
    """What was found: the exponent, the budget, and for each source its tokens, weight (ppm) and quota of tokens."""

    exponent: float
    budget: int
    sources: list[tuple[str | None, int, int, int]]


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the token shares."""
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    return [x / sum(raised) for x in raised]


def normal_entropy(w: list[float]) -> float:
    """The entropy as a share of the largest possible; 1 for a single source."""
    return -sum(x * math.log(x) for x in w if x > 0) / math.log(len(w)) if len(w) > 1 else 1.0


def passes(tokens: list[int], w: list[float], budget: int | None) -> float:
    """How often the source most repeated is used."""
    rates = [x / t for x, t in zip(w, tokens, strict=True)]
    return max(rates) / min(rates) if budget is None else max(rates) * budget


def _bisect(holds, steps: int = STEPS) -> float:
    """The largest exponent of 0 … 1 for which ``holds`` (true at 0 or nowhere, and true below where it is true)."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def plan(totals: list[tuple[str | None, int]], target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> Plan:
    """The exponent that meets the target entropy, unless the repetition limit asks for a larger one."""
    empty = [(s, t, 0, 0) for s, t in totals if t <= 0]
    totals = [(s, t) for s, t in totals if t > 0]
    if not totals:
        return Plan(1.0, budget or 0, empty)
    tokens = [t for _, t in totals]
    if budget is not None and passes(tokens, weights(tokens, 1.0), budget) > max_epochs * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens repeats {sum(tokens)} tokens more than {max_epochs} times, whatever the weights")
    entropy = _bisect(lambda x: normal_entropy(weights(tokens, x)) >= target_entropy)
    # The more alike the weights, the more often small sources come: the smallest exponent within the limit.
    limit = 1 - _bisect(lambda y: passes(tokens, weights(tokens, 1 - y), budget) <= max_epochs)
    exponent = round(max(entropy, limit), 6)
    w = [max(1, round(x * PARTS_PER_MILLION)) for x in weights(tokens, exponent)]
    if budget is None:
        budget = max(-(-t * PARTS_PER_MILLION // x) for t, x in zip(tokens, w, strict=True))
        quotas = [max(t, budget * x // PARTS_PER_MILLION) for t, x in zip(tokens, w, strict=True)]
    else:
        # Rounded weights may not carry a source beyond the limit.
        quotas = [min(budget * x // PARTS_PER_MILLION, math.floor(t * max_epochs)) for t, x in zip(tokens, w, strict=True)]
    return Plan(exponent, budget, [(s, t, x, q) for (s, t), x, q in zip(totals, w, quotas, strict=True)] + empty)


def token_estimate(text: str) -> Column:
    """A token for every four bytes begun, one at least."""
    return F.expr(f"greatest(1L, bigint((coalesce(octet_length(`{text}`), 0) + 3) div 4))")


def _uses(documents: DataFrame, id: str, source: str, text: str, keys: list[Column], tokens: Column | None, target_entropy: float, max_epochs: float, budget: int | None, block_tokens: int, seed: int) -> tuple[DataFrame, Plan]:
    """A row for each use: id, source, crc, n_tokens, epoch, block, order_key, and ``keys`` as k0, k1 …"""
    count = token_estimate(text) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    rows = documents.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), count.alias("n_tokens"), crc.alias("crc"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    totals = sorted(((r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()), key=lambda x: (x[0] is None, x[0]))
    found = plan(totals, target_entropy, max_epochs, budget)
    spark = documents.sparkSession
    once = int(budget is None)  # passes of a source without tokens
    quota = spark.createDataFrame(
        [(s, t, max(1, w * block_tokens // PARTS_PER_MILLION), *((q // t, q % t) if t else (once, 0))) for s, t, w, q in found.sources], "s string, total long, in_block long, full long, rest long"
    )
    known = rows.join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("s")))  # a row for each source
    uses = known.where("full > 0 OR rest > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, if(rest > 0, full, full - 1))")))
    uses = uses.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    placed = with_offsets(uses, ["source", "epoch", "key", "crc"], "n_tokens", by=["source", "epoch"])
    kept = placed.where("epoch < full OR offset < rest").withColumn("block", F.expr("(epoch * total + offset) div in_block"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}:block"), F.col("block").cast("string"), F.col("key")))
    return kept.withColumn("order_key", order), found


def mix(
    documents: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokens: Column | None = None,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> tuple[DataFrame, Plan]:
    """One row for each use of a document: id, source, n_tokens, epoch, block, order_key and text_crc32, and the plan behind it.

    Sort by (block, order_key, id) for the order of training.  Sums of tokens for
    each source are the only rows that reach the driver.
    """
    kept, found = _uses(documents, id, source, text, [], tokens, target_entropy, max_epochs, budget, block_tokens, seed)
    return kept.select(F.col("id").alias(id), F.col("source").alias(source), "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", "order_key", F.col("crc").alias("text_crc32")), found


def _row_keys(documents: DataFrame) -> list[Column]:
    """128 bits that tell rows with other values in any column apart."""
    every = [F.to_json(f"`{n}`") if k.startswith("map") else F.col(f"`{n}`") for n, k in documents.dtypes]
    # A null changes no hash, so where nulls stand is hashed too.
    where = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in every))
    return [F.xxhash64(F.lit(k), where, *every) for k in (1, 2)]


def mixed(
    documents: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokens: Column | None = None,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """``documents`` as often as the mix uses each row, with their own columns.

    Rows find their uses by a key of all their columns, so only rows equal in every
    column stand for one another; texts are shuffled once, by that key.
    """
    keys, p = _row_keys(documents), spare_prefix(documents)
    uses, _ = _uses(documents, id, source, text, keys, tokens, target_entropy, max_epochs, budget, block_tokens, seed)
    own = [p + "k0", p + "k1"]
    times = uses.groupBy(F.col("k0").alias(own[0]), F.col("k1").alias(own[1])).agg(F.count(F.lit(1)).alias(p + "uses"))
    # Equal rows fold before the shuffle: one of them stands for all their uses.
    one = documents.withColumns(dict(zip(own, keys, strict=True))).dropDuplicates(own)
    return one.join(times, own).withColumn(p + "use", F.explode(F.sequence(F.lit(1).cast("long"), F.col(p + "uses")))).select(*documents.columns)
