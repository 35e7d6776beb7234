"""Language identification (operator 7).

One interpolated Kneser-Ney character model for each language.  Letters, in lower
case, become one of 63 classes (a-z keep one each, others share the rest by
hash), and everything between letters becomes one blank, so an n-gram of order 4
is a number below 2**24 and a model has at most that many entries.  Counts come
from every text that may be learned from; each language's n-grams are stored as
sorted arrays of their 64-bit hashes.  A text belongs to the language with the
lowest cross-entropy for each character.

Rejection is calibrated on all texts the models were learned from: a text whose
cross-entropy lies above what all but a small share of its language's texts have,
with a margin that widens for short texts, is rejected, as is one without letters.
Of a language with few texts, whose own say little, the limit is at least that of
the texts of all languages together.

Defined cases: a null text, an empty one and one without letters get ``und`` with
score 0 and are rejected; rows with a null language or null id teach nothing; of
two languages equally likely the first in alphabetical order wins; without any
text to learn from every text is ``und``; an empty table gives an empty one.  Repeated
rows teach and are judged each by itself; a text counts and is judged whole, however
long.  New columns replace old ones of their names; ``keep_identified`` returns the
table's own columns as they were.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Block, map_arrow, mix64, slices, spare_prefix, with_text_columns

ORDER = 4
BITS = 6
CLASSES = 1 << BITS
UNKNOWN = "und"
#: Calibration counts texts by cross-entropy in steps of 1 / BINS bit.
BINS = 256
#: With fewer texts than this, no text of a language lies beyond the share that may be rejected.
FEW_TEXTS = 1000
SHARPNESS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
#: The share of a language's own texts that may lie beyond its limit, and the room left above it.
REJECTED_SHARE, ROOM_BITS, SHORT_TEXT_BITS = 0.001, 1.5, 12.0


def _class_table() -> np.ndarray:
    """The class of each code point below 65536: 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + int(mix64(np.array([low]))[0] % np.uint64(CLASSES - 27))
    return table


class Encoder:
    """Turns blocks into n-gram numbers."""

    def __init__(self):
        self.table = _class_table()

    def classes(self, points: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            out = out.copy()
            unique, back = np.unique(points[far], return_inverse=True)
            own = [27 + int(mix64(np.array([p]))[0] % np.uint64(CLASSES - 27)) if chr(int(p)).isalpha() else 0 for p in unique]
            out[far] = np.array(own, np.uint8)[back]
        return out

    def grams(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-gram that ends at each character, the bounds of each text among them, and each text's letters."""
        points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        head = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        starts, ends = head[block.starts], head[block.ends]
        if head[-1] != len(points):  # not UTF-8: decode text by text
            texts = [block.raw(i).decode("utf-8", "replace") for i in range(block.n)]
            sizes = np.array([len(t) for t in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            ends = np.cumsum(sizes)
            starts = ends - sizes
        c = self.classes(points)
        total = np.concatenate([[0], np.cumsum(c > 0)])
        letters = total[ends] - total[starts]
        # A blank after a blank goes, and a blank that begins a text.
        keep = c > 0
        if len(c):
            keep[1:] |= c[:-1] > 0
            keep[starts[(starts < ends)]] = c[starts[starts < ends]] > 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        first, last = kept[starts], kept[ends]
        sizes = last - first
        own = c[keep]
        # ORDER - 1 blanks stand before each text.
        pad = ORDER - 1
        at = np.arange(len(own)) + pad * (np.repeat(np.arange(block.n), sizes) + 1)
        line = np.zeros(len(own) + pad * block.n, np.int32)
        line[at] = own
        gram = line.copy()
        for k in range(1, ORDER):
            gram[k:] |= line[:-k] << (BITS * k)
        return gram[at], np.concatenate([[0], np.cumsum(sizes)]), letters


def count_grams(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all texts; each task sums its own before the shuffle."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])
    source = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        encoder = Encoder()
        held: dict[str, list] = {}

        def merged(parts):
            grams = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order]
            new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            return grams[new], np.add.reduceat(counts, new)

        for batch in batches:
            for part in slices(batch, 1):
                block = Block(part.column(1))
                grams, bounds, _ = encoder.grams(block)
                langs = part.column(0).to_pylist()
                sizes = np.diff(bounds)
                for name in set(langs):
                    mine = np.repeat(np.array([x == name for x in langs]), sizes)
                    if not mine.any():
                        continue
                    own = np.sort(grams[mine])
                    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    parts = held.setdefault(name, [])
                    parts.append((own[new], np.diff(np.append(new, len(own)))))
                    if len(parts) > 30:
                        held[name] = [merged(parts)]
        for name, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return map_arrow(source, run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hashed(grams: np.ndarray, order: int) -> np.ndarray:
    return mix64(grams.astype(np.uint64) | np.uint64(order << 32))


class KneserNey:
    """An interpolated model: for each order the share of each n-gram and the weight that its context leaves to the lower order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.shares: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(ORDER, 0, -1):
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
            contexts, back = np.unique(grams >> BITS, return_inverse=True)
            totals = np.bincount(back, weights=counts)
            kinds = np.bincount(back)
            self._store(self.shares, grams, np.maximum(counts - discount, 0) / totals[back], order)
            self._store(self.weights, contexts, discount * kinds / totals, order)
            # Below the highest order a gram counts once for each character seen before it.
            grams, counts = np.unique(grams & ((1 << (BITS * (order - 1))) - 1), return_counts=True)

    @staticmethod
    def _store(to: list, grams: np.ndarray, values: np.ndarray, order: int) -> None:
        hashes = _hashed(grams, order)
        sort = np.argsort(hashes)
        to.append((hashes[sort], values[sort].astype(np.float32)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], np.float32(missing))

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last class after the ones before."""
        p = np.full(len(grams), 1.0 / CLASSES)
        for order, share, weight in zip(range(1, ORDER + 1), self.shares[::-1], self.weights[::-1], strict=True):
            own = grams & ((1 << (BITS * order)) - 1)
            p = self._find(share, _hashed(own, order), 0.0) + self._find(weight, _hashed(own >> BITS, order), 1.0) * p
        return np.log2(p).astype(np.float32)


class Model:
    """The languages' models with what calibration found."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.limits = np.full(len(self.langs), np.inf)
        self.sharpness = 1.0

    def scorer(self):
        """A function of a block: bits in each language and characters of each text, and its letters."""
        encoder = Encoder()
        index = np.full(1 << (BITS * ORDER), -1, np.int32)  # rows of what was computed already
        rows = np.zeros((0, len(self.langs)), np.float32)

        def score(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal rows
            grams, bounds, letters = encoder.grams(block)
            if not self.models:
                return np.zeros((block.n, 0)), np.diff(bounds), letters
            at = index[grams]
            if (missing := at < 0).any():
                fresh = np.unique(grams[missing])
                index[fresh] = len(rows) + np.arange(len(fresh), dtype=np.int32)
                rows = np.concatenate([rows, np.stack([m.log2(fresh) for m in self.models], axis=1)])
                at = index[grams]
            sizes = np.diff(bounds)
            bits = np.zeros((block.n, len(self.langs)))
            full = np.flatnonzero(sizes)
            if len(full):
                for k in range(len(self.langs)):
                    bits[full, k] = -np.add.reduceat(rows[at, k].astype(np.float64), bounds[full])
            return bits, sizes, letters

        return score

    def decide(self, bits: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> dict:
        n = np.maximum(sizes, 1)
        if not self.langs:
            return {"lang_pred": [UNKNOWN] * len(n), "score": np.zeros(len(n)), "cross_entropy": np.zeros(len(n)), "rejected": np.ones(len(n), bool)}
        best = np.argmin(bits, axis=1)
        low = bits[np.arange(len(best)), best]
        known = letters > 0
        odds = np.exp2(-self.sharpness * (bits - low[:, None])).sum(axis=1)
        entropy = low / n
        far = entropy > self.limits[best] + ROOM_BITS + SHORT_TEXT_BITS / np.sqrt(n)
        return {
            "lang_pred": [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)],
            "score": np.where(known, 1 / odds, 0.0),
            "cross_entropy": np.where(known, entropy, 0.0),
            "rejected": ~known | far,
        }


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Models counted over all of ``documents`` and calibrated on all of them."""
    rows = count_grams(documents, text, lang).toArrow()  # at most 2**24 rows a language, whatever the corpus
    models = {}
    for name in sorted(pc.unique(rows.column("lang")).to_pylist()):
        own = rows.filter(pc.equal(rows.column("lang"), name))
        grams, counts = own.column("gram").to_numpy().astype(np.int64), own.column("n").to_numpy().astype(np.float64)
        sort = np.argsort(grams)
        models[name] = KneserNey(grams[sort], counts[sort])
    model = Model(models)
    if models:
        _calibrate(model, documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    return model


def _limit(bins: list[tuple[int, int]]) -> float:
    """The upper edge of the step below which all but REJECTED_SHARE of the texts lie, from (step, texts)."""
    rest = (1 - REJECTED_SHARE) * sum(n for _, n in bins)
    for step, n in sorted(bins):
        rest -= n
        if rest <= 0:
            break
    return (step + 1) / BINS


def _calibrate(model: Model, labelled: DataFrame) -> None:
    """Sets ``model``'s limits and sharpness from every text of ``labelled`` (lang, text)."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer()

        def bits(block: Block) -> dict:
            found, sizes, _ = score(block)
            return {"bits": pa.array(found.tolist(), pa.list_(pa.float64())), "n": sizes.astype(np.int64)}

        return bits

    seen = with_text_columns(labelled, "text", [T.StructField("bits", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())], make, ["lang"]).where("n > 0")
    order = F.array(*(F.lit(x) for x in model.langs))
    seen = seen.withColumn("own", F.get("bits", F.array_position(order, F.col("lang")).cast("int") - 1)).withColumn("low", F.array_min("bits"))
    step = F.floor((F.col("own") / F.col("n") - SHORT_TEXT_BITS / F.sqrt("n")) * BINS)

    def loss(sharpness: float) -> Column:
        """-ln of the share that a text's own language gets."""
        odds = F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.exp((F.col("low") - b) * (sharpness * math.log(2))))
        return F.log(odds) + (F.col("own") - F.col("low")) * (sharpness * math.log(2))

    # Some thousand steps a language at most, whatever the corpus.
    rows = seen.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("texts"), *(F.sum(loss(x)).alias(f"loss{k}") for k, x in enumerate(SHARPNESS))).collect()
    if not rows:
        return
    pooled = _limit([(r["step"], r["texts"]) for r in rows])
    for k, name in enumerate(model.langs):
        own = [(r["step"], r["texts"]) for r in rows if r["lang"] == name]
        few = sum(n for _, n in own) < FEW_TEXTS
        model.limits[k] = max(pooled, _limit(own) if own else pooled) if few else _limit(own)
    total, best = sum(r["texts"] for r in rows), np.inf
    for k, sharpness in enumerate(SHARPNESS):
        mean = sum(r[f"loss{k}"] for r in rows) / total
        if mean < best - 1e-9:
            best, model.sharpness = mean, sharpness


FOUND = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def identify(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``documents`` with lang_pred, score, cross_entropy (bits for each character) and rejected."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        score = own.scorer()
        return lambda block: own.decide(*score(block))

    return with_text_columns(documents, text, FOUND, make, keep, prefix)


def keep_identified(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` without those that the models reject, with their own columns."""
    prefix = spare_prefix(documents)
    return identify(documents, model, text, prefix=prefix).where(~F.col(prefix + "rejected")).select(*documents.columns)
