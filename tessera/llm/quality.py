"""Compression quality classifier (operator 1).

Two Zstandard dictionaries are built, from good and from bad labelled texts.  A
whole text is cut into pieces, each compressed with either dictionary.  The
difference of the summed sizes, normalised by the text's own size, tells which kind of
text it resembles: it is near nothing for one that shrinks to nothing with either.  A
logistic curve fitted on other labelled texts turns it into the probability of a good
text.  Every byte counts, and pieces keep long texts from outgrowing the dictionaries.

Defined cases: a null or empty text has no pieces and gets the share of good
labels; without labels of both kinds every score is that share (1 without any); a text
of any length is scored whole; equal texts have equal scores, so ties and repeated rows
are scored each by itself; an empty table gives no rows.  Of several labels of an id
the largest holds; null ids and labels teach nothing.  New columns replace old ones of
their names, others stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._labels import labelled_sample, logistic
from ._text import Block, with_text_columns

#: The bounds of the sample to learn from: texts of each label, and characters of a text.
PER_CLASS, MAX_CHARS = 800, 30_000
PIECE_BYTES = 256
DICTIONARY_BYTES = 256 * 1024
LEVEL = 3


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the texts' own end."""
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


class Sizes:
    """Compressed size of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))

    def normalised(self, raw: bytes) -> float:
        """By how much of its size the text shrinks more with the bad dictionary than with the good one."""
        pieces = _pieces(raw)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.compressors)
        return (good - bad) / len(raw)


class QualityModel:
    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float, prior: float):
        self.good, self.bad, self.slope, self.shift, self.prior = good, bad, slope, shift, prior

    def scorer(self):
        if not self.good or not self.bad:
            return lambda raw: self.prior
        sizes = Sizes(self.good, self.bad)

        def score(raw: bytes) -> float:
            if not raw:
                return self.prior
            at = self.shift + self.slope * sizes.normalised(raw)
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, at))))

        return score


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, **columns) -> QualityModel:
    """Dictionaries from every other sampled text, the curve from the rest, at the labels' own shares."""
    rows, (n_bad, n_good) = labelled_sample(documents, labels, label, per_class, max_chars, **columns)
    prior = n_good / (n_good + n_bad) if n_good + n_bad else 1.0
    texts = {k: [t.encode() for t, y in rows if y == k] for k in (0, 1)}
    if min(len(t) for t in texts.values()) < 2:
        return QualityModel(b"", b"", 0.0, 0.0, prior)
    good, bad = (build_dictionary(texts[k][::2]) for k in (1, 0))
    sizes = Sizes(good, bad)
    x = np.array([sizes.normalised(t) for k in (0, 1) for t in texts[k][1::2]])
    y = np.repeat([0, 1], [len(texts[0][1::2]), len(texts[1][1::2])])
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    (slope,), shift = logistic(x, y, weight)
    return QualityModel(good, bad, slope, shift, prior)


def score(documents: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``documents`` with the score of each whole text and whether it reaches ``threshold``; one pass, no shuffle."""
    parts = (model.good, model.bad, model.slope, model.shift, model.prior)
    sent = documents.sparkSession.sparkContext.broadcast(parts)

    def make():
        one = QualityModel(*sent.value).scorer()

        def run(block: Block) -> dict:
            found = np.array([one(block.raw(i)) for i in range(block.n)], float)
            return {"score": found, "predicted": (found >= threshold).astype(np.int32)}

        return run

    return with_text_columns(documents, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
