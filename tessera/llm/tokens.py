"""Token counts by offset-mapped attribution (operator 5).

A document is encoded once, whole.  The byte span of each token comes from the
lengths of the tokens' bytes, and an interval join deals tokens to the document's
sections.  The rule for a token that crosses a border: it belongs to the section
that holds most of its bytes, to the earlier one where they hold as many.  So
section counts add up to the document's count, and what a section would cost
encoded alone plays no part.

Sections are character spans [start, end) in order and without overlap; by
default they are the text's lines, each with its line feed.  Bytes outside all
sections form section -1.

Defined cases: a null or empty text has one section 0 from 0 to 0 without tokens,
as has a document with an empty or null list of sections if its text is empty too;
a section without characters gets no tokens; sections that reach beyond the text
end with it.  A text of any length and of any one character is encoded whole: where
long, it is cut where the pattern cuts it, since the tokenizer's own matcher runs out
of stack on long runs.  Repeated rows and rows of one id are counted each by itself;
columns of the table beside id, text and sections play no part, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Block, map_arrow, ship, slices

#: A vocabulary file of ranks (a token's bytes in base64, a blank, its id) and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of more characters are cut into the pattern's pieces before they are encoded.
LONG_TEXT = 20_000


class Encoder:
    """Whole texts to token ids, and the byte length of each id's token."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values(), default=0) + 1, np.int64)
        for token, i in table.items():
            self.lengths[i] = len(token)

        # The same pattern for a matcher that needs no stack; white space as the tokenizer's has it.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def ids(self, text: str) -> np.ndarray:
        """The text's tokens."""
        if len(text) <= LONG_TEXT:
            return np.asarray(self.encoding.encode_ordinary(text), np.int64)
        encode = self.encoding._core_bpe.encode_single_piece
        return np.fromiter((i for piece in self.pieces.finditer(text) for i in encode(piece.group().encode())), np.int64)

    def spans(self, text: str) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self.lengths[self.ids(text)])


def attribute(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and border-crossing tokens of each section, and tokens outside all; spans are in bytes."""
    count = np.zeros(len(starts_of), np.int64)
    crossing = np.zeros(len(starts_of), np.int64)
    if not len(ends):
        return count, crossing, 0
    live = np.flatnonzero(ends_of > starts_of)
    if not len(live):
        return count, crossing, len(ends)
    s, e = starts_of[live], ends_of[live]
    begins = np.concatenate([[0], ends[:-1]])
    # The interval join: sections first … last - 1 meet the token.
    first, last = np.searchsorted(e, begins, "right"), np.searchsorted(s, ends, "left")
    whole = (last - first == 1) & (s[np.minimum(first, len(s) - 1)] <= begins) & (ends <= e[np.minimum(first, len(s) - 1)])
    own = np.bincount(first[whole], minlength=len(live))
    cross = np.zeros(len(live), np.int64)
    outside = 0
    for i in np.flatnonzero(~whole).tolist():
        best, most = -1, 0
        for k in range(int(first[i]), int(last[i])):
            held = min(ends[i], e[k]) - max(begins[i], s[k])
            if held > most:
                best, most = k, held
        inside = sum(min(ends[i], e[k]) - max(begins[i], s[k]) for k in range(int(first[i]), int(last[i])))
        if best < 0 or ends[i] - begins[i] - inside > most:  # most of it lies outside all sections
            outside += 1
        else:
            own[best] += 1
            cross[best] += 1
    count[live], crossing[live] = own, cross
    return count, crossing, outside


def _lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends[:-1]]), ends


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file's bytes, read once by the driver; a vocabulary's size does not depend on the corpus."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """One row for each document and section: its span in characters and bytes, n_tokens, n_crossing and the document's doc_tokens."""
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((read_vocabulary(spark, vocabulary), pattern))
    given = F.transform(sections, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))) if sections else F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    source = documents.select(F.col(id), F.col(text).alias("__text"), given.alias("__sections"))
    names = [id, "section", "start_char", "end_char", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens"]
    kinds = [T.LongType()] * 6 + [T.LongType()] * 2
    schema = T.StructType([source.schema[id], T.StructField("section", T.IntegerType()), *(T.StructField(n, k) for n, k in zip(names[2:], kinds, strict=False))])

    def run(batches):
        encoder = Encoder(*sent.value)
        for batch in batches:
            for part in slices(batch, 1):
                block, rows, columns = Block(part.column(1)), [], [[] for _ in names[1:]]
                spans = part.column(2).to_pylist()
                for i in range(block.n):
                    raw = block.raw(i)
                    ends = encoder.spans(raw.decode("utf-8", "replace")) if raw else np.zeros(0, np.int64)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    if spans[i] is None:
                        s, e = _lines(raw)
                    else:
                        at = np.append(np.flatnonzero(np.diff(chars)), len(raw))  # the byte at which each character begins
                        cut = lambda x: at[np.clip(np.array(x, np.int64), 0, len(at) - 1)]  # noqa: B023, E731
                        s, e = cut([x["start"] for x in spans[i]]), cut([x["end"] for x in spans[i]])
                        if not len(s) and not raw:
                            s = e = np.zeros(1, np.int64)
                    count, crossing, outside = attribute(ends, s, e)
                    section = np.arange(len(s))
                    if outside:
                        section, count, crossing = np.append(section, -1), np.append(count, outside), np.append(crossing, 0)
                        s, e = np.append(s, 0), np.append(e, 0)
                    rows += [i] * len(section)
                    for to, x in zip(columns, (section, chars[s], chars[e], s, e, count, crossing, np.full(len(section), len(ends))), strict=True):
                        to.append(x)
                arrays = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *arrays], names=names)

    return map_arrow(source, run, schema)
