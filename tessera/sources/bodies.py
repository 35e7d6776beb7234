"""Request bodies: plain, chunked and chunk-signed, as binary columns (SRC-1 … SRC-5)."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a signed chunk's string to sign begins with.
CHUNK_ALGORITHM = "AWS4-HMAC-SHA256-PAYLOAD"


def read_bodies(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-1: whole files as (path, length, content)."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def string_bodies(spark: SparkSession, bodies: dict[str, str]) -> DataFrame:
    """SRC-5."""
    return spark.createDataFrame([(k, v.encode()) for k, v in bodies.items()], "path string, content binary")


def content_length_ok(content: Column, declared: Column) -> Column:
    """SRC-1: a body has the length that its header declares."""
    return F.octet_length(content) == declared


def sha256_ok(content: Column, header: Column) -> Column:
    """SRC-4."""
    return F.sha2(content, 256) == F.lower(header)


def _chunks(raw: bytes):
    """(extension, data) of each chunk up to the last; ValueError where the framing is wrong."""
    at = 0
    while True:
        end = raw.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size")
        size, _, extension = raw[at:end].partition(b";")
        n = int(size, 16)
        data = raw[end + 2 : end + 2 + n]
        yield extension, data
        if n == 0:
            # Trailers, if any, end at an empty line.
            if raw[end + 2 : end + 4] != b"\r\n" and raw.find(b"\r\n\r\n", end + 2) < 0:
                raise ValueError("a cut trailer")
            return
        if len(data) < n or raw[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a cut chunk")
        at = end + 4 + n


def _decode(raw: bytes | None) -> bytes | None:
    if raw is None:
        return None
    try:
        return b"".join(data for _, data in _chunks(bytes(raw)))
    except ValueError:
        return None


@F.pandas_udf(T.BinaryType())
def decode_chunked(content: pd.Series) -> pd.Series:
    """SRC-2: the data of a chunked body, without extensions and trailers; null where the framing is wrong."""
    return content.map(_decode)


def sign_chunk(key: bytes, at: str, scope: str, previous: str, data: bytes) -> str:
    """A chunk's signature, which takes in the one before."""
    text = "\n".join([CHUNK_ALGORITHM, at, scope, previous, hashlib.sha256(b"").hexdigest(), hashlib.sha256(data).hexdigest()])
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def encode_signed(key: bytes, at: str, scope: str, seed: str, chunks: list[bytes]) -> bytes:
    """A chunk-signed body, for tests and for writers."""
    out, previous = b"", seed
    for data in [*chunks, b""]:
        previous = sign_chunk(key, at, scope, previous, data)
        out += b"%x;chunk-signature=%s\r\n%s\r\n" % (len(data), previous.encode(), data)
    return out


def verify_signed(key_hex: str, at: str, scope: str):
    """SRC-3: a function of (content, seed signature): whether every chunk's signature follows from the one before."""
    key = bytes.fromhex(key_hex)

    def one(raw: bytes | None, seed: str | None) -> bool | None:
        if raw is None or seed is None:
            return None
        previous = seed
        try:
            for extension, data in _chunks(bytes(raw)):
                previous = sign_chunk(key, at, scope, previous, data)
                if extension != b"chunk-signature=" + previous.encode():
                    return False
        except ValueError:
            return False
        return True

    @F.pandas_udf(T.BooleanType())
    def verify(content: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([one(c, s) for c, s in zip(content, seed, strict=True)])

    return verify
