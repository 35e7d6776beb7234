"""Scalar functions as Column expressions (SC-*); the few that need Python are Arrow functions over whole batches."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that trimming removes.
BLANKS = " \n\r\t\f\x0b"


def trim(s: Column) -> Column:
    """SC-2."""
    return F.btrim(s, F.lit(BLANKS))


def ltrim(s: Column) -> Column:
    """SC-2."""
    return F.ltrim(s, F.lit(BLANKS))


def rtrim(s: Column) -> Column:
    """SC-2."""
    return F.rtrim(s, F.lit(BLANKS))


def split(s: Column, separator: str) -> Column:
    """SC-1: the parts between separators taken literally."""
    return F.split(s, "\\Q" + separator + "\\E")


def erase_all(s: Column, characters: str) -> Column:
    """SC-4."""
    return F.translate(s, characters, "")


def uri_encode(s: Column, keep_slash: bool = True) -> Column:
    """SC-5, LS-6: percent-encoding of all but letters, digits and ``-_.~``, and of the slash unless kept."""
    out = F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def equals_nocase(a: Column, b: Column) -> Column:
    """SC-6."""
    return F.lower(a) == F.lower(b)


def nocase_order(s: Column) -> list[Column]:
    """SC-6: sort keys that compare lengths first, then lower-cased text."""
    return [F.length(s), F.lower(s)]


def to_bool(s: Column) -> Column:
    """SC-7: true for ``true`` and ``1``, false for ``false`` and ``0``, null for anything else."""
    return F.when(F.lower(s).isin("true", "1"), True).when(F.lower(s).isin("false", "0"), False)


def to_int(s: Column) -> Column:
    """SC-7: a whole number, null for anything else."""
    return s.try_cast("bigint")


def parse_iso8601(s: Column, compat: str = "s3") -> Column:
    """SC-9: seconds since 1970 of ``YYYY-MM-DDThh:mm:ss`` with ``Z`` or an offset of whole hours; null for anything else.

    An offset is taken away from the local time; ``compat="reference"`` adds it.
    """
    form = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:Z|([+-])(\d{2}):00)$"
    part = lambda k: F.regexp_extract(s, form, k)
    local = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    hours = F.coalesce(part(4).try_cast("bigint"), F.lit(0))
    sign = F.when(part(3) == "-", -1).otherwise(1) * (1 if compat == "reference" else -1)
    ok = s.rlike(form) & (hours < 24) & (F.coalesce(F.substring(part(1), 1, 4).try_cast("int"), F.lit(9999)) < 2261)
    return F.when(ok, F.unix_seconds(local) + sign * hours * 3600)


def parse_compact(s: Column) -> Column:
    """SC-10: seconds since 1970 of ``YYYYMMDDThhmmssZ``; null for anything else."""
    form = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"
    spaced = F.regexp_replace(s, form, "$1-$2-$3 $4:$5:$6 +0000")
    return F.when(s.rlike(form), F.unix_seconds(F.try_to_timestamp(spaced, F.lit("yyyy-MM-dd HH:mm:ss Z"))))


def format_iso8601(seconds: Column) -> Column:
    """SC-11: ``YYYY-MM-DDThh:mm:ssZ``, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600).cast("bigint"), F.floor(rest / 60).cast("bigint") % 60, (rest % 60).cast("bigint"))
    return F.concat(F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), clock)


def format_imf(seconds: Column) -> Column:
    """SC-11: ``Mon, 01 Jan 2024 00:00:07 GMT``."""
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    clock = F.format_string(" %02d:%02d:%02d GMT", F.floor(rest / 3600).cast("bigint"), F.floor(rest / 60).cast("bigint") % 60, (rest % 60).cast("bigint"))
    return F.concat(F.date_format(F.date_from_unix_date(day), "EEE, dd MMM yyyy"), clock)


@F.pandas_udf(T.StringType())
def hmac_sha256(key: pd.Series, data: pd.Series) -> pd.Series:
    """SC-13: hexadecimal HMAC-SHA256 of text under a key in hexadecimal."""
    return pd.Series([hmac.new(bytes.fromhex(k), d.encode(), hashlib.sha256).hexdigest() if k is not None and d is not None else None for k, d in zip(key, data, strict=True)])


@functools.cache
def _sodium_scrypt():
    """libsodium's scrypt, which gives the same bytes in two thirds of the time; None where the library is not installed."""
    for name in ("libsodium.so.26", "libsodium.so.23"):
        try:
            library = ctypes.CDLL(name)
        except OSError:
            continue
        if library.sodium_init() >= 0:
            f = library.crypto_pwhash_scryptsalsa208sha256_ll
            f.argtypes = [ctypes.c_char_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_size_t, ctypes.c_uint64, ctypes.c_uint32, ctypes.c_uint32, ctypes.c_char_p, ctypes.c_size_t]
            return f
    return None


def scrypt(password: bytes, salt: bytes, fast: bool = True) -> bytes:
    """SC-14: N 16384, r 8, p 1, 32 bytes."""
    f = _sodium_scrypt() if fast else None
    out = ctypes.create_string_buffer(32)
    if f is not None and f(password, len(password), salt, len(salt), 16384, 8, 1, out, 32) == 0:
        return out.raw
    return hashlib.scrypt(password, salt=salt, n=16384, r=8, p=1, dklen=32)


@F.pandas_udf(T.StringType())
def scrypt_hash(password: pd.Series, salt: pd.Series) -> pd.Series:
    """SC-14: hexadecimal scrypt of a password under a salt in hexadecimal; slow on purpose."""
    return pd.Series([scrypt(p.encode(), bytes.fromhex(s)).hex() if p is not None and s is not None else None for p, s in zip(password, salt, strict=True)])


def signing_key(secret: Column, day: Column, region: Column, service: Column) -> Column:
    """SC-15: the key of signature version 4, in hexadecimal: four HMACs, one after the other."""
    first = F.lower(F.hex(F.concat(F.lit("AWS4"), secret).cast("binary")))
    key = hmac_sha256(first, day)
    for part in (region, service, F.lit("aws4_request")):
        key = hmac_sha256(key, part)
    return key


def canonical_request(method: Column, path: Column, query: Column, headers: Column, signed: Column, payload_sha256: Column) -> Column:
    """SC-15."""
    return F.concat_ws("\n", method, uri_encode(path), query, headers, F.lit(""), signed, payload_sha256)


def string_to_sign(at: Column, scope: Column, canonical: Column) -> Column:
    """SC-15."""
    return F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), at, scope, F.sha2(canonical, 256))


def build_arn(partition: Column, service: Column, region: Column, account: Column, resource: Column) -> Column:
    """SC-16."""
    return F.concat_ws(":", F.lit("arn"), partition, service, region, account, resource)


def parse_arn(arn: Column, compat: str = "s3") -> Column:
    """SC-16: the parts of an ARN; ``compat="reference"`` splits at semicolons."""
    return F.split(arn, ";" if compat == "reference" else ":")


def bucket_and_key(path: Column) -> tuple[Column, Column]:
    """SC-17: ``/bucket/key/with/slashes`` as bucket and key."""
    return F.regexp_extract(path, "^/?([^/?#]*)", 1), F.regexp_extract(path, "^/?[^/?#]*/([^?#]*)", 1)


def key_values(s: Column, pairs: str = "&", equals: str = "=") -> Column:
    """SC-18: ``a=1&b=2`` as a map."""
    return F.str_to_map(s, F.lit(pairs), F.lit(equals))


def div_ceil(a: str, b: int) -> Column:
    """SC-21."""
    return F.expr(f"({a} + {b - 1}) div {b}")


def align_up(a: str, b: int) -> Column:
    """SC-21."""
    return F.expr(f"(({a} + {b - 1}) div {b}) * {b}")


def wide_hex(high: str, low: str) -> Column:
    """SC-24: 128 bits as eight groups of four hexadecimal digits."""
    digits = F.expr(f"lower(concat(lpad(hex({high}), 16, '0'), lpad(hex({low}), 16, '0')))")
    return F.concat_ws(":", *(F.substring(digits, 4 * k + 1, 4) for k in range(8)))
