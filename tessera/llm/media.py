"""Media columns (operator 6): Netpbm and BMP images to numpy, area-resized tiles and difference hashes.

Resizing averages over areas: the integral image is read at fractional borders,
so each target pixel is the exact mean of what it covers, for larger and smaller
targets alike.  Tiles are NPY bytes.

A text becomes an image 64 samples wide, one sample a byte, padded with zeros: a BMP
where the CRC-32 of the padded text is odd, else a binary PGM, so that equal texts are
stored alike and both formats are met.

Defined cases: null bytes give null tile and hash; bytes that are no image of these
formats, or a cut one, or a kind of BMP beyond those named in ``decode_bmp``, give nulls
and the reason in ``error``; a null or empty text is stored as 64 zeros; a text of any
length is one image; repeated rows are stored each by itself, and alike; an empty table
gives no rows.  New columns replace old ones of their names, others stay as they are.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import Block, with_text_columns

TILE = 32
HASH_ROWS, HASH_COLUMNS = 8, 9
PAYLOAD_UNIT = 64


def _netpbm_header(raw: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, and where the samples begin; # comments run to the line's end."""
    at, found = 2, []
    while len(found) < count:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            if raw[at : at + 1] == b"#":
                while at < len(raw) and raw[at] != 10:
                    at += 1
            else:
                at += 1
        end = at
        while end < len(raw) and 48 <= raw[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("cut or malformed Netpbm header")
        found.append(int(raw[at:end]))
        at = end
    return found, at


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1-P6 as an array (height, width) or (height, width, 3) of uint8, or uint16 where maxval is over 255.

    Samples of another maxval than 255 or 65535 are scaled, to the nearest, so that white is white.
    """
    kind = raw[1] - 48
    (width, height, *rest), at = _netpbm_header(raw, 2 if kind in (1, 4) else 3)
    top = rest[0] if rest else 1
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if not 0 < top < 65536:
        raise ValueError("maxval out of range")
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in raw[at:].split(b"\n"))
        values = np.array(list(body.translate(None, b" \t\r\n\v\f")), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.int64)
        if len(values) < n:
            raise ValueError("cut samples")
        out = values[:n].reshape(shape)
    elif kind == 4:
        rows = np.frombuffer(raw, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = np.unpackbits(rows, axis=1)[:, :width]
    else:
        out = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, at + 1).reshape(shape)
    if kind in (1, 4):
        return ((1 - out) * 255).astype(np.uint8)  # 1 is black
    white = 65535 if top > 255 else 255
    if n and int(out.max()) > top:
        raise ValueError("sample beyond maxval")
    scaled = out if top == white else (out.astype(np.int64) * (2 * white) + top) // (2 * top)
    return scaled.astype(np.uint16 if top > 255 else np.uint8)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The channel of a colour mask on the scale of 0 to 255, to the nearest; without a mask, none of it."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    if top & (top + 1):
        raise ValueError("BMP mask with gaps")
    return ((510 * ((pixels & mask) >> low) + top) // (2 * top)).astype(np.uint8)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 1-, 4-, 8-, 16-, 24- and 32-bit BMP, 16 and 32 bits also with colour masks; a grey palette gives grey."""
    begin, header = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    if header < 40:
        raise ValueError("BMP header of an unknown size")
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 3 and bits not in (16, 32)) or width <= 0 or height == 0:
        raise ValueError("BMP of an unknown kind")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    body = np.frombuffer(raw, np.uint8, rows * stride, begin).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits in (16, 32) and (packing == 3 or bits == 16):
        masks = struct.unpack_from("<III", raw, 54) if packing == 3 else (0x7C00, 0x03E0, 0x001F)
        pixels = body[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        return np.stack([_masked(pixels, m) for m in masks], axis=2)
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = body[:, :width]
    elif bits == 4:
        index = np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(body, axis=1)[:, :width]
    used = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.frombuffer(raw, np.uint8, used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    if index.size and int(index.max()) >= used:
        raise ValueError("BMP index beyond its palette")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][index] if grey else palette[index]


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as BMP with a grey palette."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    begin = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", begin + rows.size, 0, 0, begin) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode(raw: bytes) -> np.ndarray:
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(raw)
    if raw[:2] == b"BM":
        return decode_bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of the area that each target pixel covers, as float64."""
    flat = image.reshape(image.shape[0], image.shape[1], -1)
    if not flat.shape[0] or not flat.shape[1]:
        raise ValueError("an image without pixels")
    total = np.zeros((flat.shape[0] + 1, flat.shape[1] + 1, flat.shape[2]))
    total[1:, 1:] = flat.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def borders(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(to + 1) * n / to
        whole = np.minimum(at.astype(np.int64), n - 1)
        return whole, at - whole

    (y, fy), (x, fx) = borders(flat.shape[0], rows), borders(flat.shape[1], columns)
    lines = total[y] * (1 - fy)[:, None, None] + total[y + 1] * fy[:, None, None]
    grid = lines[:, x] * (1 - fx)[None, :, None] + lines[:, x + 1] * fx[None, :, None]
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    mean = sums * (rows * columns / (flat.shape[0] * flat.shape[1]))
    return mean.reshape((rows, columns) + image.shape[2:])


def grey(image: np.ndarray) -> np.ndarray:
    """Rec. 601 luma of colour images; 16-bit samples on the scale of 8 bits."""
    out = image.astype(np.float64) / (257.0 if image.dtype == np.uint16 else 1.0)
    return out @ np.array([0.299, 0.587, 0.114]) if out.ndim == 3 else out


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 9 cells is darker than its right neighbour, row by row."""
    cells = np.round(area_resize(grey(image), HASH_ROWS, HASH_COLUMNS), 6)  # so that rounding decides no bit
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to ``size`` x ``size`` 8-bit samples, as NPY bytes."""
    scale = 257.0 if image.dtype == np.uint16 else 1.0
    to = io.BytesIO()
    cells = np.clip(np.floor(np.round(area_resize(image, size, size) / scale, 6) + 0.5), 0, 255)
    np.save(to, np.ascontiguousarray(cells, np.uint8), allow_pickle=False)
    return to.getvalue()


TILES = [
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("tile", T.BinaryType()),
    T.StructField("dhash", T.StringType()),
    T.StructField("error", T.StringType()),
]


def media_tiles(images: DataFrame, content: str = "content", size: int = TILE, keep: list[str] | None = None) -> DataFrame:
    """``images`` (bytes in ``content``, as ``binaryFile`` reads them) with their size, NPY tile and difference hash."""

    def make():
        def run(block: Block) -> dict:
            rows = []
            for i in range(block.n):
                if not block.valid[i]:
                    rows.append((None, None, None, None, None))
                    continue
                try:
                    image = decode(block.raw(i))
                    rows.append((image.shape[1], image.shape[0], npy_tile(image, size), difference_hash(image), None))
                except (ValueError, struct.error, IndexError) as why:
                    rows.append((None, None, None, None, str(why)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            return {f.name: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate(TILES)}

        return run

    return with_text_columns(images, content, TILES, make, keep)


STORED = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media_format", T.StringType()),
    T.StructField("media", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("tile", T.BinaryType()),
    T.StructField("dhash", T.StringType()),
]


def store_payload(raw: bytes) -> tuple[str, bytes]:
    """The bytes, zero-padded to a positive multiple of 64, as a grey image 64 samples wide, and its format."""
    padded = raw + b"\0" * (max(PAYLOAD_UNIT, -(-len(raw) // PAYLOAD_UNIT) * PAYLOAD_UNIT) - len(raw))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, PAYLOAD_UNIT)
    return ("bmp", encode_bmp(samples)) if zlib.crc32(padded) % 2 else ("pgm", encode_pgm(samples))


def text_media(documents: DataFrame, text: str = "text", size: int = TILE, keep: list[str] | None = None) -> DataFrame:
    """Each text stored as an image, the payload read back from it, and the image's NPY tile and difference hash."""

    def make():
        def run(block: Block) -> dict:
            rows = []
            for i in range(block.n):
                raw = block.raw(i)
                kind, media = store_payload(raw)
                image = decode(media)
                rows.append((len(raw), kind, media, image.tobytes(), npy_tile(image, size), difference_hash(image)))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string())
            return {f.name: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate(STORED)}

        return run

    return with_text_columns(documents, text, STORED, make, keep)
