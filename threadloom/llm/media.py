"""Media columns: Netpbm and BMP as binary columns, decoded to numpy arrays, area-resized, written as NPY tiles.

Defined results. A null medium, or one that isn't a whole Netpbm (P1 to P6) or an uncompressed BMP (1, 4, 8, 24, 32
bits), gives nulls and a reason in `error`; it never fails a task. Equal media give equal tiles and hashes. The payload
of a null or empty text is 192 blanks.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples in a stored row: 64 pixels of three.
ROW_BYTES = 192
TILE = 16
#: Above so many samples an image is reduced band by band, so that its sums stay small.
WHOLE_IMAGE_SAMPLES = 4_000_000


class MediaError(ValueError):
    pass


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for two axes, P6 for three, with samples of 8 bits."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, padded to four bytes."""
    height, width = image.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    fields, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:[ \t\r\n\v\f]+|#[^\n]*\n)+([0-9]{1,9})").match(data, at)
        if not m:
            raise MediaError("netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, depth = fields[0], fields[1], fields[2] if len(fields) == 3 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not width or not height or not 0 < depth < 65536:
        raise MediaError("netpbm size")
    count = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        words = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        if len(words) < count:
            raise MediaError("netpbm samples")
        samples = np.array(words[:count]).astype(np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        if len(data) < at + 1 + stride * height:
            raise MediaError("netpbm samples")
        bits = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = np.unpackbits(bits, axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(np.uint8) if depth < 256 else np.dtype(">u2")
        if len(data) < at + 1 + count * kind_of.itemsize:
            raise MediaError("netpbm samples")
        samples = np.frombuffer(data, kind_of, count, at + 1)
    if kind in (b"P1", b"P4"):
        samples = (1 - samples) * 255
    elif depth != 255:
        samples = np.minimum(samples.astype(np.int64), depth) * 255 // depth
    shape = (height, width, 3) if channels == 3 else (height, width)
    return samples.astype(np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("bmp header")
    start, size, width, height, _, bits, packing = *struct.unpack_from("<II", data, 10), *struct.unpack_from("<iiHHI", data, 18)
    down, height = height < 0, abs(height)
    if packing or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise MediaError("bmp kind")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < start + stride * height:
        raise MediaError("bmp samples")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if bits >= 24:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        if used > 256 or len(data) < 14 + size + 4 * used:
            raise MediaError("bmp palette")
        palette = np.zeros((256, 3), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = rows[:, :width]
        elif bits == 4:
            index = np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)[:, :width]
        else:
            index = np.unpackbits(rows, axis=1)[:, :width]
        image = palette[index]
    return np.ascontiguousarray(image if down else image[::-1])


def decode(data: bytes) -> np.ndarray:
    """The image as 8-bit samples, (height, width) or (height, width, 3)."""
    if re.match(rb"P[1-6][ \t\r\n\v\f#]", data[:3]):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise MediaError("unknown kind")


def _sums_at(sums: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The integral image at fractional places, which is linear between its entries."""
    y0, x0 = np.minimum(y.astype(np.int64), sums.shape[0] - 2), np.minimum(x.astype(np.int64), sums.shape[1] - 2)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a, b = sums[y0][:, x0], sums[y0][:, x0 + 1]
    c, d = sums[y0 + 1][:, x0], sums[y0 + 1][:, x0 + 1]
    return a * (1 - fy) * (1 - fx) + b * (1 - fy) * fx + c * fy * (1 - fx) + d * fy * fx


def _integral(image: np.ndarray) -> np.ndarray:
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1, image.shape[2]), dtype=np.float64)
    np.cumsum(image, axis=0, dtype=np.float64, out=sums[1:, 1:])
    np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
    return sums


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean of the area that it covers, parts of pixels included; float64."""
    cube = image if image.ndim == 3 else image[:, :, None]
    y, x = np.arange(height + 1) * (cube.shape[0] / height), np.arange(width + 1) * (cube.shape[1] / width)
    if cube.size <= WHOLE_IMAGE_SAMPLES:
        at = _sums_at(_integral(cube), y, x)
        mass = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    else:
        mass = np.zeros((height, width, cube.shape[2]))
        step = max(1, WHOLE_IMAGE_SAMPLES // (cube.shape[1] * cube.shape[2]))
        for top in range(0, cube.shape[0], step):
            band = cube[top : top + step]
            at = _sums_at(_integral(band), np.clip(y - top, 0, band.shape[0]), x)
            mass += at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    out = mass / ((cube.shape[0] / height) * (cube.shape[1] / width))
    return out if image.ndim == 3 else out[:, :, 0]


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> int:
    """64 bits: in the 9 x 8 greys, is a pixel brighter than the one on its left?"""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    small = np.rint(area_resize(np.ascontiguousarray(grey), 8, 9) * 256).astype(np.int64)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def tile_of(image: np.ndarray, size: int = TILE) -> bytes:
    cube = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    return npy(np.clip(np.rint(area_resize(cube, size, size)), 0, 255).astype(np.uint8))


FEATURES = "height int, width int, channels int, tile binary, dhash string, error string"


def _features(data: bytes | None) -> tuple:
    if data is None:
        return (None, None, None, None, None, "null")
    try:
        image = decode(data)
    except MediaError as e:
        return (None, None, None, None, None, str(e))
    return (image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, tile_of(image), f"{difference_hash(image):016x}", None)


def media_features(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """Decodes column `media`: size, NPY tile and difference hash for each row, with its `key`."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(x) for x in batch.column(1).to_pylist()]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                [key, "height", "width", "channels", "tile", "dhash", "error"],
            )

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {FEATURES}")


def text_to_image(text: str | None) -> tuple[np.ndarray, int]:
    """A text's UTF-8, blanks appended up to a positive multiple of ROW_BYTES, as rows of 64 RGB pixels; its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b" " * (-len(raw) % ROW_BYTES or (0 if raw else ROW_BYTES))
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3), len(raw)


def store_texts(docs: DataFrame, encoding: str = "netpbm") -> DataFrame:
    """doc_id, n_bytes and a column `media` that holds each whole text as an image, "netpbm" or "bmp"."""
    encode = {"netpbm": encode_netpbm, "bmp": encode_bmp}[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [text_to_image(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in images], pa.int64()), pa.array([encode(i) for i, _ in images], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def stored_digest(stored: DataFrame) -> DataFrame:
    """Reads the stored bytes back: the payload's length and digests, the medium's, and its feature and tile."""

    def one(data: bytes) -> tuple:
        image = decode(data)
        payload, tile = image.tobytes(), tile_of(image)
        feature = f"dhash={difference_hash(image):016x};tile={hashlib.sha256(tile).hexdigest()[:32]};size={image.shape[1]}x{image.shape[0]}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            rows = [one(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"],
            )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
