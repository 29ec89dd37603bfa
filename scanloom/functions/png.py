"""PNG bytes of 8-bit RGB pixels, for use inside Arrow batches.

Writing chooses a filter for every image row, as usual encoders do: each of the five predictors of the format is
applied to the row, and the one whose output has the smallest sum of absolute values (bytes read as signed) is kept,
since such rows compress best. Reading inverts any of the five, row by row, and accepts the colour types and bit
depths of the format that are not interlaced: grey, grey with alpha, RGB, RGBA and palette images. Grey becomes three
equal channels, alpha is dropped, 16-bit samples keep their high byte and grey of 1, 2 or 4 bits is scaled to 0..255.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: filter type bytes, and samples per pixel of each colour type.
NONE, SUB, UP, AVERAGE, PAETH = 0, 1, 2, 3, 4
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The predictor of the Paeth filter, for arrays of left, upper and upper-left bytes (as signed integers)."""
    p = a + b - c
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filter_rows(raw: np.ndarray, step: int, kinds: np.ndarray | None = None) -> np.ndarray:
    """Rows ``(n, height, stride)`` with their filter byte in front, ``(n, height, 1 + stride)``.

    ``step`` is the bytes per pixel. Each row's filter is the one of least absolute sum, or ``kinds[n, height]``.
    """
    x = raw.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[..., step:] = x[..., :-step]
    up[:, 1:] = x[:, :-1]
    corner[:, 1:, step:] = x[:, :-1, :-step]
    filtered = np.stack([x, x - left, x - up, x - ((left + up) >> 1), x - _paeth(left, up, corner)]) & 0xFF
    if kinds is None:
        signed = np.where(filtered > 127, 256 - filtered, filtered)
        kinds = signed.sum(axis=-1).argmin(axis=0)
    out = np.empty((*raw.shape[:2], 1 + raw.shape[2]), np.uint8)
    out[..., 0] = kinds
    out[..., 1:] = np.take_along_axis(filtered, kinds[None, ..., None], axis=0)[0]
    return out


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Raw bytes ``(height, stride)`` of filtered rows ``(height, 1 + stride)``."""
    height, stride = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((height, stride), np.uint8)
    prior = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, f = int(rows[y, 0]), rows[y, 1:]
        if kind == NONE:
            row = f.copy()
        elif kind == SUB:
            row = np.cumsum(f.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == UP:
            row = f + prior
        elif kind in (AVERAGE, PAETH):
            row = np.zeros(stride, np.uint8)
            before = np.zeros(step, np.int16)
            above_left = np.zeros(step, np.int16)
            for at in range(0, stride, step):
                above = prior[at : at + step].astype(np.int16)
                guess = (before + above) >> 1 if kind == AVERAGE else _paeth(before, above, above_left)
                row[at : at + step] = (f[at : at + step] + guess) & 0xFF
                before, above_left = row[at : at + step].astype(np.int16), above
        else:
            raise ValueError(f"unknown PNG row filter {kind}")
        out[y], prior = row, row
    return out


def encode_block(images: np.ndarray) -> list[bytes]:
    """Encode ``n`` images of one shape, given as ``(n, height, width, 3)`` bytes."""
    count, height, width, _ = images.shape
    head = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    tail = _chunk(b"IEND", b"")
    rows = filter_rows(images.reshape(count, height, 3 * width), 3)
    return [head + _chunk(b"IDAT", zlib.compress(rows[i].tobytes(), 9)) + tail for i in range(count)]


def decode(data: bytes) -> np.ndarray:
    """Pixels ``(height, width, 3)`` of a PNG image that is not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, header, palette = 8, [], None, None
    while at < len(data):
        if len(data) < at + 12:
            raise ValueError("damaged PNG image")
        (length,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(data) < at + 12 + length or struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    if header is None:
        raise ValueError("PNG image without header")
    width, height, depth, colour, _, _, interlace = header
    if depth not in DEPTHS.get(colour, ()):
        raise ValueError(f"PNG colour type {colour} with {depth}-bit samples is not valid")
    if interlace:
        raise ValueError("interlaced PNG images cannot be read")
    bits = SAMPLES[colour] * depth
    stride = (width * bits + 7) // 8
    try:
        unpacked = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise ValueError("damaged PNG image data") from error
    if len(unpacked) < height * (1 + stride):
        raise ValueError("PNG image data shorter than its header says")
    rows = np.frombuffer(unpacked, np.uint8)[: height * (1 + stride)].reshape(height, 1 + stride)
    raw = unfilter(rows, max(1, bits // 8))
    if depth == 16:
        samples = raw.reshape(height, -1, 2)[..., 0]
    elif depth < 8:
        samples = np.unpackbits(raw, axis=1).reshape(height, -1, depth)[:, :width]
        samples = (samples * (1 << np.arange(depth - 1, -1, -1))).sum(axis=-1).astype(np.uint8)
        if colour == 0:
            samples = (samples.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    else:
        samples = raw
    pixels = samples.reshape(height, width, SAMPLES[colour])
    if colour == 3:
        if palette is None:
            raise ValueError("palette PNG image without palette")
        if pixels.size and pixels.max() >= len(palette):
            raise ValueError("PNG palette index beyond the palette")
        return palette[pixels[..., 0]]
    if colour in (0, 4):
        return np.repeat(pixels[..., :1], 3, axis=2)
    return np.ascontiguousarray(pixels[..., :3])
