"""PNG rows of every filter type, colour type and depth, against a plain writer built from the format's rules."""

import struct
import zlib

import numpy as np
import pytest

from scanloom.functions import png


def plain_filter(kind, row, prior, step):
    """One filtered row, byte by byte."""
    out = []
    for i, x in enumerate(row):
        a = row[i - step] if i >= step else 0
        b = prior[i]
        c = prior[i - step] if i >= step else 0
        p = a + b - c
        paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else (b if abs(p - b) <= abs(p - c) else c)
        out.append((x - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    return bytes([kind, *out])


def plain_png(raw_rows, width, depth, colour, kinds, palette=None):
    step = max(1, png.SAMPLES[colour] * depth // 8)
    data, prior = b"", bytes(len(raw_rows[0]))
    for row, kind in zip(raw_rows, kinds):
        data += plain_filter(kind, row, prior, step)
        prior = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(raw_rows), depth, colour, 0, 0, 0))
    body = (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(data))
    return png.SIGNATURE + head + body + chunk(b"IEND", b"")


rng = np.random.default_rng(7)


@pytest.mark.parametrize("colour, depth", [(2, 8), (6, 8), (0, 8), (4, 8), (2, 16), (0, 16), (0, 1), (0, 2), (0, 4), (3, 8), (3, 4), (3, 1)])
def test_every_filter_of_every_colour_type(colour, depth):
    width, height = 13, 10
    samples = png.SAMPLES[colour]
    top = (1 << depth) - 1 if colour != 3 else min(15, (1 << depth) - 1)
    values = rng.integers(0, top + 1, (height, width, samples))
    values[3:6] = np.arange(width)[None, :, None] % (top + 1)  # smooth rows, where prediction helps
    if depth == 16:
        raw = [b"".join(struct.pack(">H", int(v)) for v in r.reshape(-1)) for r in values]
    elif depth < 8:
        raw = [np.packbits(np.unpackbits(r.reshape(-1, 1).astype(np.uint8), axis=1)[:, 8 - depth :].reshape(-1)).tobytes() for r in values]
    else:
        raw = [r.astype(np.uint8).tobytes() for r in values]
    palette = bytes(rng.integers(0, 256, 3 * 16).astype(np.uint8)) if colour == 3 else None
    kinds = [k % 5 for k in range(height)]
    got = png.decode(plain_png(raw, width, depth, colour, kinds, palette))
    if colour == 3:
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[values[..., 0]]
    else:
        high = values >> 8 if depth == 16 else (values * 255 // top if depth < 8 else values)
        want = np.repeat(high[..., :1], 3, axis=2) if colour in (0, 4) else high[..., :3]
    assert got.shape == (height, width, 3) and np.array_equal(got, want.astype(np.uint8))


def test_written_rows_use_the_cheapest_filter_and_read_back():
    images = rng.integers(0, 256, (4, 6, 21, 3)).astype(np.uint8)
    images[:, 2:] = np.arange(21)[None, None, :, None] * 3  # gradients: Sub or Up beat no filter
    for image, data in zip(images, png.encode_block(images)):
        assert np.array_equal(png.decode(data), image)
        width, height = struct.unpack(">II", data[16:24])
        rows = np.frombuffer(zlib.decompress(data[41:-16]), np.uint8).reshape(height, 1 + 3 * width)
        assert set(rows[2:, 0]) <= {1, 2, 3, 4} and len(set(rows[:, 0])) > 1
        for y, kind in enumerate(rows[:, 0]):  # each row's filter has the least absolute sum of the five
            prior = image[y - 1].tobytes() if y else bytes(3 * width)
            sums = [sum(min(v, 256 - v) for v in plain_filter(k, image[y].tobytes(), prior, 3)[1:]) for k in range(5)]
            assert sums[kind] == min(sums)


@pytest.mark.parametrize("kind", range(5))
def test_forced_filters_invert(kind):
    raw = rng.integers(0, 256, (2, 5, 12)).astype(np.uint8)
    rows = png.filter_rows(raw, 3, np.full((2, 5), kind))
    for i in range(2):
        assert np.array_equal(png.unfilter(rows[i], 3), raw[i])
        prior = bytes(12)
        for y in range(5):
            assert rows[i, y].tobytes() == plain_filter(kind, raw[i, y].tobytes(), prior, 3)
            prior = raw[i, y].tobytes()


def test_refused_images():
    good = plain_png([bytes(6)], 2, 8, 2, [0])
    for bad in (b"nothing", good[:30], good.replace(b"IHDR\x00\x00\x00\x02\x00\x00\x00\x01\x08\x02", b"IHDR\x00\x00\x00\x02\x00\x00\x00\x01\x08\x05")):
        with pytest.raises(ValueError):
            png.decode(bad)
    unknown = png.SIGNATURE + good[8:33] + png._chunk(b"IDAT", zlib.compress(bytes([7]) + bytes(6))) + good[-12:]
    for bad in (unknown, good[:-12].replace(b"IDAT", b"IDAX")):  # an unknown filter; no image data
        with pytest.raises(ValueError):
            png.decode(bad)
