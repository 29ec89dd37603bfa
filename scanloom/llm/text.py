"""Words and word hashes of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Texts are worked on in slices of about so many bytes, so that memory does not follow the batch.
SLICE_BYTES = 2_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: For words in the narrower sense ASCII punctuation separates, too.
WORD_BREAKS = _IS_SPACE.copy()
WORD_BREAKS[list(b".,;:!?\"'()[]{}<>|/#*$%&")] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_SAME >= 65) & (_SAME <= 90), _SAME + 32, _SAME).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        size = max(length, SLICE_BYTES + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table


@dataclass
class Words:
    """The words of a slice of texts: ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = len(self.data)
        powers = _power_table(_BASE, size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(self.data * powers[:size], dtype=np.uint64, out=sums[1:])
        inverse = _power_table(pow(_BASE, -1, 1 << 64), size + 1)
        own = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of slices of whole texts; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]``, of which NumPy would make 8-byte places first."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _IS_SPACE) -> Words:
    """Words of the texts that ``offsets`` cut out of ``data``; words never span two texts, nor hold ``breaks``."""
    if lower:
        data = _looked_up(_LOWER, data)
    space = _looked_up(breaks, data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))
