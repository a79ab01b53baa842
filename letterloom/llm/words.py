"""Words of whole Arrow text columns as arrays of hashes.

A column is cut into runs of rows of about a megabyte, and each run is worked on at once, so
memory follows the longest text and not the batch. Words are found on UTF-8 bytes: all
separators are ASCII, so no character is ever split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)

#: ASCII white space, by the pattern [\x20\x09-\x0D].
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def codes(separators: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit code for each byte, 0 for separators; with ``fold``, A-Z get the codes of a-z."""
    table = _CODES.copy()
    if fold:
        table[65:91] = table[97:123]
    table[separators] = 0
    return table


def white() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(WHITE)] = True
    return out


def punctuation() -> np.ndarray:
    """All ASCII bytes but letters and digits."""
    out = np.arange(256) < 128
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        out[lo:hi] = False
    return out


PLAIN, FOLDED = codes(white(), False), codes(white(), True)
LETTERS = codes(punctuation(), True)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, RUN_BYTES + 4096, 0 if have is None else 2 * len(have))
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their bytes and offsets; a text longer than a run is a slice of its own."""
    raw, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + RUN_BYTES, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start), raw[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the number of words before each text.

    ``table`` comes from ``codes``; bytes with code 0 separate words.
    """
    bounds = np.zeros(len(offsets), np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    coded = table[raw]
    inside = coded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(raw)]
    first[begin] = inside[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, bounds
    coded *= powers(BASE, len(raw))
    hashes = np.add.reduceat(coded, starts) * powers(BASE_INVERSE, len(raw))[starts]
    return mix(hashes), starts, np.searchsorted(starts, offsets)


def word_ends(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The byte after each word, in the order of ``words``."""
    inside = table[raw] != 0
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = inside[end]
    return np.flatnonzero(last) + 1


def windows(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A hash of each run of ``width`` words, by its first word; runs may cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = powers(base, width)
    if width <= 8:
        out = hashes[:n] * weights[0]
        for k in range(1, width):
            out += hashes[k:n + k] * weights[k]
        return mix(out)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(pow(base, -1, 2**64), n))
