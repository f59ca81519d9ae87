"""Words of many texts as NumPy arrays, without a Python object for each word.

A batch's UTF-8 bytes are one array.  A byte maps to itself, to another byte (lower
case) or to 0, which parts words.  The hash of a stretch of bytes takes eight of them at a
time into a bijective mix, in turn, for all stretches of a batch at once; so stretches of
one length up to eight bytes never collide, and longer ones do not by any pattern in them.
Stretches over ``LONG`` bytes, few in any text, are digested one by one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: An odd number without a pattern in its bits.
BASE = 0x9E3779B97F4A7C15
#: Bytes from which on a stretch is digested by itself.
LONG = 192
SPACES = (9, 10, 11, 12, 13, 32)

#: A-Z to lower case; ASCII white space parts words.  A zero byte takes a value that UTF-8 never has.
BLANK_PARTED = np.array([255 if c == 0 else 0 if c in SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: A-Z to lower case; every ASCII character but letters and digits parts words.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: The bytes that a last block of up to 8 bytes keeps.
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


#: What the hash of a stretch of each length up to ``LONG`` begins with.
FIRST = mix(np.arange(1, LONG + 2, dtype=np.uint64) * np.uint64(BASE))


def stretch_hashes(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of ``data`` (bytes) from ``a`` to before ``z``; equal bytes have equal hashes."""
    n = np.maximum(z - a, 0)
    if not len(n):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = FIRST[np.minimum(n, LONG)]
    block = eight[a]
    block &= TAIL[np.minimum(n, 8)]
    block ^= h
    h = np.where(n > 0, mix(block), h)
    live, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        left = n[live] - k
        h[live] = mix(h[live] ^ (eight[a[live] + k] & TAIL[np.minimum(left, 8)]))
        live = live[left > 8]
        k += 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[a[i] : z[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """The words of a batch of texts, in order."""

    raw: np.ndarray  # the texts' bytes, end to end
    codes: np.ndarray  # the same after mapping; 0 parts words
    offsets: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last
    first: np.ndarray  # number of the first word of each text, and the number of words

    def hashes(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The hash of each stretch of bytes from ``a`` to before ``z``."""
        return stretch_hashes(self.codes, a, z)

    def of_words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def owner(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each text begins, and the end; null counts as empty."""
    col = col.fill_null("").cast(pa.large_string())
    if col.offset:
        col = pa.concat_arrays([col])
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def read(col: pa.Array, table: np.ndarray) -> Words:
    """The words of a string column; a null counts as empty."""
    raw, offsets = flat(col)
    codes = table[raw]
    inside = codes != 0
    before = np.concatenate(([False], inside[:-1]))
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    before[starts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[starts[starts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(raw, codes, offsets, start, end, np.searchsorted(start, offsets))
