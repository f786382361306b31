"""Words of many texts at once, as numpy arrays: positions, 64-bit hashes, windows and minima.

The hash of a sequence s is the sum of T[s_i] * BASE**i modulo 2**64, taken from
running sums and mixed at the end, so the hash of any word or window costs a
subtraction. Two hashes with different tables make a 128-bit key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from corpusloom.llm.tables import strings

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (11, 12)]
_powers: dict[int, np.ndarray] = {}

#: Bytes of the class [^\x20\x09-\x0D].
PLAIN = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
#: A-Z to a-z.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1); kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 22:  # those of a very long text are not kept
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    sums = _running(values)
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(values) + 1)[start])


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = _running(values)
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE, n))


def by_text(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by text number, then by ``keys``; texts are few, so their numbers are sorted by counting."""
    order = np.argsort(keys[-1])
    for key in keys[-2::-1]:
        order = order[np.argsort(key[order], kind="stable")]
    small = text.astype(np.uint16) if not len(text) or text.max() < 1 << 16 else text
    return order[np.argsort(small[order], kind="stable")]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


@dataclass
class Words:
    """All words of a batch of texts: byte ranges in ``data``, the text each belongs to, and a hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    n_texts: int

    def hashes(self, table: int = 0) -> np.ndarray:
        return sequence_hashes(_TABLES[table][self.data], self.start, self.end)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.n_texts)

    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def words_of(column: pa.Array, kind: np.ndarray = PLAIN, fold: bool = False) -> Words:
    """Splits every text into runs of bytes of the class ``kind``; null has no words."""
    column = strings(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if fold:
        data = FOLD[data]
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text's first byte begins a word even if the text before ends with one.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, text, len(column))
