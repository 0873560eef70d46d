"""Words of whole texts as 64-bit hashes, computed on arrays."""

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), 0x20]] = True
_LETTERS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for all ``i < n``."""
    if len(_powers[name]) < n:
        factors = np.full(max(n, 2 * CHUNK_BYTES), base % (1 << 64), np.uint64)
        factors[0] = 1
        _powers[name] = np.cumprod(factors)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return b"" if text is None else text.encode("utf-8").lower()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes, with the number of the first."""
    first, chunk, size = 0, [], 0
    for i, text in enumerate(texts):
        chunk.append(text)
        size += len(text) + 1
        if size >= limit:
            yield first, chunk
            first, chunk, size = i + 1, [], 0
    if chunk:
        yield first, chunk


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: a hash of every word in order, and the number of words of each text.

    Words are the runs of bytes other than the six blanks. A word's hash is a polynomial in its
    bytes modulo 2**64, taken from running sums over all bytes, and mixed with its length.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = _SPACES[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power("up", _ODD, n), out=running[1:])
    inverse = _power("down", pow(_ODD, -1, 1 << 64), n)
    h = (running[end] - running[start]) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(_ODD))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    before = np.searchsorted(start, np.concatenate([[0], ends]) + 1)
    return h, np.diff(before)


class CountTable:
    """Values of 64-bit keys by open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(1.4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.asarray(values).dtype)
        self.used = np.zeros(1 << bits, bool)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slots[left]]]
            place, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[place], self.values[place], self.used[place] = keys[put], values[put], True
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(values, found)``; the value of what is not found is 0."""
        slots = self._slot(keys)
        values, found = self.values[slots], self.keys[slots] == keys
        found &= self.used[slots]
        left = np.flatnonzero(~found & self.used[slots])
        values[~found] = 0
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            at = slots[left]
            hit = (self.keys[at] == keys[left]) & self.used[at]
            values[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            left = left[~hit & self.used[at]]
        return values, found
