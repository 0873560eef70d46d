"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from collections.abc import Iterator

import numpy as np

from scholium.llm.words import chunks, mix, word_hashes

_PLACES = np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of ``width`` words of each lower-cased text, sorted.

    A text with fewer words is one shingle, a text without words has none.
    """
    for _, chunk in chunks(texts):
        hashes, sizes = word_hashes(chunk)
        many = max(0, len(hashes) - width + 1)
        joined = np.zeros(many, np.uint64)
        for j in range(width):
            joined += hashes[j : j + many] * _PLACES[j]
        joined = mix(joined)
        at = 0
        for size in sizes.tolist():
            if size >= width:
                yield np.unique(joined[at : at + size - width + 1])
            elif size:
                whole = (hashes[at : at + size] * _PLACES[:size]).sum(keepdims=True, dtype=np.uint64)
                yield mix(whole + np.uint64(size))
            else:
                yield np.zeros(0, np.uint64)
            at += size
