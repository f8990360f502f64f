"""Words of a block of texts as 64-bit hashes in one numpy array."""

from __future__ import annotations

import numpy as np
import xxhash

KNOWN_WORDS = 300_000
#: Maps every ASCII byte that is no digit or letter to a space and upper to lower case; bytes of other letters stay.
_ALNUM = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def alnum_words(text: str) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_ALNUM).split()


def space_words(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, A-Z lower-cased."""
    return text.encode().lower().split()


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their order is unrelated to what they were made from."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def row_bounds(sizes: list[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int64)
