"""Sets of word shingles as sorted 64-bit hashes, an Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Words remembered by a worker at once.
REMEMBERED = 120_000


class WordHashes(dict):
    """The 64-bit hash of a word; forgets all when it holds REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space; both are what bytes' own methods do."""
    return text.lower().split() if text else []


def word_hashes(tokens: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of each value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: bytes | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words the whole sequence is one; of none, empty."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(tokens) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], dtype=np.uint64)
    hashed = word_hashes(tokens, known)
    n = len(hashed) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for place in range(width):
        total += hashed[place : place + n] * _PLACES[place]
    return np.unique(mix(total))


def set_id(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))
