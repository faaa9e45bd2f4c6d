"""Hashed word sequences of texts as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from quern.llm.common import process_cache, words_of

WORDS, LEAST_WORDS = 3, 20
MEMO_WORDS = 1_000_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        n = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = n
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = WORDS, least: int = LEAST_WORDS) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the text's sequences of ``size`` words; None under ``least`` words."""
    if not text:
        return None
    words = words_of(text)
    if len(words) < max(least, size):
        return None
    memo = process_cache().setdefault("word hashes", WordHashes())
    if len(memo) > MEMO_WORDS:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(3) + h[k : k + n])
    return np.unique(out)


def set_id(sorted_hashes: np.ndarray) -> int:
    """Signed 64-bit id of a set of hashes: equal sets, equal ids."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(sorted_hashes.tobytes()))))
