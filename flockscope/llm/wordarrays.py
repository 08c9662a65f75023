"""Word hashes of a batch of texts as flat numpy arrays (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Fixed odd multipliers, one for each place in a window of words.
PLACES = np.array([xxhash.xxh64_intdigest(f"place{i}") | 1 for i in range(64)], dtype=np.uint64)


#: Longer words (in bytes) are hashed each time and not remembered, so a memo is bounded in bytes too.
LONGEST_KEPT = 100


class WordHash(dict):
    """Memo of word -> XXH64; emptied when it holds ``most`` words, without words over ``LONGEST_KEPT`` bytes."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        h = self.hashed(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes: ``bytes.split()`` cuts at exactly space and TAB .. CR."""
    return text.encode("utf-8").split() if text else []


def hash_words(word_lists: Iterable[list[bytes]], memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, lengths)``: all word hashes end to end, and words per list."""
    lengths, flat = [], []
    for words in word_lists:
        lengths.append(len(words))
        flat.append(np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words)))
    return (np.concatenate(flat) if flat else np.empty(0, np.uint64)), np.array(lengths, dtype=np.int64)


def window_hashes(h: np.ndarray, width: int, turn: int = 0) -> np.ndarray:
    """Hash of every ``width``-word window (also those across list borders).

    A sum of word hashes times odd constants, then mixed. Other values of
    ``turn`` use other constants, for an independent second hash.
    """
    n = max(len(h) - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += h[j:j + n] * PLACES[(j + turn) % 64]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def window_starts(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, owner)`` of every window that lies inside one list, in order."""
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(lengths) else np.empty(0, np.int64)
    return np.arange(counts.sum()) - before[owner] + first[owner], owner


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
