"""Sets of 5-word shingles as 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to lower case
LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
#: words whose shingles are worked on together
CHUNK_WORDS = 200_000
#: words remembered by a worker process; beyond that it starts anew, which costs time only
MEMO_WORDS = 150_000


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed pseudo-random permutation of 64-bit values (the finaliser of SplitMix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


@functools.cache
def word_hashes() -> WordHashes:
    """One memory for all tasks of a worker process."""
    return WordHashes()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    total = np.full(max(0, len(words) - width + 1), np.uint64(width))
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(total)]
    return mix(total)


class Chunk:
    """The shingle sets of some documents: all values in one array, a sorted run of distinct ones per document."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray]):
        self.ids = ids
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.concatenate([np.zeros(0, np.uint64), *sets])

    def set(self, k: int) -> np.ndarray:
        return self.values[self.starts[k] : self.starts[k] + self.sizes[k]]

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each set: a sum and an exclusive or of mixed values."""
        out = []
        for salt, reduce in ((301, np.add), (401, np.bitwise_xor)):
            found = np.zeros(len(self.ids), np.uint64)
            some = self.sizes > 0
            if some.any():
                found[some] = reduce.reduceat(mix(self.values, salt), self.starts[some])
            out.append(found.view(np.int64))
        return out[0], out[1]


def shingle_chunks(ids: list[int | None], texts: pa.Array, size: int = 5) -> Iterator[Chunk]:
    """Shingle sets of whole texts (binary, or null), CHUNK_WORDS words at a time; a longer text is a chunk of its own.

    A text of fewer than `size` words, but not none, is one shingle.
    """
    hashes = word_hashes()
    names: list[int | None] = []
    sets: list[np.ndarray] = []
    filled = 0
    for name, text in zip(ids, texts):
        words = (text.as_py() or b"").translate(LOWER).split()
        if names and filled + len(words) > CHUNK_WORDS:
            yield Chunk(names, sets)
            names, sets, filled = [], [], 0
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        names.append(name)
        sets.append(np.unique(shingle_hashes(w, min(size, len(w)))) if len(w) else w)
        filled += len(words)
    if names:
        yield Chunk(names, sets)
