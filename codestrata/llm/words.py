"""Words, their 64-bit hashes and windows of them, as numpy arrays inside tasks.

A word is a run of bytes other than space and the controls 9 to 13, which is what
``bytes.split()`` cuts. Hashes are wide enough that equal hashes count as equal
words: among 10 billion different windows about three pairs collide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_STEP = 0x9E3779B97F4A7C15
STEP = np.uint64(_STEP)
# A task forgets its words at this many entries, which bounds its memory and changes no result.
VOCABULARY = 300_000
# Bytes of text handled as one block of arrays. A longer text is a block of its own.
BLOCK = 2_000_000


class Vocabulary(dict):
    """Word -> number in order of appearance, and the hash of each number."""

    def __init__(self) -> None:
        super().__init__()
        self._hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self._hashes)
        self._hashes.append(xxhash.xxh3_64_intdigest(word))
        return number

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, dtype=np.uint64)


class Hasher:
    """Hashes of word lists, with a bounded memory of words seen before."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > VOCABULARY:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words, in order; empty if there are fewer.

    A polynomial in the word hashes. That of ``a + b`` words follows from those of ``a`` and of ``b``,
    so the powers of two that make up the width are enough.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    part, size, total, done = hashes, 1, None, 0
    while True:
        if width & size:
            total = part[done : done + n] if total is None else total * np.uint64(pow(_STEP, size, 1 << 64)) + part[done : done + n]
            done += size
        if done == width:
            return mix(total + np.uint64(width))
        part = part[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + part[size:]
        size *= 2


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``width`` are one shingle, no words none."""
    return np.unique(window_hashes(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def lower_ascii(data: bytes) -> bytes:
    return data.lower()


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def blocks(items: Iterable[bytes], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a list of texts into runs of about ``limit`` bytes: ``(first position, texts)``."""
    first, run, size = 0, [], 0
    for at, item in enumerate(items):
        if run and size + len(item) > limit:
            yield first, run
            first, run, size = at, [], 0
        run.append(item)
        size += len(item)
    if run:
        yield first, run
