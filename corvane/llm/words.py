"""Fast word ids in Python workers: ASCII letters lower-cased, other ASCII but digits as white space, then hashed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789"
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
#: Bytes of words that a worker remembers, with WORD_BYTES for what else an entry takes.
REMEMBER, WORD_BYTES = 16 << 20, 180


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Remembered(dict):
    """Values of words by a function; forgets everything when it is full."""

    def __init__(self, of):
        super().__init__()
        self.of, self.held = of, 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + WORD_BYTES
        if self.held > REMEMBER:
            self.clear()
            self.held = len(word) + WORD_BYTES
        out = self[word] = self.of(word)
        return out


class WordIds(Remembered):
    """Word to id, by a function of the word's CRC-32 or of the word itself."""

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the texts in one array, and the number of words of each text."""
        split = [words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum())), sizes


def crc(word: bytes) -> int:
    return zlib.crc32(word)


def portions(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of consecutive portions of about size bytes, one text at least; one portion is taken out of Arrow at a time.

    What Arrow has freed of earlier batches goes back to the system: a worker shares its executor's memory with others.
    """
    pa.default_memory_pool().release_unused()
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= size or i + 1 == len(texts):
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0
