"""Words and shingles of many texts at once, as numpy arrays of 64-bit fingerprints.

A block is a few texts of a few megabytes. Words are runs of bytes outside 0x20 and 0x09-0x0D after
lower-casing A-Z. A word's fingerprint is the sum of a pseudo-random number for each pair of a place in the word
and the byte there: no family of words collides by its structure, as with a polynomial modulo 2^64, and two
different words do by a chance of 2^-64. A shingle's fingerprint combines those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one numpy step works on.
STEP = 1 << 20
#: Bytes of text gathered into one block.
BLOCK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of values[start:end] for each of some non-empty, disjoint, ascending spans."""
    if not len(starts):
        return np.zeros(0, U)
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(int(first[-1] + n[-1])) - np.repeat(first, n)
    each = mix((place.astype(U) << U(21) | values[np.repeat(starts, n) + place].astype(U)) + U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(each, first) + n.astype(U))


def _steps(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP bytes that end on a blank; a longer word makes a longer range."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STEP)
        if end < n:
            back = np.flatnonzero(space[at:end])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(space[end:])
                end = end + int(ahead[0]) + 1 if len(ahead) else n
        yield at, end
        at = end


class Words:
    """The words of some texts: hashes in order, and bounds[i]:bounds[i + 1] for text i."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower(), np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        space = _SPACE[self.data]
        hashes, starts, ends = [], [], []
        for a, b in _steps(self.data, space):
            s = space[a:b]
            edge = np.diff(np.concatenate(([True], s, [True])).view(np.int8))
            first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            hashes.append(span_hashes(self.data[a:b], first, last))
            starts.append(first + a)
            ends.append(last + a)
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else none.astype(U)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.bounds = np.searchsorted(self.starts, self.at)

    def shingles(self, i: int, k: int) -> np.ndarray:
        """Fingerprints of text i's k-word shingles in order; of the whole text if it is shorter; of none if empty."""
        return shingle(self.hashes[self.bounds[i] : self.bounds[i + 1]], k)


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    w = min(n, k)
    out = np.full(n - w + 1, 0xD6E8FEB86659FD93 * w % 2**64, U)
    for j in range(w):
        out *= U(0xA0761D6478BD642F)
        out += words[j : n - w + 1 + j]
        out ^= out >> U(29)
    return mix(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts come to about size bytes, or to one text."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        texts = batch.column(i).cast(pa.binary())
        start, total = 0, 0
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :]) if len(texts) else []
        for k, n in enumerate(lengths):
            if k > start and total + n > size:
                yield batch.slice(start, k - start), texts_of(texts.slice(start, k - start))
                start, total = k, 0
            total += int(n)
        if start < len(texts):
            yield batch.slice(start), texts_of(texts.slice(start))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_bucket(ids: list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo; the remainder of a null id is that of the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids), np.int64, len(ids))
