"""Words, and hashes of runs of words, of many texts at once with numpy.

A batch of texts is one byte buffer.  A word's hash is a sum of its eight-byte pieces, each mixed
with its place in the word, mixed again with the word's length: no words are known to collide, unlike under a polynomial
modulo 2**64.  Prefix sums of hash * B**-i modulo 2**64 give the polynomial (Rabin-Karp) hash of every run of k
words, without a loop; a polynomial's known collisions take runs of a thousand words, and those here have twenty at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_STEP, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Pieces of words hashed in one go.
PIECES = 1 << 17
#: Bytes of text gathered before they are worked on; one longer text is worked on alone.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = ~_SPACE
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.  All bytes of other characters are over 0x7F.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: What lower-cases A to Z.
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.n, self.up, self.down = base, 0, None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = _powers(self.base, self.n), _powers(pow(self.base, -1, 2**64), self.n)
        return self.up[:n], self.down[:n]


_RUNS, _OTHER = _Powers(_WORD_BASE), _Powers(0xA24BAED4963EE407)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a batch, in order: the row that each is of, its bytes' start and end in data, its hash."""

    data: bytes
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: For each row, the place of its first word (one more entry at the end).
    first: np.ndarray

    def runs(self, k: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and hashes of all runs of k words within one row; other: a second, independent hash."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        up, down = (_OTHER if other else _RUNS).get(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum((mix(self.hash ^ np.uint64(_STEP)) if other else self.hash) * down[:-1], out=total[1:])
        return at, mix((total[at + k] - total[at]) * up[at])

    def whole(self, row: int) -> np.uint64:
        """The hash of all words of a row as one run."""
        a, b = self.first[row], self.first[row + 1]
        up, down = _RUNS.get(int(b - a) + 1)
        return mix(np.add.reduce(self.hash[a:b] * down[: b - a], keepdims=True))[0] ^ np.uint64(b - a)


def _hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words data[start:end], at most PIECES eight-byte pieces at a time."""
    padded = data + bytes(8)
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out, pieces = np.empty(len(start), np.uint64), (end - start + 7) // 8
    edges = np.concatenate([[0], np.cumsum(pieces)])
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECES, "right")) - 1)
        n = pieces[a:b]
        first = edges[a:b] - edges[a]
        which = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(start[a:b], n) + 8 * which
        left = np.minimum(8, np.repeat(end[a:b], n) - at)
        piece = at_byte[at] & _FIRST[left]
        out[a:b] = np.add.reduceat(mix(piece ^ mix((which + 1).astype(np.uint64) * np.uint64(_STEP))), first)
        a = b
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(_STEP)))


def words(texts: Sequence[bytes | None], inside: np.ndarray, lower: bool) -> Words:
    """The words of texts (UTF-8; None: no words): maximal runs of bytes for which inside holds.

    lower: A to Z count as a to z, in inside and in the hashes.
    """
    data = b"\n".join(t or b"" for t in texts) + b"\n"
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    read = data.translate(_LOWER) if lower else data
    mask = inside[np.frombuffer(read, np.uint8)]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is a separator, so every word ends
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, row, start, end, _hashes(read, start, end), np.searchsorted(row, np.arange(len(texts) + 1)))


def groups(texts: Sequence[bytes | None]) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of about CHUNK bytes of texts."""
    a = held = 0
    for b, t in enumerate(texts, 1):
        held += len(t or b"")
        if held >= CHUNK or b == len(texts):
            yield a, b
            a, held = b, 0


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches of about CHUNK bytes of text, each with its texts as UTF-8 (null: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        for a, b in groups(values):
            yield batch.slice(a, b - a), [x or b"" for x in values[a:b]]
