"""Words and rolling hashes of whole Arrow text columns, in numpy.

Everything here works on the UTF-8 bytes of one slice of an Arrow batch. Slices are cut so that
their arrays stay small; one document is never cut, so a slice is at least a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

#: White space of all word definitions here: the space and TAB to CR.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: A to Z to a to z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at document borders into slices of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, next to those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over a task's batches, with its memory released at the end."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets between them. Null is an empty text."""
    array = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``; document d has the words first[d] to first[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def find_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes that are not blank, never across the border of two documents."""
    solid = ~blank[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[offsets < len(data)]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (two rounds of xor-shift and odd multiplication)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from one pass of prefix sums."""

    def __init__(self, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 2**64, 256, dtype=U64)
        self.base = U64(int(random.integers(0, 2**62)) * 4 + 3)
        self.inverse = U64(pow(int(self.base), -1, 2**64))
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 1 << 16)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a sequence of 64-bit values."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], dtype=U64, out=out[1:])
        return out

    def byte_sums(self, data: np.ndarray) -> np.ndarray:
        return self.sums(self.table[data])

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of every range [start, end)."""
        return mixed((sums[end] - sums[start]) * self.inverses[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values (len(x) - w + 1 of them), in linear time."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a range that begins at one of ``starts``."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, size), -1)
    return np.cumsum(marks[:-1]) > 0
