"""Vectorised access to the words of Arrow string columns.

A word is a maximal run of bytes outside space and \\t..\\r, i.e. the pattern [^\\x20\\x09-\\x0D]+ on the text
(UTF-8 continuation bytes never fall in that set). Nothing here loops over words in Python: one pass over the
column's own byte buffer finds all words of a slice of rows and gives each a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Target bytes of text handled at a time; a longer single text forms a slice of its own.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift), so that every bit of a hash depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: By number of bytes left, what of a lane of eight bytes belongs to a span.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes than this are hashed one by one by BLAKE2.
LONG_SPAN = 256


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] (end > start), equal for equal contents wherever they stand.

    Up to seven bytes are one lane with the size above them, mixed by a bijection: no two such spans collide. Longer ones run through two chains of lanes, one
    by addition and one by exclusive or, with the size at the end; a change in one lane cannot be undone in both by any rule. They
    could still meet by chance, one pair in 2**64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    unit = values.itemsize
    raw = np.concatenate([np.ascontiguousarray(values).view(np.uint8), np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    at, size = starts * unit, (ends - starts) * unit
    first = lanes[at] & LANE[np.minimum(size, 8)]
    out = mix(first | (np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)))
    left = np.flatnonzero((size >= 8) & (size <= LONG_SPAN))
    if len(left):
        left = left[np.argsort(-size[left], kind="stable")]  # those with more lanes first: who goes on is always a head of the array
        much, where = size[left], at[left]
        a, b = out[left], mix(first[left] ^ np.uint64(0x9E3779B97F4A7C15))
        for k in range(1, LONG_SPAN // 8):
            n = int(np.searchsorted(-much, -8 * k, "left"))  # of more than 8 k bytes
            if not n:
                break
            lane = lanes[where[:n] + 8 * k] & LANE[np.minimum(much[:n] - 8 * k, 8)]
            a[:n], b[:n] = mix(a[:n] + lane), mix(b[:n] ^ lane)
        out[left] = mix(a + mix(b ^ much.astype(np.uint64)))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + size[i]].data, digest_size=8).digest(), "little")
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and where each row starts (one more entry than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class HashTable:
    """Numbers distinct 64-bit hashes 0, 1, 2, ... in the order of insertion; whole arrays are looked up at once."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self._room(1 << 14)

    def _room(self, size: int) -> None:
        self.keys, self.numbers, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.uint64(size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        place = (hashes & self.mask).astype(np.int64)
        out = self.numbers[place]
        left = np.flatnonzero((self.keys[place] != hashes) & (out >= 0))
        out[self.keys[place] != hashes] = -1
        place = place[left]
        while len(left):
            place = (place + 1) & int(self.mask)
            same = self.keys[place] == hashes[left]
            number = self.numbers[place]
            out[left[same & (number >= 0)]] = number[same & (number >= 0)]
            go = ~same & (number >= 0)
            left, place = left[go], place[go]
        return out

    def insert(self, new: np.ndarray) -> None:
        """Distinct unknown hashes get the next numbers."""
        if (self.n + len(new)) * 3 > len(self.keys):
            used = self.numbers >= 0
            keys, numbers = self.keys[used], self.numbers[used]
            self._room(1 << int((self.n + len(new)) * 4).bit_length())
            self._put(keys, numbers)
        self._put(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
        self.n += len(new)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        place = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.numbers[place] < 0)
            self.numbers[place[free]] = numbers[free]  # of several for one place the last stays
            won = free[self.numbers[place[free]] == numbers[free]]
            self.keys[place[won]] = keys[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, numbers, place = keys[lost], numbers[lost], (place[lost] + 1) & int(self.mask)


@dataclass
class Words:
    """All words of a slice: starts and ends in raw, hashes, and first[d]:first[d+1], the words of row d."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def runs_of(column: pa.Array, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs within rows of the bytes that the table `inside` marks: all bytes (A-Z lower-cased), starts and ends in them, and first[d]:first[d+1], the runs of row d."""
    raw, off = buffers(column)
    if lower:
        raw = _LOWER[raw]
    marked = inside[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = marked[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    starts = np.flatnonzero(marked & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = marked[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(marked & ~after) + 1
    return raw, starts, ends, np.searchsorted(starts, off)


def words_of(column: pa.Array, lower: bool = True) -> Words:
    raw, starts, ends, first = runs_of(column, ~_WS, lower)
    return Words(raw, starts, ends, span_hash(raw, starts, ends), first)


def give_back() -> None:
    """Returns to the system what the allocators of this process hold unused: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with give_back() after each batch and when a task ends: Spark keeps its workers, and they would keep the most that any task took."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given(batches))
        finally:
            give_back()

    return task


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most size bytes of the text column, or of one row."""
    for batch in batches:
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
