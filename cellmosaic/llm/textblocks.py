"""Words of many documents at once, as NumPy arrays over Arrow's UTF-8 buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single ASCII bytes, so words are found on the bytes.
Documents are taken in blocks of a few MB; a longer document is a block of its own, whose masks and sums are made in parts of ``PART_BYTES``:
besides its bytes, only where its words lie and their hashes are held whole. A null text is an empty one, which has no words; an empty column gives no block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = PART_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ASCII punctuation and control characters: words are then runs of letters, digits and all that isn't ASCII.
_MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INV):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n <= BLOCK_BYTES:  # longer ones, of spans of words, aren't kept
        _powers[:] = made
    return made[0], made[1]


def give_back() -> None:
    """Freed memory goes back to the system: workers and the driver live on long after a batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a new array)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Block:
    """Rows ``first .. last - 1`` of a batch. ``buf``: their bytes; ``offsets``: where each row starts in it."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.buf, self.offsets, self.first, self.n = buf, offsets, first, len(offsets) - 1

    def words(self, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and end, and for each row (and past the last) the number of its first word. ``bare``: punctuation separates words too."""
        table, n, rows = _MARKS if bare else _SPACE, len(self.buf), self.offsets
        starts, ends, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], True
        for a in range(0, n, PART_BYTES):
            b = min(a + PART_BYTES, n)
            space = table[self.buf[a : b + 1]]  # and the byte after, if there is one
            before = np.append(last, space[: b - a - 1])
            last = space[b - a - 1]
            after = np.append(space[1 : b - a], space[b - a] if b < n else True)
            x, y = np.searchsorted(rows, (a, b), "left")
            before[rows[x:y] - a] = True
            x, y = np.searchsorted(rows, (a, b), "right")
            after[rows[x:y] - a - 1] = True
            word = ~space[: b - a]
            starts.append(np.flatnonzero(before & word) + a)
            ends.append(np.flatnonzero(after & word) + a + 1)
        start = np.concatenate(starts) if len(starts) > 2 else starts[-1]
        return start, np.concatenate(ends) if len(ends) > 2 else ends[-1], np.searchsorted(start, rows)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes, spans in order and apart; ``lower``: with A-Z as a-z."""
        n, table, out = len(self.buf), _LOWER if lower else _RAW, np.zeros(len(start), np.uint64)
        up, down = _power(min(n, PART_BYTES))
        for a in range(0, n, PART_BYTES):
            b = min(a + PART_BYTES, n)
            x, y = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
            if x == y:
                continue
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[self.buf[a:b]] * up[: b - a], out=sums[1:])
            s, e = np.maximum(start[x:y], a) - a, np.minimum(end[x:y], b) - a
            part = (sums[e] - sums[s]) * down[s]
            if start[x] < a:  # the rest of a span that began in an earlier part
                part[:1] *= np.uint64(pow(int(_BASE), a - int(start[x]), 1 << 64))
            out[x:y] += part
        return mix(out + (end - start).astype(np.uint64))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield Block(data[own[0] : own[-1]], own - own[0], first)
        first = last
    give_back()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` values from each one on; the last ``k - 1`` have none and are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += words[j : j + n]
    return mix(out)


def joined_words(block: Block, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.LargeStringArray:
    """Each row's words that ``keep`` marks, joined by one space."""
    edge = np.zeros(len(block.buf) + 2, np.int8)
    last = np.zeros(len(start), bool)  # the last kept word of its row: no space follows
    kept = np.flatnonzero(keep)
    row = np.searchsorted(first, kept, "right") - 1
    last[kept[np.append(row[1:] != row[:-1], True)[: len(kept)]]] = True
    stop = end[kept] + ~last[kept]
    edge[start[kept]] += 1
    np.add.at(edge, stop, -1)
    mask = np.cumsum(edge[: len(block.buf)], dtype=np.int8).astype(bool)
    data = block.buf[mask]
    data[_SPACE[data]] = 32
    through = np.append(0, np.cumsum(stop - start[kept]))
    offsets = through[np.searchsorted(kept, first)]
    return pa.LargeStringArray.from_buffers(block.n, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
