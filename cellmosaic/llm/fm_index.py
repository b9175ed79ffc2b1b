"""A compressed, word-level FM-index: the runs of a Burrows-Wheeler transform in a wavelet matrix, for patterns of at most ``depth`` words.

What is kept: the symbol of each run (a wavelet matrix), where runs start in the transform and in its sorted order (two bit vectors), where the groups
of suffixes with equal first ``depth`` and ``depth - 1`` words start (two more), for each of the former the number of the least value (two bytes, or four above 65,535 values), and a byte a word (two above 255): how many words a suffix has in common
with the one before. Bit vectors have a 32-bit count every 64 bits and answer rank and select.

Suffixes are sorted by their first ``depth`` words only. Intervals of shorter patterns are whole groups of that order, so
backward search stays exact up to ``depth``, and sorting takes a few rounds of prefix doubling.

No texts, or only empty ones, match nothing; texts of fewer than ``depth`` words have no windows, in the index and in what is streamed.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)
#: By a byte's value and a number: the place of the one with that number.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _ones = [k for k in range(8) if _byte >> k & 1]
    _IN_BYTE[_byte, : len(_ones)] = _ones


class Bits:
    """Packed bits with rank and select, for many places at once."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.words = np.packbits(np.append(bits, np.zeros(64 + (-self.n) % 64, bool)), bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int32)).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one with number ``k``, from 0; ``n`` where there is none."""
        word = np.minimum(np.searchsorted(self.before, k, "right"), len(self.words)) - 1
        left = k - self.before[word]
        parts = self.words[word].view(np.uint8).reshape(-1, 8)
        through = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
        byte = np.minimum((through <= left[:, None]).sum(axis=1), 7)
        lane = np.arange(len(k))
        ones = np.bitwise_count(parts[lane, byte])
        inside = np.clip(left - through[lane, byte] + ones, 0, 7)
        return np.where(k >= self.before[-1], self.n, (word << 6) + (byte << 3) + _IN_BYTE[parts[lane, byte], inside])


class Wavelet:
    """Symbols below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            bit = ((symbols >> k) & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.bits)

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where places ``at`` go in the bottom order on the path of ``symbol``."""
        for k in range(self.levels):
            ones = self.bits[k].rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


def _edges(keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


class FMIndex:
    """Over texts ``words[starts[k]:starts[k + 1]]``; ``values``: a number for each text, of which the least is reported. No texts at all match nothing."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, values: np.ndarray, depth: int):
        self.depth = depth
        self.symbols, ids = np.unique(words, return_inverse=True)
        n_texts, n = len(starts) - 1, len(words) + len(starts) - 1
        self.n = n
        if not n:
            return
        owner = np.repeat(np.arange(n_texts), np.diff(starts))
        text = np.zeros(n, np.int64)  # 0 ends each text
        text[np.arange(len(words)) + owner] = ids + 1
        rank, h, pad = text, 1, np.zeros(depth, np.int64)
        while 2 * h < depth:
            rank = np.unique(rank * (n + 1) + np.append(rank, pad)[h : h + n], return_inverse=True)[1] + 1
            h *= 2
        later = np.append(rank, pad)

        def groups(d: int) -> np.ndarray:
            return np.zeros(n, np.int64) if not d else rank * (n + 2) + later[d - h : d - h + n] if d > h else rank

        order = np.argsort(groups(depth), kind="stable")
        last = text[order - 1]
        head = _edges(last)
        heads, length = last[head], np.diff(np.append(np.flatnonzero(head), n))
        self.runs = Bits(head)
        self.heads = Wavelet(heads, len(self.symbols) + 1)
        by = np.argsort(heads, kind="stable")
        sorted_starts = np.zeros(n, bool)
        sorted_starts[np.append(0, np.cumsum(length[by]))[:-1]] = True
        self.sorted_runs = Bits(sorted_starts)
        every = np.arange(len(self.symbols) + 1)
        runs_below = np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=len(every)))])[:-1]
        self.base = (runs_below - self.heads.descend(np.zeros(len(every), np.int64), every)).astype(np.int32)
        full = _edges(groups(depth)[order])
        self.full = Bits(full)
        self.values, number = np.unique(values, return_inverse=True)
        of_place = np.full(n, len(self.values), np.uint16 if len(self.values) < 1 << 16 else np.uint32)
        of_place[np.arange(len(words)) + owner] = np.repeat(number, np.diff(starts))
        self.least = np.minimum.reduceat(of_place[order], np.flatnonzero(full))
        self.short = Bits(_edges(groups(depth - 1)[order]))  # from there the next backward step gives exactly ``depth`` words
        self.common = np.zeros(n + 1, np.uint8 if depth < 256 else np.uint16)  # with the suffix before, at most ``depth``
        padded, live = np.append(text, np.full(depth, -1)), np.arange(1, n)
        for j in range(depth):
            live = live[padded[order[live] + j] == padded[order[live - 1] + j]]
            self.common[live] = j + 1

    @property
    def nbytes(self) -> int:
        if not self.n:
            return 0
        return sum(x.nbytes for x in (self.symbols, self.runs, self.heads, self.sorted_runs, self.base, self.full, self.values, self.least, self.short, self.common))

    def _back(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The sorted order's place of the symbol's first occurrence at or after ``at`` of the transform."""
        k = self.runs.rank(at)
        both = self.heads.descend(np.concatenate([k, np.maximum(k - 1, 0)]), np.concatenate([symbol, symbol])) + np.concatenate([self.base[symbol]] * 2)
        done, earlier = both[: len(at)], both[len(at) :]
        inside = done != earlier  # the run that ``at`` is in, or just behind, is one of the symbol
        place = self.sorted_runs.select(np.where(inside, earlier, done))
        return np.where(inside, place + at - self.runs.select(np.maximum(k - 1, 0)), place)

    def _alone(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of single symbols."""
        both = np.concatenate([symbol, np.minimum(symbol + 1, len(self.base) - 1)])
        place = self.sorted_runs.select(self.heads.descend(np.zeros(len(both), np.int64), both) + self.base[both])
        return place[: len(symbol)], np.where(symbol + 1 < len(self.base), place[len(symbol) :], self.n)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front; symbol -1, a word that no text has, gives empty ones."""
        known = np.maximum(symbol, 0)
        both = self._back(np.concatenate([lo, hi]), np.concatenate([known, known]))
        return both[: len(lo)], np.where(symbol >= 0, both[len(lo) :], 0)

    def _widen(self, place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` words, from 0, of the suffixes at ``place``."""
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), self.n)
        some = np.flatnonzero(depth > 0)
        for out, at, way in ((lo, place[some], -1), (hi, place[some] + 1, 1)):
            lane, width = some, 16
            while len(lane):
                near = np.clip(at[:, None] + way * np.arange(width), 0, self.n)
                below = self.common[near] < depth[lane][:, None]
                found = below.any(axis=1)
                out[lane[found]] = near[found, below[found].argmax(axis=1)]
                lane, at = lane[~found], at[~found] + way * width
                width = min(4 * width, 1024)
        return lo, hi

    def _symbol(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where(self.symbols[at] == words, at + 1, -1)

    def matches(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Streams texts, all at once and each from right to left. Per window of ``depth`` words, in the order of the texts and of its start: the least value
        of a text of the index that has the window, ``NONE`` where none has.

        Matching statistics, capped at ``depth``: the longest match from each word on. At ``depth`` words the interval is reported and widened to that of one word less. A word that
        doesn't go in front of the match so far shortens it on the right: with how much of it that word goes is found by doubling and halving, each a widening and one step.
        """
        length = np.diff(starts)
        out_at = np.append(0, np.cumsum(np.maximum(length - self.depth + 1, 0)))
        out = np.full(out_at[-1], NONE)
        if not self.n or not len(self.symbols) or not len(out):
            return out
        symbol = self._symbol(words)
        lane = np.flatnonzero(length >= self.depth)
        begin, shift = starts[lane], out_at[lane] - starts[lane]
        end = starts[lane + 1].copy()  # of the match, whose interval is lo .. hi - 1
        at = end - 1  # the next word in front
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        tried = np.full(len(lane), -1)  # how many words of the match are tried behind that word; -1: all of them
        goes, fails, kept_lo, kept_hi = tried.copy(), tried.copy(), lo.copy(), hi.copy()
        while len(lane):
            trying = tried >= 0
            from_lo, from_hi = lo, hi
            which = np.flatnonzero(trying)
            if len(which):
                from_lo, from_hi = lo.copy(), hi.copy()
                from_lo[which], from_hi[which] = self._widen(lo[which], tried[which])
            new_lo, new_hi = self.step(from_lo, from_hi, symbol[at])
            ok = new_lo < new_hi

            on = np.flatnonzero(ok & ~trying)
            lo[on], hi[on] = new_lo[on], new_hi[on]
            whole = on[end[on] - at[on] == self.depth]
            if len(whole):
                least = self.least[self.full.rank(lo[whole] + 1) - 1]
                out[at[whole] + shift[whole]] = self.values[np.minimum(least, len(self.values) - 1)]
                group = self.short.rank(lo[whole] + 1)
                lo[whole], hi[whole] = self.short.select(group - 1), self.short.select(group)
                end[whole] -= 1
            at[on] -= 1

            stuck, won, lost = np.flatnonzero(~ok & ~trying), np.flatnonzero(ok & trying), np.flatnonzero(~ok & trying)
            word = symbol[at[stuck]]  # that word alone, if the index has it, is where to begin
            goes[stuck], fails[stuck] = np.where(word < 0, -1, 0), np.where(word < 0, 0, end[stuck] - at[stuck] - 1)
            kept_lo[stuck], kept_hi[stuck] = self._alone(np.maximum(word, 0))
            goes[won], kept_lo[won], kept_hi[won] = tried[won], new_lo[won], new_hi[won]
            fails[lost] = tried[lost]
            turn = np.concatenate([stuck, won, lost])
            if len(turn):
                over = fails[turn] - goes[turn] <= 1
                back, again = turn[over], turn[~over]
                empty = goes[back] < 0
                end[back] = at[back] + 1 + goes[back]
                lo[back], hi[back] = np.where(empty, 0, kept_lo[back]), np.where(empty, self.n, kept_hi[back])
                at[back] -= 1
                tried[back] = -1
                double = np.maximum(1, 2 * goes[again])
                tried[again] = np.where(double < fails[again], double, (goes[again] + fails[again]) // 2)
            live = (end - begin >= self.depth) & (at >= begin)
            if not live.all():
                begin, shift, end, at, lo, hi, tried, goes, fails, kept_lo, kept_hi, lane = (x[live] for x in (begin, shift, end, at, lo, hi, tried, goes, fails, kept_lo, kept_hi, lane))
        return out
