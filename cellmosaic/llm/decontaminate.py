"""Benchmark decontamination: documents that hold a benchmark item, up to a share of edits in its words.

Items and documents are sequences of bare words (runs of letters and digits, A-Z lower-cased). The CGK embedding walks over a
sequence by random bits of the words that it reads, so that sequences at a small edit distance come out at a small Hamming
distance. From ``WALKS`` walks, ``TABLES`` hashes of ``SAMPLED`` random coordinates each are taken, for every item and for every window of its size in a
document; where a hash agrees, the edit distance is computed in full (the item against the best stretch of words there), and it alone decides.

A walk that edits have shifted comes back into step only after about the square of the shift, so long sequences need ever more hashes. Items of 2 * ``PIECE`` words or more are therefore
sought by pieces of ``PIECE`` words to twice as many: of the pieces of an item within its edits, one at least is within its own. With that, the number of hashes that reaches the
target recall is the same for all lengths.

Before that a lossless screen leaves out windows: a piece of L words within d edits shares at least L - 2 - 3d of its word
triples with what it matches, so stretches with fewer of them hold no match. Pieces of about one length are screened and sought together.

Items of fewer than ``MIN_WORDS`` words have too few coordinates to sample. They have an exact way: the same screen by runs of q words (q = 2, or 1 where L - q + 1 - qd would be below one),
in inverted lists, and the edit distance wherever one item has enough runs close together.

Items with equal words are sought once. They are taken in blocks of ``ITEMS``, or ``ITEM_WORDS`` words (at most a few tens of MB for each task); more items mean more passes over the documents.

Defined results: null and empty texts hold nothing; items without words, null and empty ones among them, match nothing. Repeated rows get
equal results; items with equal ids are told apart by their texts and reported once. Null ids are kept as they are. Empty tables give empty
results or no matches. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.textblocks import blocks, mix, shingles

WALKS, TABLES, SAMPLED = 6, 10, 2
MIN_WORDS, PIECE, CLASS = 8, 16, 4
ITEMS, ITEM_WORDS, PAIRS = 20_000, 2_000_000, 1 << 21
_SCREEN_BITS = 22
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("edits", pa.int32())]))


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least number of edits between the item and any stretch of the text, and that stretch."""
    n = len(text)
    steps = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), steps.copy()
    for w in item:
        drop = cost + 1
        swap = np.append(cost[0] + 1, cost[:-1] + (text != w))
        take = swap < drop
        take[0] = False
        base = np.where(take, swap, drop)
        start = np.where(take, np.append(origin[0], origin[:-1]), origin)
        run = np.minimum.accumulate((base - steps) * (n + 1) + steps)  # the cheapest place to go on from with words of the text alone
        at = run % (n + 1)
        cost, origin = base[at] + steps - at, start[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def _walks(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The symbols that one walk reads from each start on; past a stop it reads nothing."""
    out = np.zeros((steps, len(starts)), np.uint64)
    if not len(starts):
        return out
    reach = min(len(words), int(starts.max()) + steps + 1)
    base = int(starts.min())  # starts come in order: only these words can be read
    padded = np.append(words[base:reach], np.uint64(0))
    at, stops, bits = starts - base, np.minimum(stops, reach) - base, None
    for j in range(steps):
        if j % 64 == 0:
            bits = mix(padded + np.uint64((1000 * walk + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        here = np.minimum(at, stops)
        out[j] = np.where(at < stops, padded[here], np.uint64(0))
        at += ((bits[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return out


class _Pieces:
    """Hash tables over pieces of about one length: item and place of each, its screen, and the sampled coordinates."""

    def __init__(self, words: list[np.ndarray], item: np.ndarray, place: np.ndarray, percent: int, seed: int):
        self.item, self.place = item, place
        size = np.array([len(w) for w in words])
        edits = size * (100 - percent) // 100
        self.triples = np.unique(np.concatenate([shingles(w, 3) for w in words]))
        self.longest, self.least = int((size + edits).max()), max(1, int((size - 2 - 3 * edits).min()))
        stops = np.cumsum(size)
        self.sampled = np.random.default_rng(seed).integers(0, max(1, int(1.6 * size.min())), (WALKS, TABLES, SAMPLED))
        self.steps = int(self.sampled.max()) + 1
        self.tables = []
        for walk in range(WALKS):
            symbols = _walks(np.concatenate(words), stops - size, stops, self.steps, walk)
            for at in self.sampled[walk]:
                keys = self.key(symbols, at)
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], order))

    @staticmethod
    def key(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(symbols.shape[1], np.uint64)
        for j in at:
            out = mix(out + symbols[j])
        return out

    def windows(self, words: np.ndarray, first: np.ndarray, triples: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window that agrees with a piece in a hash, and the piece. ``hits``: places of triples that some piece may have."""
        near = np.minimum(np.searchsorted(self.triples, triples[hits]), len(self.triples) - 1)
        at = hits[self.triples[near] == triples[hits]]  # triples across two documents do no harm: they only let more through
        last = at[self.least - 1 :]
        begin = np.maximum(last + 3 - self.longest, 0)
        good = at[: len(last)] >= begin
        none = np.zeros(0, np.int64)
        if not good.any():
            return none, none
        edge = np.zeros(len(words) + 2, np.int64)
        np.add.at(edge, begin[good], 1)
        np.add.at(edge, at[: len(last)][good] + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: len(words)] > 0)
        stops = first[np.searchsorted(first, starts, "right")]
        found = []
        for a in range(0, len(starts), 1 << 14):
            own = starts[a : a + (1 << 14)]
            for walk in range(WALKS):
                symbols = _walks(words, own, stops[a : a + (1 << 14)], self.steps, walk)
                for t, coordinates in enumerate(self.sampled[walk]):
                    keys, order = self.tables[walk * TABLES + t]
                    key = self.key(symbols, coordinates)
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    n = hi - lo
                    if n.any():
                        piece = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        found.append(np.unique(np.repeat(own, n) * len(order) + piece))
        if not found:
            return none, none
        both = np.unique(np.concatenate(found))
        return both // len(self.item), both % len(self.item)


@dataclass
class _Class:
    """Short items of one length with runs of ``q`` words: ``keys`` in order, the items of each from ``at`` to the next; the fewest runs that a match shares, and its longest stretch."""

    q: int
    keys: np.ndarray
    at: np.ndarray
    items: np.ndarray
    least: int
    longest: int


@dataclass
class Items:
    """A block of items, by their words; ``ids``: the ids of each."""

    ids: list[list[int | None]]
    words: list[np.ndarray]
    percent: int

    def __post_init__(self):
        keep = [k for k, w in enumerate(self.words) if len(w)]
        self.ids, self.words = [self.ids[k] for k in keep], [self.words[k] for k in keep]
        size = np.array([len(w) for w in self.words], np.int64)
        self.edits = size * (100 - self.percent) // 100
        self.span = size + self.edits
        run = np.ones(len(keep), np.int64)
        run[size - 1 - 2 * self.edits >= 1] = 2
        run[size >= MIN_WORDS] = 3
        self.need = size - run + 1 - run * self.edits
        self.classes: list[_Class] = []
        self.screens: dict[int, np.ndarray] = {}
        for q, n in sorted(set(zip(run[size < MIN_WORDS].tolist(), size[size < MIN_WORDS].tolist(), strict=True))):
            own = np.flatnonzero((run == q) & (size == n))
            grams = [np.unique(shingles(self.words[k], q)) for k in own]
            flat, items = np.concatenate(grams), np.repeat(own, [len(g) for g in grams])
            order = np.argsort(flat, kind="stable")
            keys, at = np.unique(flat[order], return_index=True)
            self.classes.append(_Class(q, keys, np.append(at, len(flat)), items[order], max(1, int(self.need[own].min())), int(self.span[own].max())))
            self._screen(q, keys)
        pieces: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for k in np.flatnonzero(size >= MIN_WORDS).tolist():
            at = 0
            for part in np.array_split(self.words[k], max(1, len(self.words[k]) // PIECE)):
                pieces.setdefault(len(part) // CLASS, []).append((part, k, at))
                at += len(part)
        self.pieces = []
        for c, own in sorted(pieces.items()):
            words, item, place = zip(*own, strict=True)
            self.pieces.append(_Pieces(list(words), np.array(item), np.array(place), self.percent, c))
            self._screen(3, self.pieces[-1].triples)

    def _screen(self, q: int, keys: np.ndarray) -> None:
        self.screens.setdefault(q, np.zeros(1 << _SCREEN_BITS, bool))[keys & np.uint64((1 << _SCREEN_BITS) - 1)] = True

    def _stretches(self, kind: _Class, at: np.ndarray, slot: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Row, item, begin and stop of stretches where one item has as many runs of words as a match needs."""
        times = kind.at[slot + 1] - kind.at[slot]
        where = np.repeat(kind.at[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pos, item = np.repeat(at, times), kind.items[where]
        order = np.argsort(item, kind="stable")
        pos, item = pos[order], item[order]
        row = np.searchsorted(first, pos, "right") - 1
        i = np.arange(len(pos))
        j = i + np.maximum(1, self.need[item]) - 1
        i, j = i[j < len(pos)], j[j < len(pos)]
        good = (item[i] == item[j]) & (row[i] == row[j]) & (pos[j] - pos[i] <= self.span[item[i]] - kind.q)
        i, j = i[good], j[good]
        if not len(i):
            return []
        item, row = item[i], row[i]
        begin = np.maximum(pos[j] + kind.q - self.span[item], first[row])
        stop = np.minimum(pos[i] + self.span[item], first[row + 1])
        new = np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > stop[:-1]))
        last = np.append(new[1:], True)
        return list(zip(row[new].tolist(), item[new].tolist(), begin[new].tolist(), stop[last].tolist(), strict=True))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Row, item, begin and stop of every stretch that can hold a match."""
        found: list[tuple[int, int, int, int]] = []
        hits = {}
        for q, screen in self.screens.items():
            grams = shingles(words, q)
            at = np.flatnonzero(screen[grams & np.uint64((1 << _SCREEN_BITS) - 1)])
            at = at[at + q <= first[np.searchsorted(first, at, "right")]]  # a run of words lies in one document
            hits[q] = at, grams[at]
        if self.pieces:
            at, triples = hits[3]
            flat = np.zeros(len(words), np.uint64)
            flat[at] = triples
            for kind in self.pieces:
                start, piece = kind.windows(words, first, flat, at)
                item = kind.item[piece]
                row = np.searchsorted(first, start, "right") - 1
                # the item begins within its edits of where the piece says, and ends within as many more
                begin = np.maximum(start - kind.place[piece] - self.edits[item], first[row])
                stop = np.minimum(start - kind.place[piece] + self.span[item] + self.edits[item], first[row + 1])
                found += zip(row.tolist(), item.tolist(), begin.tolist(), stop.tolist(), strict=True)
        for kind in self.classes:
            at, grams = hits[kind.q]
            slot = np.minimum(np.searchsorted(kind.keys, grams), len(kind.keys) - 1)
            same = kind.keys[slot] == grams
            at, slot = at[same], slot[same]
            if len(at) < kind.least:
                continue
            close = np.flatnonzero(at[kind.least - 1 :] - at[: len(at) - kind.least + 1] <= kind.longest - kind.q)
            edge = np.zeros(len(at) + 1, np.int64)
            edge[close] += 1
            edge[close + kind.least] -= 1
            kept = np.cumsum(edge)[:-1] > 0
            at, slot = at[kept], slot[kept]
            pairs = np.cumsum(kind.at[slot + 1] - kind.at[slot])
            a = 0
            while a < len(at):  # parts of about ``PAIRS``, each with what a stretch that begins in it can reach
                b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, "right")))
                end = int(np.searchsorted(at, at[b - 1] + kind.longest))
                found += self._stretches(kind, at[a:end], slot[a:end], first)
                a = b
        return sorted(found)

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """Row: item, first and past-the-last word, and edits of every match, the best one where several overlap."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        joined: list[list[int]] = []
        for row, item, begin, stop in self.candidates(words, first):
            if joined and joined[-1][:2] == [row, item] and begin <= joined[-1][3]:
                joined[-1][3] = max(stop, joined[-1][3])
            else:
                joined.append([row, item, begin, stop])
        for row, item, begin, stop in joined:
            if self.need[item] > 0 and len(self.words[item]) >= MIN_WORDS and np.isin(shingles(self.words[item], 3), shingles(words[begin:stop], 3)).sum() < self.need[item]:
                continue
            cost, a, b = best_match(self.words[item], words[begin:stop])
            if cost <= self.edits[item]:
                out.setdefault(row, []).append((item, begin + a - int(first[row]), begin + b - int(first[row]), cost))
        return out


def _bare_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for block in blocks(pa.array(texts, pa.large_string())):
        start, end, first = block.words(bare=True)
        words = block.hashes(start, end, lower=True)
        out += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _matcher(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                start, end, first = block.words(bare=True)
                found = items.matches(block.hashes(start, end, lower=True), first) if items.ids and len(start) else {}
                spans = [[{"item_id": i, "from_word": a, "to_word": b, "edits": d} for k, a, b, d in found.get(r, ()) for i in items.ids[k]] for r in range(block.n)]
                cols = [c.slice(block.first, block.n) for c in batch.columns[:-1]]
                old = batch.columns[-1].slice(block.first, block.n).to_pylist()
                yield pa.RecordBatch.from_arrays([*cols, pa.array([(o or []) + s for o, s in zip(old, spans, strict=True)], _KIND)], batch.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``id, text, matches`` of every row (``with_row``: also all of its columns, as struct ``row``). ``matches``: item, place (in bare words) and edits, at most ``100 - percent`` per cent of the item's words."""
    row = [F.struct(*docs.columns).alias("row")] if with_row else []
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *row, F.lit(None).cast("array<struct<item_id: long, from_word: int, to_word: int, edits: int>>").alias("matches"))
    held: dict[bytes, tuple[list[int | None], np.ndarray]] = {}  # by their words: ids
    n_words = 0

    def matched(frame: DataFrame) -> DataFrame:
        items = Items([ids for ids, _ in held.values()], [words for _, words in held.values()], percent)
        return frame.mapInArrow(_matcher(items), frame.schema)

    # a partition of items at a time comes to the driver, and a block of them goes out with the tasks
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)).distinct().toLocalIterator():
        (words,) = _bare_words([row[1]])
        ids, _ = held.setdefault(words.tobytes(), ([], words))
        if row[0] not in ids:
            ids.append(row[0])
        n_words += len(words)
        if len(held) == ITEMS or n_words >= ITEM_WORDS:
            out, held, n_words = matched(out), {}, 0
    return matched(out) if held else out.withColumn("matches", F.coalesce("matches", F.array().cast(out.schema["matches"].dataType)))
