"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots, one for a word's first piece and one for the pieces that go on. Each node has a failure link, where
matching goes on once no child fits, and the number of pieces that are then complete. A word is counted in time linear in its
length, and no piece is ever built. A task counts each distinct word once while it stays in the task's cache.

A word is matched with the word mark before it: where no marked piece fits, the bare mark is its first token, if the vocabulary has it.
Characters that the vocabulary lacks count as their UTF-8 bytes where it has pieces for all bytes; elsewhere a word that
it can't spell counts as one unknown token, as in greedy word-piece encoding.

Defined results: null and empty texts have no words and 0 tokens. Repeated rows and null ids pass through. An empty table gives an empty
result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.textblocks import Block, blocks

CACHE_WORDS = 2_000_000
MARK = "▁"


class LongestMatch:
    """``first``: pieces that start a word, the empty one if the mark alone may; ``later``: pieces that go on. ``by_bytes``: a character that no piece fits counts as its bytes."""

    def __init__(self, first: Iterable[str], later: Iterable[str], by_bytes: bool = False):
        child: list[dict[str, int]] = [{}, {}]  # node 0: a word's start; node 1: where a piece has just ended
        whole: set[int] = set()
        fail, popped = [-1, -1], [0, 0]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                if not piece and root == 0:
                    fail[0], popped[0] = 1, 1
                node = root
                for c in piece:
                    if c not in child[node]:
                        child[node][c] = len(child)
                        child.append({})
                    node = child[node][c]
                if piece:
                    whole.add(node)
        if by_bytes and fail[0] < 0:
            fail[0], popped[0] = 1, len(MARK.encode())
        fail += [-1] * (len(child) - 2)
        popped += [0] * (len(child) - 2)
        level = [0, 1]
        while level:
            after = []
            for u in level:
                for c, v in child[u].items():
                    after.append(v)
                    if v in whole:
                        fail[v], popped[v] = 1, 1
                        continue
                    z, n = fail[u], popped[u]
                    while z >= 0 and c not in child[z]:
                        n += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = child[z][c], n
                    elif by_bytes:
                        fail[v], popped[v] = 1, n + len(c.encode())
            level = after
        self.child, self.fail, self.popped, self.by_bytes = child, fail, popped, by_bytes

    def count(self, word: str) -> int:
        """The number of greedy pieces of the word; -1 if it can't be spelt."""
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in child[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    break
            if node >= 0:
                node = child[node][c]
            elif self.by_bytes:
                n += len(c.encode())
                node = 1
            else:
                return -1
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def load_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word-initial pieces without their mark (the bare mark is the empty one) and the pieces that can go on of a ``sentencepiece`` model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return [p[1:] for p in pieces if p.startswith(MARK)], pieces


def has_bytes(path: str) -> bool:
    """Whether a ``sentencepiece`` model has a piece for each byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(k) for k in range(model.get_piece_size())) == 256


class Counter:
    """Counts of whole blocks, with a cache of words."""

    def __init__(self, automaton: LongestMatch, most: int = CACHE_WORDS):
        self.automaton, self.most = automaton, most
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and unknown words of each document."""
        start, end, first = block.words()
        keys, where, inverse = np.unique(block.hashes(start, end), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        known = (self.keys[np.minimum(slot, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > self.most:
                self.keys, self.n = self.keys[:0], self.n[:0]
                known[:] = False
            data, count = block.buf.tobytes(), self.automaton.count
            new = np.flatnonzero(~known)
            n = np.array([count(data[start[k] : end[k]].decode()) for k in where[new]], np.int32)
            put = np.searchsorted(self.keys, keys[new])
            self.keys, self.n = np.insert(self.keys, put, keys[new]), np.insert(self.n, put, n)
            slot = np.searchsorted(self.keys, keys)
        n = self.n[slot][inverse].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        tokens, unknown = np.append(0, np.cumsum(np.abs(n))), np.append(0, np.cumsum(n < 0))
        return np.diff(first), np.diff(tokens[first]), np.diff(unknown[first])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown``; ``vocabulary``: path of a ``sentencepiece`` model that every executor can read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(LongestMatch(*load_vocabulary(vocabulary), has_bytes(vocabulary)))
        counter = _counters[vocabulary]
        for batch in batches:
            for block in blocks(batch.column("text"), 4 << 20):
                words, tokens, unknown = counter.count(block)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.first, block.n), pa.array(words), pa.array(tokens), pa.array(unknown)], ["id", "n_words", "n_tokens", "n_unknown"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "id long, n_words long, n_tokens long, n_unknown long")
    return out if id_col == "id" else out.withColumnRenamed("id", id_col)
