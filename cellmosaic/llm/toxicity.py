"""Toxicity: subword-bag embeddings, averaged over a text's distinct words, into a linear softmax; both trained together in NumPy.

A word that fills a text counts once, so that junk doesn't drown or feign a signal. A word's features are itself and its byte n-grams (``GRAMS``, with marks at both ends), hashed into ``BUCKETS`` rows of an embedding table. Misspelt and unseen
words share n-grams with known ones, and so their vectors. Training takes at most ``rows`` labelled texts of each label and ``most_bytes`` of text in all, by a hash order, whole,
on the driver; a text that doesn't fit into what is left of the bytes is passed over. As the softmax is linear, a trained feature counts for one number only, so scoring adds up numbers of words; each worker keeps
those of the words that it has met.

Defined results: null and empty texts have no features and score the labels' share. Labels other than 0 and 1, null among them, teach nothing; a document labelled both ways
counts as 1. Without labels, or with one kind only, the score is that share, and 0 without any. Null ids are never held out. Repeated rows get equal
scores. An empty table gives an empty result. Other columns, whatever their names, are not read: label, language, source and id never enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.textblocks import Block, blocks, give_back, mix

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
LEAST_DOCS, NEUTRAL = 5, 200  # features of fewer training texts teach nothing; every text has so many features without weight besides its own
CACHE_WORDS = 1_500_000
_A, _Z = 60, 62  # the marks at a word's ends


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words ``data[start:end]`` (A-Z as a-z) in a row, and where each word's begin."""
    n = end - start
    at = np.append(0, np.cumsum(n + 2))
    flat = np.empty(at[-1], np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    flat[at[:-1]], flat[at[1:] - 1] = _A, _Z
    flat[inside] = data[np.repeat(start - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())]
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint64)
    owner = np.repeat(np.arange(len(n)), n + 2)
    left = np.repeat(at[1:], n + 2) - np.arange(at[-1])  # bytes from here to the word's end
    h, owners, hashes = np.zeros(at[-1], np.uint64), [], []
    whole = np.zeros(at[-1] + 1, np.uint64)
    np.cumsum(mix(flat + (np.arange(at[-1], dtype=np.uint64) - np.repeat(at[:-1], n + 2).astype(np.uint64)) * np.uint64(257)), out=whole[1:])
    owners.append(np.arange(len(n)))
    hashes.append(mix(whole[at[1:]] - whole[at[:-1]]))
    for k in range(max(GRAMS)):
        shifted = np.zeros_like(flat)
        shifted[: len(flat) - k] = flat[k:]
        h = h * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        if k + 1 in GRAMS:
            fits = left > k
            owners.append(owner[fits])
            hashes.append(mix(h[fits] + np.uint64(k)))
    owner, h = np.concatenate(owners), (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return h[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))


@dataclass
class Model:
    """``weights``: what each feature adds to the log odds before averaging."""

    weights: np.ndarray
    bias: float

    def score(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / (counts + NEUTRAL), -500, 500)))


def train(texts: list[str | None] | pa.ChunkedArray, labels: np.ndarray, share: float, epochs: int = 8, batch: int = 32, rate: float = 1.5, seed: int = 11) -> Model:
    """``share``: of label 1 among all texts, to which the balanced sample's odds are brought back."""
    prior = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), prior)
    keys, starts, ends, spots, base = [], [], [], [], 0
    docs: list[np.ndarray | None] = []
    bufs = []
    for block in blocks(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string()), 1 << 18):  # small ones: the driver keeps tables as long as a block
        start, end, first = block.words()
        h = block.hashes(start, end, lower=True)
        docs += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        unique, where = np.unique(h, return_index=True)
        keys.append(unique)
        spots.append(where)
        starts.append(start[where] + base)
        ends.append(end[where] + base)
        bufs.append(block.buf)
        base += len(block.buf)
    vocabulary, where = np.unique(np.concatenate(keys), return_index=True)
    data, starts, ends = np.concatenate(bufs), np.concatenate(starts)[where], np.concatenate(ends)[where]
    parts = [word_features(data, starts[k : k + 10_000], ends[k : k + 10_000]) for k in range(0, len(starts), 10_000)]  # so that no more than some MB are held at once
    features, full = np.concatenate([f for f, _ in parts]), np.concatenate([np.diff(a) for _, a in parts])
    at = np.append(0, np.cumsum(full))
    del parts, data, bufs, keys, spots, starts, ends
    bags, seen = [], np.zeros(BUCKETS, np.int32)
    for k, h in enumerate(docs):
        word, docs[k] = np.unique(np.searchsorted(vocabulary, h)).astype(np.int32), None
        bags.append((word, np.full(len(word), 1 / (int(full[word].sum()) + NEUTRAL), np.float32)))
        own = np.zeros(BUCKETS, bool)
        own[features[np.repeat(at[word] - np.append(0, np.cumsum(full[word]))[:-1], full[word]) + np.arange(full[word].sum())]] = True
        seen += own
    often = (seen >= LEAST_DOCS)[features]
    at = np.append(0, np.cumsum(often))[at]
    features, size = features[often], np.diff(at)
    for k, (w, c) in enumerate(bags):
        bags[k] = w[size[w] > 0], c[size[w] > 0]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_table, g_out, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    touched = np.zeros(BUCKETS, bool)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            word = np.concatenate([bags[d][0] for d in own])
            if not len(word):
                continue
            part = np.concatenate([bags[d][1] for d in own])
            doc = np.repeat(np.arange(len(own)), [len(bags[d][0]) for d in own])
            used, inverse = np.unique(word, return_inverse=True)
            n = size[used]
            slot = np.repeat(at[used] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            feature = features[slot]
            vector = np.add.reduceat(table[feature], np.append(0, np.cumsum(n))[:-1])
            share_of = np.zeros((len(own), len(used)), np.float32)
            share_of[doc, inverse] = part
            hidden = share_of @ vector
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p - target[own]
            d_out, d_bias, d_hidden = hidden.T @ error, error.sum(0), error @ out.T
            d_word = share_of.T @ d_hidden
            by = np.argsort(feature, kind="stable")
            unique, first = np.unique(feature[by], return_index=True)
            d_table = np.add.reduceat(np.repeat(d_word, n, axis=0)[by], first)
            g_table[unique] += (d_table**2).mean(1)
            table[unique] -= rate * d_table / np.sqrt(g_table[unique])[:, None]
            touched[unique] = True
            g_out += d_out**2
            out -= rate * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    weights = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
    weights[~touched] = 0
    sampled = float(labels.mean())
    return Model(weights, float(bias[1] - bias[0]) + prior - math.log(sampled / (1 - sampled)))


class Scorer:
    def __init__(self, model: Model, most: int = CACHE_WORDS):
        self.model, self.most = model, most
        self.keys, self.sums, self.counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def score(self, block: Block) -> np.ndarray:
        start, end, first = block.words()
        keys, where, inverse = np.unique(block.hashes(start, end, lower=True), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        known = (self.keys[np.minimum(slot, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > self.most:
                self.keys, self.sums, self.counts = self.keys[:0], self.sums[:0], self.counts[:0]
                known[:] = False
            new = np.flatnonzero(~known)
            sums, counts = np.empty(len(new)), np.empty(len(new), np.int64)
            for k in range(0, len(new), 20_000):
                spots = where[new[k : k + 20_000]]
                features, at = word_features(block.buf, start[spots], end[spots])
                sums[k : k + 20_000] = np.add.reduceat(self.model.weights[features], at[:-1])
                counts[k : k + 20_000] = np.diff(at)
            put = np.searchsorted(self.keys, keys[new])
            self.keys, self.sums, self.counts = np.insert(self.keys, put, keys[new]), np.insert(self.sums, put, sums), np.insert(self.counts, put, counts)
            slot = np.searchsorted(self.keys, keys)
        if not len(keys):
            return self.model.score(np.zeros(block.n), np.zeros(block.n))
        once = np.unique(np.repeat(np.arange(block.n), np.diff(first)) * len(keys) + inverse)
        own, doc = slot[once % len(keys)], once // len(keys)
        return self.model.score(np.bincount(doc, self.sums[own], block.n), np.bincount(doc, self.counts[own], block.n))


_scorers: dict[str, Scorer] = {}


def held_out(id_col) -> F.Column:
    """Documents that teach nothing: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 1500, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most ``rows`` labelled documents of each label, ``most_bytes`` of text in all, that are not held out. Of different texts with one id, the one with the least hash."""
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    given = given.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = dict(given.groupBy("y").count().collect())
    chosen = None
    for y in (0, 1):  # each a bounded top-k by hash
        part = given.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    sizes = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("mark", F.octet_length("text").alias("bytes"))).alias("one"), F.first("y").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    taken, left = [], most_bytes
    for r in sizes.orderBy(*order).select("id", "one.mark", "one.bytes", "y").collect():  # 2 * ``rows`` at most
        if r["bytes"] <= left:
            taken.append((r["id"], r["mark"], r["y"]))
            left -= r["bytes"]
    few = docs.sparkSession.createDataFrame(taken, "id long, mark long, y int")
    got = own.join(F.broadcast(few), ["id", "mark"]).dropDuplicates(["id"]).orderBy(*order).select("text", "y").toArrow()
    total = sum(counts.values())
    model = train(got.column("text"), got.column("y").to_numpy(), counts.get(1, 0) / total if total else 0.0)
    del got
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as struct ``row``, and ``score``."""
    name = f"{hash((model.bias, model.weights.tobytes()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(model)
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(block.first, block.n), pa.array(_scorers[name].score(block))], ["row", "score"])

    frame = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    kind = frame.schema["row"].dataType
    return frame.mapInArrow(run, f"row {kind.simpleString()}, score double")
